"""Licensed systems from a paged service, as a Spark data source with filters pushed into its requests.

``spark.read.format("rf_systems")`` asks for each request point and subtype in a task of its own; within
it pages follow each other by cursor. A row is a device. What the query asks of ``licence_subtype``, ``source``,
``request_no``, ``radius_km`` and ``mhz`` becomes part of the requests: subtypes and points that are not wanted are
never asked, the circle and the range of frequencies are the service's to apply.

A transport sends one request and gives the answer's document. Two are here: ``http``, and ``captures``, which
replays recorded answers; ``module:name`` names another, called with the reader's options.
"""

from __future__ import annotations

import importlib
import io
import json
import logging
import math
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..shared import ship_package
from .schema import DEVICE
from .systems import RANGE_MHZ, SUBTYPE_SOURCES, SUBTYPES, explode_devices

log = logging.getLogger(__name__)

SCHEMA = (
    "request_no int, subtype_no int, page_no int, edge_no int, device_no int, source string, radius_km double, id string, licence_type string, licence_subtype string,"
    " mhz double, device string, error string"
)
#: Systems to a page, by how a country is asked; pages that are read of one request.
PAGE_SIZE = {True: 5, False: 20}
MAX_PAGES = 3
# The service's names of fields.
_NODE = "id devices { callsign frequency(unit: MHz) eirp transmitPower antennaHeight location { name state geom } } licence { type subtype }"


@dataclass(frozen=True)
class Request:
    """What the service is asked for: systems of a source within a circle, of a subtype or with a device in a range of MHz."""

    source: str
    lat: float
    lon: float
    radius_km: float
    subtype: str | None = None
    low_mhz: float | None = None
    high_mhz: float | None = None

    def query(self, cursor: str, page_size: int) -> str:
        """The request for the page after a cursor, as the service's query language has it."""
        said = json.dumps  # its strings are written like JSON's
        filters = []
        if self.subtype is not None:
            filters.append(f"{{ field: licence_subtype, values: {said(self.subtype)} }}")
        if self.low_mhz is not None or self.high_mhz is not None:
            low, high = math.floor((self.low_mhz or 0) * 1e6), math.ceil((self.high_mhz or 1e6) * 1e6)
            filters.append(f'{{ field: device_frequency, type: RANGE, values: ["{low}", "{high}"] }}')
        circle = f'{{ type: CIRCLE, values: ["{self.lat},{self.lon}", "{self.radius_km:g}"] }}'
        asked = f"first: {page_size} after: {said(cursor)} source: {said(self.source)} geoFilter: {circle} filter: [{', '.join(filters)}]"
        return f"query {{ systems({asked}) {{ edges {{ cursor node {{ {_NODE} }} }} pageInfo {{ hasNextPage }} }} }}"


class HttpTransport:
    """Posts each query to ``endpoint``; an answer that is no success or no JSON raises."""

    def __init__(self, options: dict[str, str]):
        self.endpoint, self.timeout = options["endpoint"], float(options.get("timeout", 45))
        self.headers = {"Content-Type": "application/json", "X-Api-Key": options.get("api_key", "")}

    def send(self, part: Part, cursor: str, page_size: int) -> dict:
        body = json.dumps({"query": part.request.query(cursor, page_size)}).encode()
        with urllib.request.urlopen(urllib.request.Request(self.endpoint, body, self.headers), timeout=self.timeout) as answer:
            return json.load(answer)


class CapturedTransport:
    """Replays recorded answers: below ``path``, the folder of a request and subtype holds lines of (after, body) in order.

    Lines are read one after the other, as far as they are asked for.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.lines = options["path"].rstrip("/"), None

    def _open(self, part: Part) -> Iterator[dict]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        folder = fs.FileSelector(f"{at}/request_no={part.request_no}/subtype_no={part.subtype_no}")
        for found in sorted(f.path for f in store.get_file_info(folder) if f.is_file and not f.base_name.startswith(("_", "."))):
            with store.open_input_stream(found) as stream:
                for line in io.TextIOWrapper(stream, encoding="utf-8"):
                    if line.strip():
                        yield json.loads(line)

    def send(self, part: Part, cursor: str, page_size: int) -> dict:
        if self.lines is None:
            self.lines = self._open(part)
        for line in self.lines:
            if line["after"] == cursor:
                return json.loads(line["body"])
        raise LookupError(f"no answer was recorded after {cursor!r}")


TRANSPORTS = {"http": HttpTransport, "captures": CapturedTransport}


def _transport(options: dict[str, str]) -> Any:
    named = options.get("transport", "http")
    if named in TRANSPORTS:
        return TRANSPORTS[named](options)
    module, _, name = named.partition(":")
    return getattr(importlib.import_module(module), name)(options)


@dataclass
class Part(InputPartition):
    """One request, asked page by page in one task."""

    request_no: int
    subtype_no: int
    request: Request

    def __post_init__(self) -> None:
        super().__init__((self.request_no, self.subtype_no))


def pages(part: Part, transport: Any, max_pages: int, page_size: int) -> Iterator[tuple[int, list[dict]]]:
    """(number, edges) of a request's pages.

    They end with the first that holds errors, which gives nothing, or after the first that is last: it says so, has no
    edges, or its cursor is the one that it was asked by.
    """
    cursor = ""
    for number in range(max_pages):
        body = transport.send(part, cursor, page_size)
        if "errors" in body:
            log.warning("request %s: errors on page %d: %s", part.value, number, body["errors"])
            return
        found = (body.get("data") or {}).get("systems") or {}
        edges = found.get("edges") or []
        yield number, edges
        before = cursor
        for edge in edges:
            cursor = edge.get("cursor") or cursor
        if not edges or not (found.get("pageInfo") or {}).get("hasNextPage"):
            return
        if cursor == before:
            log.warning("request %s: the cursor does not move after page %d", part.value, number)
            return


def _number(value: Any) -> float | None:
    """A number in any of the shapes that exports have; of a range, its middle."""
    if isinstance(value, dict):
        if value.get("value") is None:
            low, high = _number(value.get("low")), _number(value.get("high"))
            return None if low is None or high is None else (low + high) / 2
        value = value["value"]
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


class SystemsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.max_pages = int(options.get("max_pages", MAX_PAGES))
        self.asked = [Request(source=r["source"].lower(), lat=r["lat"], lon=r["lon"], radius_km=r.get("radius_km", 80)) for r in json.loads(options["requests"])]
        self.low, self.high, self.radius = -math.inf, math.inf, None
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: Sequence[Filter]) -> Iterator[Filter]:
        """Take from the query's filters what requests can say. All but the radius are checked again on what comes back."""
        for f in filters:
            column, kind = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None, type(f)
            if column == "radius_km" and kind is EqualTo and self.radius in (None, f.value):
                self.radius = float(f.value)
                continue
            if column == "mhz" and kind in (GreaterThan, GreaterThanOrEqual, EqualTo):
                self.low = max(self.low, f.value)
            if column == "mhz" and kind in (LessThan, LessThanOrEqual, EqualTo):
                self.high = min(self.high, f.value)
            if column in ("licence_subtype", "source", "request_no") and kind in (EqualTo, In):
                values = {f.value} if kind is EqualTo else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            yield f

    def _wants(self, column: str, value: Any) -> bool:
        return column not in self.wanted or value in self.wanted[column]

    def partitions(self) -> list[Part]:
        found = []
        for no, request in enumerate(self.asked):
            if not self._wants("source", request.source) or not self._wants("request_no", no):
                continue
            if self.radius is not None:
                request = replace(request, radius_km=self.radius)
            by_subtype = request.source in SUBTYPE_SOURCES
            low, high = (-math.inf, math.inf) if by_subtype else map(float, RANGE_MHZ)
            low, high = max(low, self.low), min(high, self.high)
            request = replace(request, low_mhz=low if low > -math.inf else None, high_mhz=high if high < math.inf else None)
            if low > high:
                continue  # nothing can be in such a range
            for k, subtype in enumerate(SUBTYPES if by_subtype else (None,)):
                if subtype is None or self._wants("licence_subtype", subtype):
                    found.append(Part(no, k, replace(request, subtype=subtype)))
        # Spark wants a partition; one without a request gives nothing.
        return found or [Part(-1, -1, Request("", 0, 0, 0))]

    def read(self, part: Part) -> Iterator[tuple]:
        """A request's rows, or none if it fails on the way: so that a part of an answer never passes for the whole."""
        if part.request_no < 0:
            return
        request, rows = part.request, []
        own = (part.request_no, part.subtype_no)
        try:
            transport = _transport(self.options)
            page_size = int(self.options.get("page_size", PAGE_SIZE[request.source in SUBTYPE_SOURCES]))
            for page_no, edges in pages(part, transport, self.max_pages, page_size):
                for edge_no, edge in enumerate(edges):
                    node = edge.get("node")
                    licence = (node or {}).get("licence") or {}
                    for device_no, device in enumerate((node or {}).get("devices") or ()):
                        text = json.dumps(device, ensure_ascii=False)
                        mhz = _number((device or {}).get("frequency"))
                        rows.append((*own, page_no, edge_no, device_no, request.source, float(request.radius_km), node.get("id"), licence.get("type"), licence.get("subtype"), mhz, text, None))
        except Exception as e:
            if self.options.get("on_error", "skip") == "fail":
                raise
            log.warning("request %s failed: %s", part.value, e)
            rows = [(*own, None, None, None, request.source, float(request.radius_km), None, None, None, None, None, f"{type(e).__name__}: {e}"[:500])]
        yield from rows


class SystemsSource(DataSource):
    """Options: ``requests`` (a JSON list of source, lat, lon, radius_km), ``transport`` and its own, ``max_pages``, ``page_size``, ``on_error``.

    A request holds at most ``max_pages`` pages in its task. One that fails gives one row, with ``error``, and no device;
    with ``on_error`` = fail, the query fails.
    """

    @classmethod
    def name(cls) -> str:
        return "rf_systems"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SystemsReader:
        return SystemsReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``rf_systems`` known to the session, with filters pushed down."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SystemsSource)


def read_paged(spark: SparkSession, requests: Sequence[dict], transport: str = "http", **options: Any) -> DataFrame:
    """Rows of ``rf_systems`` for requests (source, lat, lon, radius_km)."""
    register(spark)
    return spark.read.format("rf_systems").options(requests=json.dumps(list(requests)), transport=transport, **options).load()


def as_devices(rows: DataFrame, source_no: int = 0) -> DataFrame:
    """Rows of ``rf_systems`` as the device rows that a ranking takes, in order of request, subtype, page, edge and device."""
    return explode_devices(
        rows.filter("device is not null").select(
            F.struct("request_no", "subtype_no", "page_no", "edge_no", "device_no").alias("system_no"),
            F.array(F.from_json("device", DEVICE)).alias("devices"),
            F.struct(F.col("licence_type").alias("type"), F.col("licence_subtype").alias("subtype")).alias("licence"),
        ),
        source_no,
    )


def failures(rows: DataFrame) -> DataFrame:
    """(request_no, subtype_no, error) of the requests that failed."""
    return rows.filter("error is not null").select("request_no", "subtype_no", "error")
