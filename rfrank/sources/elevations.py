"""Elevations of places from a service that answers many at once."""

from __future__ import annotations

import importlib
import json
import logging
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import ship_package

log = logging.getLogger(__name__)

#: A client takes latitudes and longitudes, and gives an elevation or None for each, in their order; a shorter list leaves the last out.
Client = Callable[[Sequence[float], Sequence[float]], Sequence[float | None]]
BATCH = 100


class HttpClient:
    """Asks ``endpoint`` with both lists, joined by commas, and reads the answer's ``elevation``."""

    def __init__(self, endpoint: str, timeout: float = 10.0):
        self.endpoint, self.timeout = endpoint, timeout

    def __call__(self, lats: Sequence[float], lons: Sequence[float]) -> Sequence[float | None]:
        asked = urllib.parse.urlencode({"latitude": ",".join(map(str, lats)), "longitude": ",".join(map(str, lons))})
        with urllib.request.urlopen(f"{self.endpoint}?{asked}", timeout=self.timeout) as answer:
            return json.load(answer).get("elevation", [])


def _client(client: Client | str) -> Client:
    if not isinstance(client, str):
        return client
    module, _, name = client.partition(":")
    return getattr(importlib.import_module(module), name)


def answers(client: Client, places: Sequence[tuple[float, float]]) -> list[tuple[float, float, float]]:
    """(lat, lon, elevation) of the places that a client knows, asked once; none if it fails, which is logged."""
    if not places:
        return []
    try:
        found = client([p[0] for p in places], [p[1] for p in places])
        return [(*p, float(e)) for p, e in zip(places, found, strict=False) if e is not None]
    except Exception as e:
        log.warning("elevations of %d places failed: %s", len(places), e)
        return []


def lookup_elevations(places: DataFrame, client: Client | str, lat: str = "latitude", lon: str = "longitude", batch: int = BATCH, callers: int | None = None) -> DataFrame:
    """(lat6, lon6, elevation_m) of the different places, to six decimals, as ``add_elevations`` takes them.

    Each place is asked for once, in batches of at most ``batch``, sorted, so that the same places are asked for alike
    every time; ``callers``, by default as many as shuffle partitions, ask at the same time. ``client`` is a function, or
    ``module:name`` of one. A batch that fails, places without an answer, and null ones give no row: whoever joins
    finds no elevation there, and nothing else is lost. Null coordinates are not asked for; an empty table asks nothing.
    """
    ship_package(places.sparkSession)
    at = places.select(F.bround(lat, 6).alias("lat6"), F.bround(lon, 6).alias("lon6")).filter("lat6 is not null and lon6 is not null and not isnan(lat6) and not isnan(lon6)").distinct()
    at = (at.repartition(callers, "lat6", "lon6") if callers else at).sortWithinPartitions("lat6", "lon6")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, held = _client(client), []

        def flush(size: int) -> Iterator[pd.DataFrame]:
            while len(held) >= size and held:
                found = answers(call, held[:batch])
                del held[:batch]
                yield pd.DataFrame(found, columns=["lat6", "lon6", "elevation_m"]).astype("float64")

        for frame in frames:
            held += list(frame.itertuples(index=False, name=None))
            yield from flush(batch)
        yield from flush(1)

    return at.mapInPandas(ask, "lat6 double, lon6 double, elevation_m double")
