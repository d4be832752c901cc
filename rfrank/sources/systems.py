"""Licensed systems with nested devices: captured GraphQL pages, JSON exports, or frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .schema import SYSTEM

#: Licence subtypes, the countries that are asked by subtype, and MHz that the others are asked for.
SUBTYPES = ("Commercial Television", "National Broadcasting", "Commercial Radio")
SUBTYPE_SOURCES = ("au", "ca")
RANGE_MHZ = (54, 698)

_PAGE = (
    "errors string, data struct<systems:struct<edges:array<struct<cursor:string,node:struct<"
    + SYSTEM.replace("id string", "id:string").replace("devices array", "devices:array").replace("licence struct", "licence:struct").replace(", ", ",")
    + ">>>,pageInfo:struct<hasNextPage:boolean>>>"
)


def read_systems(spark: SparkSession, path: str) -> DataFrame:
    """Systems from JSON lines, with a ``system_no`` that keeps their order."""
    return spark.read.schema(SYSTEM).json(path).withColumn("system_no", F.monotonically_increasing_id())


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured response pages, one JSON document a line, as (source, subtype_no, page_no, body text)."""
    return spark.read.schema("source string, subtype_no int, page_no int, body string").json(path)


def page_systems(pages: DataFrame, max_pages: int = 3) -> DataFrame:
    """Systems of captured pages (subtype_no, page_no, body), in order of subtype, page and edge.

    A subtype's pages count up to the first that holds errors, which gives nothing, or the first that is
    last: it says so, has no edges, or ends on the cursor that the page before ended on. Null nodes are skipped.
    """
    from pyspark.sql import Window

    pages = pages.filter(F.col("page_no") < max_pages).withColumn("page", F.from_json("body", _PAGE))
    edges = F.coalesce(F.col("page.data.systems.edges"), F.array().cast(pages.schema["page"].dataType["data"].dataType["systems"].dataType["edges"].dataType))
    cursors = F.filter(F.transform("edges", lambda e: e["cursor"]), lambda c: c.isNotNull())
    order = Window.partitionBy("subtype_no").orderBy("page_no")
    known = pages.withColumn("edges", edges).withColumn("bad", F.col("page.errors").isNotNull() | F.col("page").isNull())
    known = known.withColumn("ends", F.last(F.try_element_at(cursors, F.lit(-1)), ignorenulls=True).over(order))
    known = known.withColumn(
        "final",
        F.col("bad")
        | ~F.coalesce("page.data.systems.pageInfo.hasNextPage", F.lit(False))
        | (F.size("edges") == 0)
        | F.col("ends").eqNullSafe(F.lag("ends").over(order)),
    )
    before = F.coalesce(F.max(F.col("final").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = known.withColumn("before", before).filter("before = 0 and not bad")
    return (
        kept.select("subtype_no", "page_no", F.posexplode("edges").alias("edge_no", "edge"))
        .filter("edge.node is not null")
        .select(F.struct("subtype_no", "page_no", "edge_no").alias("system_no"), "edge.node.*")
    )


def source_systems(pages: DataFrame, source: str, max_pages: int = 3) -> DataFrame:
    """Systems of one source from captured pages (source, subtype_no, page_no, body).

    A country that is asked by subtype has a capture for each of ``SUBTYPES``, in this order; another
    subtype's pages are not read, and one that fails gives nothing while the others stay. Any other has
    one capture, that of the frequency range.
    """
    captures = len(SUBTYPES) if source in SUBTYPE_SOURCES else 1
    return page_systems(pages.filter((F.col("source") == source) & F.col("subtype_no").between(0, captures - 1)), max_pages)


def asked_for(systems: DataFrame, source: str) -> DataFrame:
    """What a source is asked for, from a whole export: certain subtypes, or systems with a device in the range."""
    if source in SUBTYPE_SOURCES:
        return systems.filter(F.col("licence.subtype").isin(*SUBTYPES))
    low, high = RANGE_MHZ
    return systems.filter(F.exists("devices", lambda d: text.as_float(d["frequency"]).between(float(low), float(high))))


def explode_devices(systems: DataFrame, source_no: int = 0) -> DataFrame:
    """One row for each device of (system_no, devices, licence), numbers and geometry parsed.

    A null or empty list of devices gives no row, a null licence or location empty fields. Devices are
    parsed before they are exploded: what follows then refers to finished columns, where the optimizer
    would otherwise repeat the parsers in every filter.
    """

    def parsed(device: Column) -> Column:
        place = device["location"]
        return F.struct(
            F.coalesce(device["callsign"], F.lit("")).alias("callsign"),
            F.coalesce(place["name"], F.lit("")).alias("name"),
            F.coalesce(place["state"], F.lit("")).alias("state"),
            text.as_float(device["frequency"]).alias("freq"),
            text.geometry(F.coalesce(place["geom"]["string"], place["geom"]["wkt"])).alias("at"),
            device["antennaHeight"].alias("height_m"),
            text.as_float(device["eirp"]).alias("eirp_w"),
            text.as_float(device["transmitPower"]).alias("transmit_w"),
            device["antenna"]["gain"].alias("gain_dbi"),
        )

    return systems.select("system_no", "licence", F.posexplode(F.transform("devices", parsed)).alias("device_no", "d")).select(
        F.struct(F.lit(source_no).alias("source_no"), "system_no", "device_no").alias("ord"),
        "d.callsign",
        "d.name",
        "d.state",
        "d.freq",
        F.col("d.at.lat").alias("lat"),
        F.col("d.at.lon").alias("lon"),
        "d.height_m",
        "d.eirp_w",
        "d.transmit_w",
        "d.gain_dbi",
        F.coalesce("licence.type", F.lit("")).alias("licence_type"),
        F.coalesce("licence.subtype", F.lit("")).alias("licence_subtype"),
    )
