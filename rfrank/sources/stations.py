"""Pipe-delimited station lines, television and FM, as systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rf, text
from ..operators.region import MOST_STATES

MIN_FIELDS = 35


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as (line, ordinal); the ordinal orders lines within and across files.

    One file is split over many tasks, so a line's number in its file is not known; ordinals keep the
    order of a file's splits and of the lines in each.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return lines.withColumn("ordinal", F.monotonically_increasing_id())


def fields(lines: DataFrame) -> DataFrame:
    """Licensed stations' lines as arrays of trimmed fields."""
    return (
        lines.filter(F.col("line").startswith("|"))
        .withColumn("f", F.transform(F.split("line", r"\|", -1), lambda x: F.trim(x)))
        .filter((F.size("f") >= MIN_FIELDS) & (F.get("f", F.lit(9)) == "LIC"))
        .drop("line")
    )


def _at(i: int) -> Column:
    return F.get(F.col("f"), F.lit(i))


def _stations(lines: DataFrame, mhz: Column, subtype: str, ident: Column) -> DataFrame:
    """Stations of lines. They are parsed inside a list of one, since a filter would repeat the parsers below what it tests."""
    kw = rf.erp_kw(_at(14))
    parsed = F.struct(
        _at(1).alias("callsign"),
        _at(3).alias("service"),
        mhz.alias("mhz"),
        ident.alias("id"),
        F.when(kw > 0, rf.watts(rf.erp_to_eirp_dbm(kw))).alias("eirp_w"),
        text.number(_at(16)).alias("height_m"),
        text.degrees_of(_at(20), _at(21), _at(22), _at(19), "S").alias("lat"),
        text.degrees_of(_at(24), _at(25), _at(26), _at(23), "W").alias("lon"),
        F.concat(text.title(_at(10)), F.lit(", "), _at(11)).alias("name"),
        _at(11).alias("state"),
    )
    return (
        fields(lines)
        .select(*[c for c in lines.columns if c != "line"], F.explode(F.array(parsed)).alias("s"))
        .select(*[c for c in lines.columns if c != "line"], "s.*")
        .filter("mhz is not null and lat is not null and lon is not null")
        .withColumn("licence_type", F.lit("Broadcasting"))
        .withColumn("licence_subtype", F.lit(subtype))
    )


def tv_stations(lines: DataFrame) -> DataFrame:
    """Licensed television stations of (line, ...): one row each, with coordinates and power as numbers."""
    channel = _at(4).try_cast("int")
    return _stations(lines, rf.channel_mhz(channel), "Television", F.concat_ws("-", F.lit("fcc-tv"), _at(1), channel.cast("string")))


def fm_stations(lines: DataFrame) -> DataFrame:
    """Licensed FM stations of (line, ...)."""
    mhz = F.regexp_extract(_at(2), r"([\d.]+)\s*MHz", 1).try_cast("double")
    return _stations(lines, mhz, "FM Radio", F.concat_ws("-", F.lit("fcc-fm"), _at(1), mhz.cast("string")))


def all_stations(tv: DataFrame, fm: DataFrame) -> DataFrame:
    """Television before FM, by ``source_no``."""
    return tv_stations(tv).withColumn("source_no", F.lit(0)).unionByName(fm_stations(fm).withColumn("source_no", F.lit(1)))


def as_devices(stations: DataFrame) -> DataFrame:
    """Stations as the device rows that a ranking takes."""
    return stations.select(
        F.struct(F.col("source_no"), F.col("ordinal").alias("system_no"), F.lit(0).alias("device_no")).alias("ord"),
        "callsign",
        "name",
        "state",
        F.col("mhz").alias("freq"),
        "lat",
        "lon",
        "height_m",
        "eirp_w",
        F.lit(None).cast("double").alias("transmit_w"),
        F.lit(None).cast("double").alias("gain_dbi"),
        "licence_type",
        "licence_subtype",
    )


# By state: the service answers a state at a time, and a receiver needs the few around it.


def write_states(lines: DataFrame, folder: str) -> None:
    """Keep lines (line, ordinal) in a folder for each state that they name, in order of ordinal. Lines without one are no stations'."""
    state = F.trim(F.get(F.split("line", r"\|", -1), F.lit(11)))
    kept = lines.filter(F.col("line").startswith("|")).select("line", "ordinal", state.alias("state")).filter("state != ''")
    # Salted, so that a state with a third of all lines is written by several tasks; each of its files is in order.
    kept.repartition("state", F.pmod(F.xxhash64("ordinal"), F.lit(8))).sortWithinPartitions("state", "ordinal").write.partitionBy("state").parquet(folder)


def read_states(spark: SparkSession, folder: str) -> DataFrame:
    """(line, ordinal, state) of what ``write_states`` wrote. A file that cannot be read is skipped; ``unanswered`` tells of it."""
    return spark.read.schema("line string, ordinal long, state string").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(folder)


def near_states(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lines of the states that ``wanted`` (state, state_no, ...) names, such as ``nearby_states`` gives.

    There are at most as many different states as are known, some fifty, so they are broadcast; other states' folders
    are pruned at run time and never listed for reading.
    """
    states = wanted.filter(F.col("state_no") <= MOST_STATES).select("state").distinct()
    return lines.join(F.broadcast(states), "state", "left_semi")


def unanswered(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(state): wanted states of which no line was read, failed ones and empty ones."""
    states = wanted.select("state").distinct()
    return states.join(near_states(lines, wanted).select("state").distinct(), "state", "left_anti")
