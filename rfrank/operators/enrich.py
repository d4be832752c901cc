"""Elevations of ranked towers, summaries of measurements, and result documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def elevation_table(raw: DataFrame) -> DataFrame:
    """(lat6, lon6, elevation_m): one row for each place of (lat, lon, elevation_m), null elevations left out."""
    return (
        raw.filter("elevation_m is not null")
        .select(F.bround("lat", 6).alias("lat6"), F.bround("lon", 6).alias("lon6"), "elevation_m")
        .groupBy("lat6", "lon6")
        .agg(F.min("elevation_m").alias("elevation_m"))
    )


def altitude(elevation: Column, height: Column) -> Column:
    return F.bround(elevation + F.coalesce(height, F.lit(0.0)), 1)


def add_elevations(towers: DataFrame, elevations: DataFrame) -> DataFrame:
    """Left join on the rounded place; a place without an elevation gives nulls."""
    at = elevations.withColumnsRenamed({"lat6": "latitude", "lon6": "longitude", "elevation_m": "raw_elevation"})
    found = towers.join(at, ["latitude", "longitude"], "left")
    elevation = F.bround("raw_elevation", 1)
    return found.withColumns({"elevation_m": elevation, "altitude_m": altitude(elevation, F.col("antenna_height_m"))}).drop("raw_elevation")


def band_counts(measurements: DataFrame) -> DataFrame:
    return measurements.groupBy("band").agg(F.count(F.lit(1)).alias("n_signals"))


def strongest_by_band(measurements: DataFrame) -> DataFrame:
    """The best-scored measurement of each band, the first of equals."""
    best = F.min(F.struct((-F.col("score")).alias("less"), "ordinal", "freq_mhz")).alias("best")
    return measurements.groupBy("band").agg(F.count(F.lit(1)).alias("n_signals"), best).select(
        "band", "n_signals", F.col("best.freq_mhz").alias("freq_mhz"), (-F.col("best.less")).alias("score")
    )


def band_cube(towers: DataFrame) -> DataFrame:
    """(band, distance_class, n_towers, strongest_dbm) of every band, every class, both and all: ``all`` where a column is summed over.

    One pass over the towers; every one of them counts in four groups, combined before the shuffle.
    """

    def label(name: str) -> Column:
        return F.when(F.grouping(name) == 1, "all").otherwise(F.col(name)).alias(name)

    cubed = towers.cube("band", "distance_class").agg(
        label("band").alias("b"), label("distance_class").alias("c"), F.count(F.lit(1)).alias("n_towers"), F.max("received_power_dbm").alias("strongest_dbm")
    )
    return cubed.select(F.col("b").alias("band"), F.col("c").alias("distance_class"), "n_towers", "strongest_dbm")


def result_documents(towers: DataFrame, receivers: DataFrame, source: Column | str = "us") -> DataFrame:
    """(receiver_id, document): for each receiver a JSON answer of its towers by rank, the query, and the count.

    ``receivers`` (receiver_id, rx_lat, rx_lon, radius_km[, altitude_m]) are what was asked; one without towers
    gets an empty list. Fields without a value are null in the document. A list has at most the rows that were
    asked for.
    """
    fields = [c for c in towers.columns if c != "receiver_id"]
    listed = F.struct("rank", *[c for c in fields if c != "rank"])
    found = towers.groupBy("receiver_id").agg(F.array_sort(F.collect_list(listed)).alias("towers"))
    altitude_m = F.col("altitude_m") if "altitude_m" in receivers.columns else F.lit(0.0)
    asked = F.struct(
        F.col("rx_lat").alias("latitude"), F.col("rx_lon").alias("longitude"), altitude_m.alias("altitude_m"), "radius_km",
        (F.lit(source) if isinstance(source, str) else source).alias("source"),
    )
    both = receivers.select("receiver_id", asked.alias("query")).join(found, "receiver_id", "left")
    towers_ = F.coalesce("towers", F.array().cast(found.schema["towers"].dataType))
    document = F.struct(towers_.alias("towers"), "query", F.size(towers_).alias("count"))
    return both.select("receiver_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def write_captures(systems: DataFrame, ranked: DataFrame, folder: str) -> None:
    """Keep raw systems and the towers ranked from them as JSON lines, in ``folder``/raw and /matched.

    ``read_systems`` reads the raw ones back, in the order of ``system_no``.
    """
    systems.repartitionByRange("system_no").sortWithinPartitions("system_no").select("id", "devices", "licence").write.json(f"{folder}/raw", ignoreNullFields=False)
    ranked.write.json(f"{folder}/matched", ignoreNullFields=False)
