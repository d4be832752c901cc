"""Country borders from GeoJSON, and points in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of countries in border files.
ADMIN = {"United States of America": "us", "Canada": "ca", "Australia": "au"}


def read_borders(spark: SparkSession, path: str) -> DataFrame:
    """(region_no, region, rings) of a FeatureCollection, later features of a country overwriting earlier ones."""
    schema = "features array<struct<properties:struct<ADMIN:string>,geometry:struct<type:string,coordinates:string>>>"
    features = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("features").alias("no", "f"))
    region = F.lit(None).cast("string")
    for name, code in ADMIN.items():
        region = F.when(F.col("f.properties.ADMIN") == name, F.lit(code)).otherwise(region)
    polygon = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    several = F.flatten(F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>"))
    found = features.withColumn("region", region).filter("region is not null")
    found = found.withColumn("rings", F.when(F.col("f.geometry.type") == "MultiPolygon", several).otherwise(polygon))
    return found.groupBy("region").agg(F.min("no").alias("region_no"), F.max_by("rings", "no").alias("rings"))


def edges(regions: DataFrame) -> DataFrame:
    """(region_no, region, edge_no, x1, y1, x2, y2) of (region_no, region, rings)."""
    ring = F.col("ring")
    closed = F.transform(F.sequence(F.lit(0), F.size(ring) - 1), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, (i + 1) % F.size(ring)).alias("b")))
    return (
        regions.select("region_no", "region", F.posexplode("rings").alias("ring_no", "ring"))
        .filter(F.size("ring") > 1)
        .select("region_no", "region", "ring_no", F.posexplode(closed).alias("edge_no", "e"))
        .select(
            "region_no", "region", "ring_no", "edge_no",
            F.get("e.a", F.lit(0)).alias("x1"), F.get("e.a", F.lit(1)).alias("y1"), F.get("e.b", F.lit(0)).alias("x2"), F.get("e.b", F.lit(1)).alias("y2"),
        )
        .filter("x1 != x2 or y1 != y2")
    )
