"""From requests to answers in one call: the source of each place, its transmitters, ranks, elevations, documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import enrich, ranking, region
from .config import RankingConfig

SOURCES = ("us", "au", "ca")


def with_source(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """Requests (receiver_id, rx_lat, rx_lon[, source, ...]) with their source: as asked, or for null and ``auto`` by their place.

    A place in no known country counts as the United States. A source that there is none of fails the query.
    """
    asked = F.lower("source") if "source" in requests.columns else F.lit("auto")
    placed = region.classify(requests.withColumn("asked", F.coalesce(asked, F.lit("auto"))), edges, "rx_lon", "rx_lat")
    chosen = F.when(F.col("asked") == "auto", region.source_of(F.col("region"))).when(F.col("asked").isin(*SOURCES), F.col("asked"))
    wrong = F.raise_error(F.concat(F.lit("no such source: "), "asked"))
    return placed.withColumn("source", F.coalesce(chosen, wrong.cast("string"))).drop("asked", "region")


def find_towers(
    requests: DataFrame,
    edges: DataFrame,
    devices: Mapping[str, DataFrame],
    config: RankingConfig,
    elevations: DataFrame | None = None,
    measurements: DataFrame | Sequence[dict] | None = None,
    most_rows: int | None = None,
    typical_km: float | None = None,
) -> DataFrame:
    """(receiver_id, source, document): the answer to each request.

    ``requests``: (receiver_id, rx_lat, rx_lon[, radius_km, max_rows, altitude_m, source]); ``edges`` of the countries' borders;
    ``devices``: for each of ``SOURCES`` its device rows (one that is missing has none); ``elevations``: (lat6, lon6,
    elevation_m). A receiver whose altitude is 0 or missing has its place's elevation, if there is one. A source's
    receivers only meet its own devices; whoever has no towers gets an empty list. ``typical_km`` and ``most_rows`` as in ``rank_towers``.
    """
    asked = ranking.with_defaults(with_source(requests, edges), config)
    if "altitude_m" not in asked.columns:
        asked = asked.withColumn("altitude_m", F.lit(0.0))
    if elevations is not None:
        here = elevations.select(F.col("lat6").alias("_lat"), F.col("lon6").alias("_lon"), F.col("elevation_m").alias("_ground"))
        asked = asked.join(here, (F.bround("rx_lat", 6) == F.col("_lat")) & (F.bround("rx_lon", 6) == F.col("_lon")), "left")
        asked = asked.withColumn("altitude_m", F.coalesce(F.when(F.col("altitude_m") != 0, F.col("altitude_m")), "_ground", F.lit(0.0))).drop("_lat", "_lon", "_ground")
    columns = ("receiver_id", "rx_lat", "rx_lon", "radius_km", "max_rows")
    if ranking.in_stages(asked, most_rows):
        every = reduce(DataFrame.unionByName, [devices[s].withColumn("source", F.lit(s)) for s in SOURCES if s in devices])
        towers = ranking.ranked_in_stages(every, asked.select(*columns, "source"), config, most_rows, measurements, typical_km, ["source"])
    else:
        found = [ranking.rank_towers(devices[s], asked.filter(F.col("source") == s).select(*columns), config, measurements, typical_km, most_rows) for s in SOURCES if s in devices]
        towers = reduce(DataFrame.unionByName, found)
    if elevations is not None:
        towers = enrich.add_elevations(towers, elevations)
    documents = enrich.result_documents(towers, asked, F.col("source"))
    return documents.join(asked.select("receiver_id", "source"), "receiver_id").select("receiver_id", "source", "document")
