"""The registered queries of the ranking engine, and SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo, rf, text
from .functions.sql import register
from .operators import enrich, match, ranking, region
from .plans import answer
from .plans.config import RankingConfig
from .shared import shared_dir
from .sources import derived, elevations, paged, regions, stations, sweep, systems
from .streaming import feed
from .streaming import sweep as stream

CONFIG = RankingConfig.default()
BY_POWER = RankingConfig.from_dict({**CONFIG.to_dict(), "ranking": {**CONFIG.to_dict()["ranking"], "sort_order": [
    {"field": "band_priority", "ascending": True}, {"field": "distance_priority", "ascending": True}, {"field": "received_power_dbm", "ascending": False},
]}})
DEAF = RankingConfig.from_dict({**CONFIG.to_dict(), "receiver": {"rx_antenna_gain_dbi": 6.0, "sensitivity_dbm": -60.0}})

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# The SQL's common tables -----------------------------------------------------------------------------

D = """d AS (
  SELECT p_partkey AS k, 'W' || (p_partkey % 100)::VARCHAR AS callsign, p_name AS name, 'S' || (p_partkey % 50)::VARCHAR AS state,
         (CASE WHEN p_partkey % 8 <= 2 THEN 879 + 4 * (p_partkey % 51) WHEN p_partkey % 8 <= 4 THEN 1770 + 60 * (p_partkey % 7)
               WHEN p_partkey % 8 <= 6 THEN 4730 + 120 * (p_partkey % 12) ELSE 3000 END)::DOUBLE / 10 AS freq,
         (CASE WHEN p_partkey % 3 = 0 THEN 348526 + 10 * ((7919 * p_partkey) % 2001 - 1000) ELSE 250000 + (7919 * p_partkey) % 240001 END)::DOUBLE / 10000 AS lat,
         (CASE WHEN p_partkey % 3 = 0 THEN -823940 + 10 * ((104729 * p_partkey) % 2001 - 1000) ELSE -1240000 + (104729 * p_partkey) % 570001 END)::DOUBLE / 10000 AS lon,
         (p_partkey % 300)::DOUBLE AS height_m,
         CASE WHEN p_partkey % 6 <> 0 THEN p_retailprice END AS eirp_w,
         CASE WHEN p_partkey % 12 <> 0 THEN p_size * 0.001::DOUBLE END AS transmit_w
  FROM part
), b AS (
  SELECT *, CASE WHEN freq BETWEEN 87.8::DOUBLE AND 108 THEN 'FM' WHEN freq BETWEEN 174 AND 216 THEN 'VHF' WHEN freq BETWEEN 470 AND 608 THEN 'UHF' END AS band,
         CASE WHEN freq BETWEEN 87.8::DOUBLE AND 108 THEN 0.15::DOUBLE ELSE 4.0::DOUBLE END AS tol
  FROM d
)"""
M = """m AS (
  SELECT event_id AS ordinal,
         (CASE event_id % 3 WHEN 0 THEN 87900 + (37 * event_id) % 12001 WHEN 1 THEN 174000 + (53 * event_id) % 20001 ELSE 470000 + (71 * event_id) % 60001 END)::DOUBLE / 1000 AS freq_mhz,
         (event_id % 60)::DOUBLE AS snr_db, (event_id % 100)::DOUBLE / 100 AS obw_fraction, least(value / 500, 1.0::DOUBLE) AS score,
         (-(event_id % 90))::DOUBLE AS power_db, CASE event_id % 3 WHEN 0 THEN 'FM' WHEN 1 THEN 'VHF' ELSE 'UHF' END AS band
  FROM events
)"""
ONE = "r AS (SELECT 1 AS receiver_id, 34.8526::DOUBLE AS rx_lat, -82.394::DOUBLE AS rx_lon, 80.0::DOUBLE AS radius_km, 100 AS max_rows)"
MANY = """r AS (
  SELECT s_suppkey AS receiver_id,
         (CASE WHEN s_suppkey % 3 = 0 THEN 348526 + 10 * ((7919 * s_suppkey) % 2001 - 1000) ELSE 250000 + (7919 * s_suppkey) % 240001 END)::DOUBLE / 10000 AS rx_lat,
         (CASE WHEN s_suppkey % 3 = 0 THEN -823940 + 10 * ((104729 * s_suppkey) % 2001 - 1000) ELSE -1240000 + (104729 * s_suppkey) % 570001 END)::DOUBLE / 10000 AS rx_lon,
         (20 + s_suppkey % 30)::DOUBLE AS radius_km, 5 + s_suppkey % 7 AS max_rows
  FROM supplier
)"""
HAVERSINE = (
    "6371.0::DOUBLE * 2 * atan2(sqrt(pow(sin((radians(lat) - radians(rx_lat)) / 2), 2) + cos(radians(rx_lat)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(rx_lon)) / 2), 2)),"
    " sqrt(1 - (pow(sin((radians(lat) - radians(rx_lat)) / 2), 2) + cos(radians(rx_lat)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(rx_lon)) / 2), 2))))"
)
BEARING = (
    "(degrees(atan2(sin(radians(lon - rx_lon)) * cos(radians(lat)), cos(radians(rx_lat)) * sin(radians(lat)) - sin(radians(rx_lat)) * cos(radians(lat)) * cos(radians(lon - rx_lon)))) + 360) % 360"
)
POINTS16 = "['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW']"
EIRP = """CASE WHEN eirp_w > 0 THEN 10 * log10(eirp_w) + 30 WHEN transmit_w > 0 THEN 10 * log10(transmit_w) + 30 + 10
          WHEN band = 'FM' THEN 50.0::DOUBLE ELSE 60.0::DOUBLE END"""
LOSS = "CASE WHEN dist <= 0 OR freq <= 0 THEN 0 ELSE 20 * log10(dist * 1000) + 20 * log10(freq * 1e6) - 147.55::DOUBLE END"
CLASS = "CASE WHEN dist < 0 THEN 'Far' WHEN dist < 8 THEN 'Too Close' WHEN dist < 30 THEN 'Ideal' WHEN dist < 60 THEN 'Good' ELSE 'Far' END"
NO_MATCH = "x AS (SELECT *, false AS hit, NULL::DOUBLE AS snr_db, NULL::DOUBLE AS score, NULL::DOUBLE AS power_db, NULL::DOUBLE AS obw_fraction FROM p)"
MATCH = """n AS (
  SELECT f.freq, f.tol, m.snr_db, m.score, m.power_db, m.obw_fraction,
         row_number() OVER (PARTITION BY f.freq, f.tol ORDER BY abs(m.freq_mhz - f.freq), m.ordinal) AS nth
  FROM (SELECT DISTINCT freq, tol FROM p) f JOIN m ON abs(m.freq_mhz - f.freq) <= f.tol
), x AS (
  SELECT p.*, n.freq IS NOT NULL AS hit, n.snr_db, n.score, n.power_db, n.obw_fraction
  FROM p LEFT JOIN n ON n.freq = p.freq AND n.tol = p.tol AND n.nth = 1
)"""


def pairs_sql(receivers: str = ONE, sensitivity: float = -120.0) -> str:
    return f"""{D}, {receivers}, g AS (
  SELECT b.*, r.*, {HAVERSINE} AS dist, {BEARING} AS bearing FROM b, r WHERE band IS NOT NULL
), h AS (SELECT *, {EIRP} AS eirp FROM g WHERE dist <= radius_km
), p AS (SELECT * FROM (SELECT *, eirp + 6 - ({LOSS}) AS power FROM h) WHERE power >= {sensitivity})"""


def towers_sql(receivers: str = ONE, sensitivity: float = -120.0, matched: bool = False) -> str:
    """CTEs up to u: projected, rounded, deduplicated towers with the key's first appearance."""
    return f"""{pairs_sql(receivers, sensitivity)}{', ' + M if matched else ''}, {MATCH if matched else NO_MATCH}, t AS (
  SELECT receiver_id, max_rows, k, callsign, name, state, round_even(freq, 3) AS frequency_mhz, band, round_even(lat, 6) AS latitude, round_even(lon, 6) AS longitude,
         height_m AS antenna_height_m, round_even(dist, 1) AS distance_km, round_even(bearing, 1) AS bearing_deg,
         {POINTS16}[(round_even(bearing / 22.5, 0)::INT % 16) + 1] AS bearing_cardinal, round_even(power, 1) AS received_power_dbm, {CLASS} AS distance_class,
         round_even(eirp, 1) AS eirp_dbm, 'Broadcasting' AS licence_type, CASE WHEN k % 2 = 0 THEN 'Television' ELSE 'FM Radio' END AS licence_subtype,
         hit AS frequency_matched, hit AS measured, snr_db, score, power_db, obw_fraction
  FROM x
), u AS (
  SELECT * EXCLUDE (nth) FROM (
    SELECT *, row_number() OVER (PARTITION BY receiver_id, callsign, frequency_mhz ORDER BY received_power_dbm DESC, k) AS nth,
           min(k) OVER (PARTITION BY receiver_id, callsign, frequency_mhz) AS first_k
    FROM t) WHERE nth = 1
)"""


PRIORITY = "CASE band WHEN 'VHF' THEN 0 WHEN 'UHF' THEN 1 ELSE 2 END"
BY_SCORE = f"{PRIORITY}, coalesce(score, 0) DESC, first_k"
BY_POWER_SQL = f"{PRIORITY}, CASE distance_class WHEN 'Ideal' THEN 0 WHEN 'Good' THEN 1 WHEN 'Far' THEN 2 ELSE 3 END, received_power_dbm DESC, first_k"


def ranked_sql(receivers: str = ONE, sensitivity: float = -120.0, matched: bool = False, order: str = BY_SCORE, columns: str = "* EXCLUDE (max_rows, k, first_k)") -> str:
    where = "WHERE frequency_matched" if matched else ""
    return f"""WITH {towers_sql(receivers, sensitivity, matched)}, v AS (
  SELECT *, row_number() OVER (PARTITION BY receiver_id ORDER BY {order})::INT AS rank FROM u {where}
) SELECT {columns} FROM v WHERE rank <= max_rows"""


def _candidates(spark: SparkSession, sf_dir: str, config: RankingConfig = CONFIG) -> DataFrame:
    return ranking.candidates(derived.devices(spark, sf_dir), derived.receiver(spark), config)


def _unique_towers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.keep_strongest(ranking.project(match.match_values(_candidates(spark, sf_dir), []), CONFIG))


# Ranking ---------------------------------------------------------------------------------------------


@query("rank_default", ranked_sql())
def rank_default(spark, sf_dir):
    return ranking.rank_towers(derived.devices(spark, sf_dir), derived.receiver(spark), CONFIG)


@query("rank_measured", ranked_sql(matched=True))
def rank_measured(spark, sf_dir):
    return ranking.rank_towers(derived.devices(spark, sf_dir), derived.receiver(spark), CONFIG, derived.measurements(spark, sf_dir))


@query("rank_by_power", ranked_sql(order=BY_POWER_SQL))
def rank_by_power(spark, sf_dir):
    return ranking.rank_towers(derived.devices(spark, sf_dir), derived.receiver(spark), BY_POWER)


@query("rank_receivers", ranked_sql(MANY, matched=True, order=BY_POWER_SQL))
def rank_receivers(spark, sf_dir):
    """Every receiver at once."""
    return ranking.rank_towers(derived.devices(spark, sf_dir, dealt=True), derived.receivers(spark, sf_dir), BY_POWER, derived.measurements(spark, sf_dir), typical_km=35.0, most_rows=11)


OWN = """mo AS (SELECT m.*, m.ordinal % (SELECT count(*) FROM supplier) + 1 AS sender FROM m), n AS (
  SELECT f.receiver_id AS rid, f.freq, f.tol, mo.snr_db, mo.score, mo.power_db, mo.obw_fraction,
         row_number() OVER (PARTITION BY f.receiver_id, f.freq, f.tol ORDER BY abs(mo.freq_mhz - f.freq), mo.ordinal) AS nth
  FROM (SELECT DISTINCT receiver_id, freq, tol FROM p WHERE receiver_id % 5 <> 0) f JOIN mo ON mo.sender = f.receiver_id AND abs(mo.freq_mhz - f.freq) <= f.tol
), x AS (
  SELECT p.*, n.freq IS NOT NULL AS hit, n.snr_db, n.score, n.power_db, n.obw_fraction
  FROM p LEFT JOIN n ON n.rid = p.receiver_id AND n.freq = p.freq AND n.tol = p.tol AND n.nth = 1
)"""


@query("rank_requests", ranked_sql(MANY, matched=True, order=BY_POWER_SQL).replace(MATCH, OWN).replace("WHERE frequency_matched", "WHERE frequency_matched OR receiver_id % 5 = 0"))
def rank_requests(spark, sf_dir):
    """Every receiver at once, each with the measurements that it sent itself, some with none."""
    receivers = derived.receivers(spark, sf_dir)
    sender = F.col("ordinal") % F.lit(spark.read.parquet(f"{sf_dir}/supplier.parquet").count()) + 1
    lists = match.as_lists(derived.measurements(spark, sf_dir).withColumn("receiver_id", sender))
    requests = receivers.join(lists.filter("receiver_id % 5 <> 0"), "receiver_id", "left")
    return ranking.rank_requests(derived.devices(spark, sf_dir, dealt=True), requests, BY_POWER, typical_km=35.0, most_rows=11)


@query("top_k", ranked_sql(columns="callsign, frequency_mhz, rank").replace("rank <= max_rows", "rank <= 10"))
def top_k(spark, sf_dir):
    few = derived.receiver(spark).withColumn("max_rows", F.lit(10))
    return ranking.rank_towers(derived.devices(spark, sf_dir), few, CONFIG, most_rows=10).select("callsign", "frequency_mhz", "rank")


@query("dedup_strongest", f"WITH {towers_sql()} SELECT callsign, frequency_mhz, received_power_dbm, k AS kept_k, first_k FROM u")
def dedup_strongest(spark, sf_dir):
    return _unique_towers(spark, sf_dir).select("callsign", "frequency_mhz", "received_power_dbm", F.col("ord.system_no").alias("kept_k"), F.col("first_ord.system_no").alias("first_k"))


@query("project_tower", f"WITH {towers_sql()} SELECT * EXCLUDE (receiver_id, max_rows) FROM t")
def project_tower(spark, sf_dir):
    found = ranking.project(match.match_values(_candidates(spark, sf_dir), []), CONFIG)
    return found.withColumn("k", F.col("ord.system_no")).drop("ord", "receiver_id", "max_rows")


@query(
    "result_json",
    f"WITH {MANY}, z AS ({ranked_sql(MANY, order=BY_POWER_SQL)}), g AS (SELECT receiver_id, count(*)::BIGINT AS n, string_agg(rank || ':' || callsign || ':' || band, ',' ORDER BY rank) AS listed,"
    " min_by(frequency_mhz, rank) AS first_mhz, max_by(received_power_dbm, rank) AS last_dbm, max_by(licence_subtype, rank) AS last_subtype, count(snr_db) AS n_snr FROM z GROUP BY receiver_id)"
    " SELECT receiver_id, coalesce(n, 0)::BIGINT AS n_towers, rx_lat AS latitude, rx_lon AS longitude, radius_km, 'us' AS source, coalesce(listed, '') AS listed, first_mhz, last_dbm, last_subtype,"
    " coalesce(n_snr, 0)::BIGINT AS n_snr FROM r LEFT JOIN g USING (receiver_id)",
)
def result_json(spark, sf_dir):
    """Answers as JSON documents, read back."""
    receivers = derived.receivers(spark, sf_dir)
    ranked = ranking.rank_towers(derived.devices(spark, sf_dir, dealt=True), receivers, BY_POWER, typical_km=35.0, most_rows=11)
    tower = "struct<rank:int,callsign:string,band:string,frequency_mhz:double,received_power_dbm:double,licence_subtype:string,snr_db:double>"
    document = f"struct<towers:array<{tower}>,query:struct<latitude:double,longitude:double,radius_km:double,source:string>,count:bigint>"
    made = enrich.result_documents(ranked, receivers).select("receiver_id", F.from_json("document", document).alias("d"))
    first, last = F.try_element_at("d.towers", F.lit(1)), F.try_element_at("d.towers", F.lit(-1))
    return made.select(
        "receiver_id",
        F.col("d.count").alias("n_towers"),
        "d.query.*",
        F.array_join(F.transform("d.towers", lambda t: F.concat_ws(":", t["rank"], t["callsign"], t["band"])), ",").alias("listed"),
        first["frequency_mhz"].alias("first_mhz"),
        last["received_power_dbm"].alias("last_dbm"),
        last["licence_subtype"].alias("last_subtype"),
        F.size(F.filter("d.towers", lambda t: t["snr_db"].isNotNull())).cast("long").alias("n_snr"),
    )


# Filters ---------------------------------------------------------------------------------------------


@query("explode_devices", f"WITH {D} SELECT k AS system_no, 0 AS device_no, callsign, freq, lat, lon, eirp_w, transmit_w FROM d")
def explode_devices(spark, sf_dir):
    return derived.devices(spark, sf_dir).select("ord.system_no", "ord.device_no", "callsign", "freq", "lat", "lon", "eirp_w", "transmit_w")


@query("filter_broadcast", f"WITH {D} SELECT k, freq, band FROM b WHERE band IS NOT NULL")
def filter_broadcast(spark, sf_dir):
    return ranking.in_broadcast_band(derived.devices(spark, sf_dir), CONFIG).select(F.col("ord.system_no").alias("k"), "freq", "band")


WKT_SQL = f"""WITH {D} SELECT k, round_even(lat6, 6) AS lat, round_even(lon6, 6) AS lon FROM (
  SELECT k, CASE WHEN k % 5 = 0 THEN (lat + lat + (lat + 1) + lat) / 4 WHEN k % 5 = 2 THEN (lat + (lat + 2)) / 2 WHEN k % 5 > 2 THEN lat END AS lat6,
         CASE WHEN k % 5 = 0 THEN (lon + (lon + 1) + (lon + 1) + lon) / 4 WHEN k % 5 = 2 THEN (lon + lon + (lon + 2)) / 3 WHEN k % 5 > 2 THEN lon END AS lon6 FROM d)"""


def _geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.wkts(spark, sf_dir).withColumn("at", text.geometry(F.col("wkt"))).select("k", F.bround("at.lat", 6).alias("lat"), F.bround("at.lon", 6).alias("lon"))


# In the polygon of the third kind a pair that is cut at its bad latitude still ends the ring there.
@query("filter_geom", WKT_SQL.replace("SELECT k, round_even(lat6, 6) AS lat, round_even(lon6, 6) AS lon FROM", "SELECT k FROM") + " WHERE lat6 IS NOT NULL")
def filter_geom(spark, sf_dir):
    return ranking.located(_geometries(spark, sf_dir)).select("k")


@query("geom_centroid", WKT_SQL.replace("WHEN k % 5 = 2 THEN (lat + (lat + 2)) / 2", "WHEN k % 5 = 2 THEN lat").replace("WHEN k % 5 = 2 THEN (lon + lon + (lon + 2)) / 3", "WHEN k % 5 = 2 THEN (lon + lon) / 2") + " WHERE k % 5 IN (0, 2)")
def geom_centroid(spark, sf_dir):
    return _geometries(spark, sf_dir).filter("k % 5 in (0, 2)")


@query("fn_parse_point", WKT_SQL + " WHERE k % 5 NOT IN (0, 2)")
def fn_parse_point(spark, sf_dir):
    return derived.wkts(spark, sf_dir).filter("k % 5 not in (0, 2)").withColumn("at", text.point(F.col("wkt"))).select("k", F.bround("at.lat", 6).alias("lat"), F.bround("at.lon", 6).alias("lon"))


@query("radius_filter", f"WITH {pairs_sql()} SELECT k, round_even(dist, 1) AS distance_km FROM g WHERE dist <= radius_km")
def radius_filter(spark, sf_dir):
    found = ranking.located(ranking.in_broadcast_band(derived.devices(spark, sf_dir), CONFIG))
    return ranking.in_radius(found, ranking.with_defaults(derived.receiver(spark), CONFIG)).select(F.col("ord.system_no").alias("k"), F.bround("dist", 1).alias("distance_km"))


@query("sensitivity_filter", f"WITH {pairs_sql(sensitivity=-60.0)} SELECT k, round_even(power, 1) AS received_power_dbm FROM p")
def sensitivity_filter(spark, sf_dir):
    return _candidates(spark, sf_dir, DEAF).select(F.col("ord.system_no").alias("k"), F.bround("power", 1).alias("received_power_dbm"))


# Matching --------------------------------------------------------------------------------------------

NEAREST = f"""WITH {D}, {M}, n AS (
  SELECT k, m.ordinal, row_number() OVER (PARTITION BY k ORDER BY abs(m.freq_mhz - b.freq), m.ordinal) AS nth
  FROM b JOIN m ON abs(m.freq_mhz - b.freq) <= b.tol WHERE b.band IS NOT NULL
) SELECT b.k, coalesce(n.ordinal, -1) AS ordinal FROM b LEFT JOIN n ON n.k = b.k AND n.nth = 1 WHERE b.band IS NOT NULL"""


@query("match_nearest", NEAREST)
def match_nearest(spark, sf_dir):
    """The nearest for each frequency and band, as a ranking takes it, and the devices tuned to these."""
    devices = derived.devices(spark, sf_dir)
    nearest = match.nearest(ranking.tuned(devices, CONFIG), derived.measurements(spark, sf_dir))
    found = ranking.in_broadcast_band(devices, CONFIG).join(nearest, ["freq", "band"], "left")
    return found.select(F.col("ord.system_no").alias("k"), F.coalesce("m.ordinal", F.lit(-1)).alias("ordinal"))


@query("match_nearest_bins", NEAREST)
def match_nearest_bins(spark, sf_dir):
    found = ranking.in_broadcast_band(derived.devices(spark, sf_dir), CONFIG)
    return match.match_nearest(found, derived.measurements(spark, sf_dir)).select(F.col("ord.system_no").alias("k"), F.coalesce("m.ordinal", F.lit(-1)).alias("ordinal"))


TOL = "CASE WHEN m.band = 'FM' THEN 0.15::DOUBLE ELSE 4.0::DOUBLE END"


@query("match_semi", f"WITH {towers_sql()}, {M} SELECT callsign, frequency_mhz, band FROM u WHERE EXISTS (SELECT 1 FROM m WHERE m.band = u.band AND abs(m.freq_mhz - u.frequency_mhz) <= {TOL})")
def match_semi(spark, sf_dir):
    return match.supported(_unique_towers(spark, sf_dir), derived.measurements(spark, sf_dir)).select("callsign", "frequency_mhz", "band")


@query("match_anti", f"WITH {towers_sql()}, {M} SELECT ordinal, freq_mhz, band FROM m WHERE NOT EXISTS (SELECT 1 FROM u WHERE m.band = u.band AND abs(m.freq_mhz - u.frequency_mhz) <= {TOL})")
def match_anti(spark, sf_dir):
    return match.unmatched(_unique_towers(spark, sf_dir), derived.measurements(spark, sf_dir)).select("ordinal", "freq_mhz", "band")


@query(
    "match_recall",
    f"WITH z AS ({ranked_sql(matched=True)}), {M} SELECT (SELECT count(*) FROM z WHERE frequency_matched)::BIGINT AS n_matched, count(*)::BIGINT AS n_signals,"
    " CASE WHEN count(*) = 0 THEN 0 ELSE (SELECT count(*) FROM z WHERE frequency_matched)::DOUBLE / count(*) END AS recall FROM m",
)
def match_recall(spark, sf_dir):
    return match.recall(rank_measured(spark, sf_dir), derived.measurements(spark, sf_dir))


@query("band_counts", f"WITH {M} SELECT band, count(*)::BIGINT AS n_signals FROM m GROUP BY band")
def band_counts(spark, sf_dir):
    return enrich.band_counts(derived.measurements(spark, sf_dir))


@query("band_strongest", f"WITH {M} SELECT band, n_signals, freq_mhz, score FROM (SELECT *, count(*) OVER (PARTITION BY band) AS n_signals, row_number() OVER (PARTITION BY band ORDER BY score DESC, ordinal) AS nth FROM m) WHERE nth = 1")
def band_strongest(spark, sf_dir):
    return enrich.strongest_by_band(derived.measurements(spark, sf_dir))


# Sweeps ----------------------------------------------------------------------------------------------

S = """s AS (
  SELECT event_id AS ordinal, 0 AS channel_no, (879 + 2 * (event_id % 100))::DOUBLE / 10 AS freq_mhz, 'FM' AS band, (event_id % 60) + 0.5::DOUBLE AS snr_db,
         0.25::DOUBLE AS obw_fraction, (event_id % 101)::DOUBLE / 100 AS score, NULL::DOUBLE AS power_db
  FROM events WHERE event_id % 13 <> 0 AND event_id % 11 <> 0
  UNION ALL
  SELECT event_id, 1, (473 + 6 * (event_id % 20))::DOUBLE, CASE event_id % 3 WHEN 0 THEN 'UHF' ELSE 'VHF' END, NULL, NULL, (event_id % 97)::DOUBLE / 100, -(event_id % 90)::DOUBLE
  FROM events WHERE event_id % 13 <> 0 AND event_id % 11 <> 0 AND event_id % 3 <> 2
)"""
BEST = """SELECT freq_mhz, band, snr_db, obw_fraction, score, power_db FROM (
  SELECT *, row_number() OVER (PARTITION BY freq_mhz, band ORDER BY score DESC, ordinal, channel_no) AS nth FROM s WHERE score > 0) WHERE nth = 1"""


@query("sweep_measurements", f"WITH {S} SELECT * FROM s WHERE score > 0")
def sweep_measurements(spark, sf_dir):
    return sweep.measurements(derived.sweep_lines(spark, sf_dir))


@query("sweep_gate", f"WITH {S} SELECT ordinal, channel_no, score FROM s WHERE score > 0.5::DOUBLE")
def sweep_gate(spark, sf_dir):
    return sweep.measurements(derived.sweep_lines(spark, sf_dir), 0.5).select("ordinal", "channel_no", "score")


@query("sweep_dedup", f"WITH {S} {BEST}")
def sweep_dedup(spark, sf_dir):
    return sweep.best_of(sweep.measurements(derived.sweep_lines(spark, sf_dir))).drop("first_ordinal", "first_channel")


@query("sweep_stream", f"WITH {S} {BEST}")
def sweep_stream(spark, sf_dir):
    """The same through a stream: events are written as files in their order, which the stream then finds; of equals the first stays."""
    folder = f"{shared_dir(spark)}/sweep-{uuid.uuid4().hex}"
    derived.sweep_lines(spark, sf_dir).repartitionByRange("ordinal").sortWithinPartitions("ordinal").select("line").write.text(f"{folder}/in")
    stream.start(stream.running_best(feed.read_feed(spark, f"{folder}/in")), f"{folder}/out", f"{folder}/state").awaitTermination()
    return stream.read_best(spark, f"{folder}/out").select("freq_mhz", "band", "snr_db", "obw_fraction", "score", "power_db")


# Station lines ---------------------------------------------------------------------------------------

TV = """tv AS (
  SELECT p_partkey AS ordinal, 'K' || (p_partkey % 900)::VARCHAR AS callsign, 'DT' || (p_partkey % 3)::VARCHAR AS service, p_partkey % 40 AS channel, p_size AS kw, p_partkey AS k
  FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 11 <> 0
), tvs AS (
  SELECT *, CASE channel WHEN 2 THEN 57.0 WHEN 3 THEN 63.0 WHEN 4 THEN 69.0 WHEN 5 THEN 79.0 WHEN 6 THEN 85.0
                 ELSE CASE WHEN channel BETWEEN 7 AND 13 THEN 177.0 + 6 * (channel - 7) WHEN channel BETWEEN 14 AND 36 THEN 473.0 + 6 * (channel - 14) END END::DOUBLE AS mhz,
         CASE WHEN k % 4 <> 0 THEN (k % 500)::DOUBLE END AS height_m,
         (CASE WHEN k % 9 = 0 THEN -1 ELSE 1 END) * ((k % 60) + (k % 59)::DOUBLE / 60 + ((k % 58) + 0.5::DOUBLE) / 3600) AS lat,
         (CASE WHEN k % 7 = 0 THEN 1 ELSE -1 END) * ((k % 170) + (k % 57)::DOUBLE / 60 + ((k % 56) + 0.25::DOUBLE) / 3600) AS lon,
         CASE WHEN kw > 0 THEN pow(10, (10 * log10(kw * 1000) + 2.15::DOUBLE) / 10) END AS eirp_w
  FROM tv
)"""
FM = """fms AS (
  SELECT s_suppkey AS ordinal, 'W' || s_suppkey::VARCHAR AS callsign, (87 + s_suppkey % 20)::DOUBLE + (s_suppkey % 10)::DOUBLE / 10 AS mhz0,
         ((87 + s_suppkey % 20)::VARCHAR || '.' || (s_suppkey % 10)::VARCHAR)::DOUBLE AS mhz, (s_suppkey % 300)::DOUBLE AS height_m,
         (s_suppkey % 60) + (s_suppkey % 59)::DOUBLE / 60 + 30::DOUBLE / 3600 AS lat,
         -((s_suppkey % 170) + (s_suppkey % 57)::DOUBLE / 60 + 6::DOUBLE / 3600) AS lon, 10 * log10(250) + 2.15::DOUBLE AS eirp_db
  FROM supplier WHERE s_suppkey % 6 <> 0
)"""


def _station_columns(found: DataFrame) -> DataFrame:
    return found.select(
        "ordinal", "callsign", "mhz", "height_m", F.bround("lat", 6).alias("lat"), F.bround("lon", 6).alias("lon"),
        F.bround(rf.dbm(F.col("eirp_w")), 3).alias("eirp_dbm"), "name", "licence_subtype", "id",
    )


TV_COLUMNS = """SELECT ordinal, callsign, mhz, height_m, round_even(lat, 6) AS lat, round_even(lon, 6) AS lon, round_even(10 * log10(eirp_w) + 30, 3) AS eirp_dbm,
  'Winston-Salem, NC' AS name, 'Television' AS licence_subtype, 'fcc-tv-' || callsign || '-' || channel::VARCHAR AS id FROM tvs WHERE mhz IS NOT NULL"""
FM_COLUMNS = """SELECT ordinal, callsign, mhz, height_m, round_even(lat, 6) AS lat, round_even(lon, 6) AS lon, round_even(eirp_db + 30, 3) AS eirp_dbm,
  'St. Mary''S, GA' AS name, 'FM Radio' AS licence_subtype, 'fcc-fm-' || callsign || '-' || mhz::VARCHAR AS id FROM fms"""


@query("scan_tv_lines", f"WITH {TV} {TV_COLUMNS}")
def scan_tv_lines(spark, sf_dir):
    return _station_columns(stations.tv_stations(derived.tv_lines(spark, sf_dir)))


@query("scan_fm_lines", f"WITH {FM} {FM_COLUMNS}")
def scan_fm_lines(spark, sf_dir):
    return _station_columns(stations.fm_stations(derived.fm_lines(spark, sf_dir)))


@query("scan_union", f"WITH {TV}, {FM} SELECT 0 AS source_no, ordinal, callsign, mhz FROM ({TV_COLUMNS}) UNION ALL SELECT 1, ordinal, callsign, mhz FROM ({FM_COLUMNS})")
def scan_union(spark, sf_dir):
    both = stations.all_stations(derived.tv_lines(spark, sf_dir), derived.fm_lines(spark, sf_dir))
    return both.select("source_no", "ordinal", "callsign", "mhz")


@query("filter_licensed", f"WITH {TV} SELECT ordinal FROM tv")
def filter_licensed(spark, sf_dir):
    return stations.fields(derived.tv_lines(spark, sf_dir)).select("ordinal")


@query("tv_channel_freq", f"WITH {TV} SELECT DISTINCT channel::INT AS channel, mhz FROM tvs WHERE mhz IS NOT NULL")
def tv_channel_freq(spark, sf_dir):
    channel = F.get("f", F.lit(4)).try_cast("int")
    found = stations.fields(derived.tv_lines(spark, sf_dir)).select(channel.alias("channel"))
    return found.withColumn("mhz", rf.channel_mhz(F.col("channel"))).filter("mhz is not null").distinct()


# Elevation and places --------------------------------------------------------------------------------

ELEVATION = """ev AS (
  SELECT round_even(lat, 6) AS lat6, round_even(lon, 6) AS lon6, min((k % 1000)::DOUBLE / 8) AS elevation_m FROM d WHERE k % 5 <> 0 AND k % 7 <> 0 GROUP BY ALL
)"""


@query("elevation_dim", f"WITH {D}, {ELEVATION} SELECT * FROM ev")
def elevation_dim(spark, sf_dir):
    return enrich.elevation_table(derived.elevations(spark, sf_dir))


@query(
    "enrich_elevation",
    f"WITH z AS ({ranked_sql()}), {D}, {ELEVATION} SELECT rank, callsign, latitude, longitude, round_even(ev.elevation_m, 1) AS elevation_m,"
    " round_even(round_even(ev.elevation_m, 1) + coalesce(antenna_height_m, 0), 1) AS altitude_m FROM z LEFT JOIN ev ON ev.lat6 = z.latitude AND ev.lon6 = z.longitude",
)
def enrich_elevation(spark, sf_dir):
    made = enrich.add_elevations(rank_default(spark, sf_dir), elevation_dim(spark, sf_dir))
    return made.select("rank", "callsign", "latitude", "longitude", "elevation_m", "altitude_m")


PT = """pt AS (
  SELECT c_custkey AS point_id, ((31 * c_custkey) % 341 - 170)::DOUBLE / 2 AS lat, ((97 * c_custkey) % 719 - 359)::DOUBLE / 2 AS lon FROM customer
)"""


@query(
    "region_edges",
    "WITH q AS (SELECT r_regionkey AS region_no, r_name AS region, (-170 + 70 * r_regionkey)::DOUBLE AS x FROM region), s AS ("
    " SELECT region_no, region, 0 AS ring_no, 0 AS edge_no, x AS x1, -40.0 AS y1, x + 60 AS x2, -40.0 AS y2 FROM q UNION ALL SELECT region_no, region, 0, 1, x + 60, -40, x + 60, 40 FROM q"
    " UNION ALL SELECT region_no, region, 0, 2, x + 60, 40, x, 40 FROM q UNION ALL SELECT region_no, region, 0, 3, x, 40, x, -40 FROM q"
    " UNION ALL SELECT region_no, region, 1, 0, x + 20, -10, x + 40, -10 FROM q UNION ALL SELECT region_no, region, 1, 1, x + 40, -10, x + 40, 10 FROM q"
    " UNION ALL SELECT region_no, region, 1, 2, x + 40, 10, x + 20, 10 FROM q UNION ALL SELECT region_no, region, 1, 3, x + 20, 10, x + 20, -10 FROM q)"
    " SELECT region_no, region, ring_no, edge_no, x1, y1::DOUBLE AS y1, x2, y2::DOUBLE AS y2 FROM s",
)
def region_edges(spark, sf_dir):
    return regions.edges(derived.regions(spark, sf_dir))


@query(
    "region_classify",
    f"WITH {PT}, q AS (SELECT r_regionkey AS no, r_name AS region, (-170 + 70 * r_regionkey)::DOUBLE AS x FROM region)"
    " SELECT point_id, min_by(region, no) AS region, coalesce(min_by(region, no), 'us') AS source FROM pt LEFT JOIN q ON lon BETWEEN x AND x + 60 AND lat BETWEEN -40 AND 40"
    " AND NOT (lon > x + 20 AND lon < x + 40 AND lat > -10 AND lat < 10) GROUP BY point_id",
)
def region_classify(spark, sf_dir):
    found = region.classify(derived.points(spark, sf_dir), region_edges(spark, sf_dir))
    return found.select("point_id", "region", region.source_of(F.col("region")).alias("source"))


@query(
    "region_bbox",
    f"WITH {PT} SELECT point_id, CASE WHEN lat BETWEEN -45 AND -10 AND lon BETWEEN 112 AND 155 THEN 'au' WHEN lat BETWEEN 42 AND 84 AND lon BETWEEN -141 AND -52 THEN 'ca'"
    " WHEN lat >= 24 AND lat < 49 AND lon BETWEEN -125 AND -66 THEN 'us' WHEN lat BETWEEN 51 AND 72 AND lon BETWEEN -180 AND -129 THEN 'us'"
    " WHEN lat BETWEEN 18 AND 23 AND lon BETWEEN -161 AND -154 THEN 'us' END AS region FROM pt",
)
def region_bbox(spark, sf_dir):
    return derived.points(spark, sf_dir).select("point_id", region.box_region(F.col("lat"), F.col("lon")).alias("region"))


_STATES = ", ".join(f"('{c}', {la}::DOUBLE, {lo}::DOUBLE)" for c, (la, lo) in region.STATES.items())


@query(
    "nearby_states",
    f"WITH {PT}, st(state, la, lo) AS (VALUES {_STATES}), n AS (SELECT point_id, state, sqrt(pow(lat - la, 2) + pow(lon - lo, 2)) AS dd FROM pt, st),"
    " o AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dd, state)::INT AS state_no FROM n) SELECT point_id, state_no, state FROM o WHERE state_no <= 5 AND (state_no = 1 OR dd < 4)",
)
def nearby_states(spark, sf_dir):
    return region.nearby_states(derived.points(spark, sf_dir), "point_id")


# Scalar functions: one row for each transmitter ------------------------------------------------------


def _scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = derived.tower_numbers(spark, sf_dir)
    lat, lon = F.lit(derived.RECEIVER[0]), F.lit(derived.RECEIVER[1])
    found = found.withColumn("dist", geo.haversine_km(lat, lon, F.col("lat"), F.col("lon")))
    return found.withColumn("bearing", geo.bearing_deg(lat, lon, F.col("lat"), F.col("lon"))).withColumn("band", rf.band_of(F.col("freq"), CONFIG.bands))


def _scalar_query(name: str, column, sql: str) -> None:
    source = f"WITH {D}, {ONE}, g AS (SELECT b.*, {HAVERSINE} AS dist, {BEARING} AS bearing FROM b, r) SELECT k, {sql} AS value FROM g"
    query(name, source)(lambda spark, sf_dir: _scalar(spark, sf_dir).select("k", column().alias("value")))


_scalar_query("fn_haversine", lambda: F.bround("dist", 1), "round_even(dist, 1)")
_scalar_query("fn_bearing", lambda: F.bround("bearing", 1), "round_even(bearing, 1)")
_scalar_query("fn_cardinal", lambda: geo.cardinal(F.col("bearing")), f"{POINTS16}[(round_even(bearing / 22.5, 0)::INT % 16) + 1]")
_scalar_query("fn_fspl", lambda: F.bround(rf.path_loss_db(F.col("dist"), F.col("freq")), 1), f"round_even({LOSS}, 1)")
_scalar_query("fn_rx_power", lambda: F.bround(rf.received_dbm(F.lit(50.0), F.col("dist"), F.col("freq"), 6.0), 1), f"round_even(56 - ({LOSS}), 1)")
_scalar_query("fn_band", lambda: rf.band_of(F.col("freq"), CONFIG.bands), "band")
_scalar_query("fn_distance_class", lambda: rf.distance_class(F.col("dist"), CONFIG.distance_classes), CLASS)
_scalar_query("fn_dbm", lambda: F.bround(rf.dbm(F.col("eirp_w")), 3), "round_even(10 * log10(eirp_w) + 30, 3)")
_scalar_query(
    "fn_eirp",
    lambda: F.bround(F.coalesce(rf.device_eirp_dbm(F.col("eirp_w"), F.col("transmit_w"), F.lit(None).cast("double")), rf.default_eirp_dbm(F.col("band"))), 3),
    f"round_even({EIRP}, 3)",
)
_scalar_query(
    "fn_as_float",
    lambda: text.as_float(
        F.when(F.col("k") % 5 == 0, F.concat(F.lit('{"low": '), F.col("freq"), F.lit(', "high": '), F.col("freq") + 2, F.lit("}")))
        .when(F.col("k") % 5 == 1, F.concat(F.lit('{"value": "'), F.col("freq"), F.lit('"}')))
        .when(F.col("k") % 5 == 2, F.lit('"abc"'))
        .when(F.col("k") % 5 == 3, F.concat(F.lit('"'), F.col("freq"), F.lit('"')))
        .otherwise(F.col("freq").cast("string"))
    ),
    "CASE k % 5 WHEN 0 THEN (freq + (freq + 2)) / 2 WHEN 2 THEN NULL ELSE freq END",
)
_scalar_query("fn_erp_kw", lambda: rf.erp_kw(F.when(F.col("k") % 3 == 0, F.lit("none")).otherwise(F.concat(F.col("k").cast("string"), F.lit(".5   kW")))), "CASE WHEN k % 3 <> 0 THEN k + 0.5::DOUBLE END")
_scalar_query("fn_erp_eirp", lambda: F.bround(rf.watts(rf.erp_to_eirp_dbm(F.col("k") / 1000)), 3), "round_even(pow(10, (10 * log10(k::DOUBLE / 1000 * 1000) + 30 + 2.15::DOUBLE - 30) / 10), 3)")
_scalar_query(
    "fn_dms",
    lambda: F.bround(text.degrees_of((F.col("k") % 90).cast("string"), (F.col("k") % 60).cast("string"), F.concat((F.col("k") % 59).cast("string"), F.lit(".5")), F.when(F.col("k") % 2 == 0, "S").otherwise("N"), "S"), 6),
    "round_even((CASE WHEN k % 2 = 0 THEN -1 ELSE 1 END) * ((k % 90) + (k % 60)::DOUBLE / 60 + ((k % 59) + 0.5::DOUBLE) / 3600), 6)",
)
_scalar_query("fn_title", lambda: text.title(F.concat(F.lit("ST. o'NEIL-"), F.upper("state"), F.lit(" élan"))), "'St. O''Neil-' || state || ' Élan'")


@query("fn_sql", f"WITH {D}, {ONE}, g AS (SELECT b.*, {HAVERSINE} AS dist, {BEARING} AS bearing FROM b, r) SELECT k, round_even(dist, 1) AS km, {POINTS16}[(round_even(bearing / 22.5, 0)::INT % 16) + 1] AS point, {CLASS} AS class, band FROM g")
def fn_sql(spark, sf_dir):
    """The registered SQL functions, by way of SQL."""
    register(spark, CONFIG)
    lat, lon = derived.RECEIVER
    return spark.sql(
        f"SELECT k, bround(rf_haversine({lat}D, {lon}D, lat, lon), 1) AS km, rf_cardinal(rf_bearing({lat}D, {lon}D, lat, lon)) AS point,"
        f" rf_distance_class(rf_haversine({lat}D, {lon}D, lat, lon)) AS class, rf_band(freq) AS band FROM {{numbers}}",
        numbers=derived.tower_numbers(spark, sf_dir),
    )


@query(
    "page_scan",
    "SELECT capture AS subtype_no, count(*)::BIGINT AS n_systems, max(o_orderkey) AS last_key FROM (SELECT o_orderkey, o_orderkey // 300 * 3 + o_custkey % 3 AS capture,"
    " row_number() OVER (PARTITION BY o_orderkey // 300, o_custkey % 3 ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i // 20 < 3 GROUP BY 1",
)
def page_scan(spark, sf_dir):
    """Systems of captured pages: orders stand for systems, some hundred to a capture, twenty to a page; three pages of each are read."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey div 300 * 3 + o_custkey % 3 AS subtype_no", "o_orderkey")
    numbered = rows.selectExpr("subtype_no", "o_orderkey", "row_number() OVER (PARTITION BY subtype_no ORDER BY o_orderkey) - 1 AS i")
    pages = numbered.groupBy("subtype_no", F.floor(F.col("i") / 20).cast("int").alias("page_no")).agg(
        F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderkey").cast("string").alias("cursor"), F.struct(F.concat(F.lit("sys-"), "o_orderkey").alias("id")).alias("node")))).alias("edges")
    )
    body = F.to_json(F.struct(F.struct(F.struct("edges", F.struct(F.lit(True).alias("hasNextPage")).alias("pageInfo")).alias("systems")).alias("data")))
    found = systems.page_systems(pages.select("subtype_no", "page_no", body.alias("body")))
    key = F.substring("id", 5, 20).cast("long")
    return found.groupBy(F.col("system_no.subtype_no").alias("subtype_no")).agg(F.count("id").alias("n_systems"), F.max(key).alias("last_key"))


@query(
    "source_scan",
    f"WITH {D}, l AS (SELECT k, freq, CASE k % 4 WHEN 0 THEN 'Commercial Television' WHEN 1 THEN 'Commercial Radio' WHEN 2 THEN 'Retransmission' END AS subtype FROM d)"
    " SELECT 'us' AS source, count(*)::BIGINT AS n_systems, sum(k)::BIGINT AS sum_k FROM l WHERE freq BETWEEN 54 AND 698"
    " UNION ALL SELECT s, count(*)::BIGINT, sum(k)::BIGINT FROM l, (VALUES ('au'), ('ca')) t(s) WHERE subtype IN ('Commercial Television', 'Commercial Radio') GROUP BY s",
)
def source_scan(spark, sf_dir):
    """What each source is asked for: certain subtypes, or a range of frequencies."""
    subtype = F.expr("CASE system_no % 4 WHEN 0 THEN 'Commercial Television' WHEN 1 THEN 'Commercial Radio' WHEN 2 THEN 'Retransmission' END")
    every = derived.systems(spark, sf_dir).withColumn("licence", F.struct(F.lit("Broadcasting").alias("type"), subtype.alias("subtype")))
    counts = [
        systems.asked_for(every, source).agg(F.count(F.lit(1)).alias("n_systems"), F.sum("system_no").alias("sum_k")).select(F.lit(source).alias("source"), "n_systems", "sum_k")
        for source in ("us", "au", "ca")
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


STATE_CODES = "[" + ", ".join(f"'{c}'" for c in region.STATES) + f"][k % {len(region.STATES)} + 1]"
NEAR_SQL = f"""near AS (
  SELECT state, row_number() OVER (ORDER BY dd, state)::INT AS state_no, dd FROM (
    SELECT state, sqrt(pow({derived.RECEIVER[0]}::DOUBLE - la, 2) + pow({derived.RECEIVER[1]}::DOUBLE - lo, 2)) AS dd FROM (VALUES {_STATES}) st(state, la, lo))
)"""


@query(
    "scan_near_states",
    f"WITH {TV}, {NEAR_SQL}, t AS (SELECT *, {STATE_CODES} AS state FROM tvs WHERE mhz IS NOT NULL)"
    " SELECT t.state, ordinal, callsign, mhz, 'Winston-Salem, ' || t.state AS name FROM t JOIN near USING (state) WHERE state_no <= 5 AND (state_no = 1 OR dd < 4)",
)
def scan_near_states(spark, sf_dir):
    """Stations of the states around a receiver: lines lie in a folder for each state, and the others are not read."""
    folder = f"{shared_dir(spark)}/states-{uuid.uuid4().hex}"
    stations.write_states(derived.state_lines(spark, sf_dir), folder)
    wanted = region.nearby_states(derived.receiver(spark), "receiver_id", "rx_lat", "rx_lon")
    found = stations.tv_stations(stations.near_states(stations.read_states(spark, folder), wanted).drop("state"))
    return found.select("state", "ordinal", "callsign", "mhz", "name")


ANSWERS = f"""{D}, e AS (
  SELECT *, (k % 8)::INT AS request_no, (k // 8 % 3)::INT AS subtype_no, row_number() OVER (PARTITION BY k % 8, k // 8 % 3 ORDER BY k) - 1 AS i FROM d
), f AS (
  SELECT request_no, subtype_no, (i // 20)::INT AS page_no, (i % 20)::INT AS edge_no, callsign, freq, lat, lon, eirp_w, ['Commercial Television', 'National Broadcasting', 'Commercial Radio'][subtype_no + 1] AS licence_subtype FROM e
)"""


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}"
    derived.write_answers(spark, sf_dir, folder)
    return paged.read_paged(spark, derived.paged_requests(), "captures", path=folder, max_pages=1_000_000, page_size=20)


def _paged_columns(rows: DataFrame) -> DataFrame:
    return paged.as_devices(rows).select(*[f"ord.system_no.{c}" for c in ("request_no", "subtype_no", "page_no", "edge_no")], "callsign", "freq", "lat", "lon", "eirp_w", "licence_subtype")


@query("paged_scan", f"WITH {ANSWERS} SELECT * FROM f")
def paged_scan(spark, sf_dir):
    """Devices from recorded answers, page after page by cursor: a task for each request and subtype."""
    return _paged_columns(_paged(spark, sf_dir))


@query("paged_pushdown", f"WITH {ANSWERS} SELECT * FROM f WHERE licence_subtype = 'Commercial Radio' AND freq BETWEEN 88 AND 200 AND request_no IN (1, 2, 5)")
def paged_pushdown(spark, sf_dir):
    """The same with filters, which become part of the requests: three are sent in place of twenty-four."""
    rows = _paged(spark, sf_dir).filter("licence_subtype = 'Commercial Radio' AND mhz BETWEEN 88 AND 200 AND request_no IN (1, 2, 5)")
    return _paged_columns(rows)


@query(
    "lookup_elevations",
    f"WITH {D}, q AS (SELECT DISTINCT round_even(lat, 6) AS lat6, round_even(lon, 6) AS lon6 FROM d), n AS (SELECT *, round_even(lat6 * 10000, 0)::BIGINT + round_even(lon6 * 10000, 0)::BIGINT AS m FROM q)"
    " SELECT lat6, lon6, ((m % 1000 + 1000) % 1000)::DOUBLE / 8 AS elevation_m FROM n WHERE m % 7 <> 0",
)
def lookup_elevations(spark, sf_dir):
    """The ground of every transmitter's place, asked for in batches."""
    places = derived.devices(spark, sf_dir).select(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    return elevations.lookup_elevations(places, "rfrank.sources.derived:elevation_service")


BORDERS_SQL = "CASE WHEN rx_lat <= 40 AND rx_lon BETWEEN -170 AND -110 THEN 'au' WHEN rx_lat <= 40 AND rx_lon BETWEEN -100 AND -40 THEN 'ca' ELSE 'us' END"
ASKED_SQL = MANY.replace("r AS (", "r0 AS (") + f", r AS (SELECT *, CASE receiver_id % 4 WHEN 1 THEN 'us' WHEN 2 THEN 'au' ELSE {BORDERS_SQL} END AS source FROM r0)"


@query(
    "answers",
    f"WITH z AS ({ranked_sql(ASKED_SQL, order=BY_POWER_SQL).replace('FROM b, r WHERE band IS NOT NULL', 'FROM b, r WHERE band IS NOT NULL AND source = CASE k % 3 WHEN 0 THEN chr(117) || chr(115) WHEN 1 THEN chr(97) || chr(117) ELSE chr(99) || chr(97) END')}),"
    f" {ASKED_SQL}, {D}, {ELEVATION}, g AS (SELECT receiver_id, count(*)::BIGINT AS n, string_agg(rank || ':' || callsign || ':' || coalesce(round_even(elevation_m, 1)::VARCHAR, '-'), ',' ORDER BY rank) AS listed"
    " FROM z LEFT JOIN ev ON lat6 = latitude AND lon6 = longitude GROUP BY receiver_id)"
    " SELECT receiver_id, source, coalesce(n, 0)::BIGINT AS n_towers, coalesce(listed, '') AS listed, radius_km, coalesce(elevation_m, 0)::DOUBLE AS altitude_m"
    " FROM r LEFT JOIN g USING (receiver_id) LEFT JOIN ev ON ev.lat6 = round_even(rx_lat, 6) AND ev.lon6 = round_even(rx_lon, 6)",
)
def answers(spark, sf_dir):
    """Every receiver's answer, from its request: source by its place unless it names one, towers of that source, elevations, document."""
    asked = derived.receivers(spark, sf_dir).withColumn("source", F.expr("CASE receiver_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'US' WHEN 2 THEN 'au' END"))
    code = F.expr("CASE region_no WHEN 0 THEN 'au' WHEN 1 THEN 'ca' END")
    edges = regions.edges(derived.regions(spark, sf_dir).withColumn("region", code).filter("region is not null"))
    devices = derived.devices(spark, sf_dir, dealt=True)
    by_source = {s: devices.filter(F.col("ord.system_no") % 3 == i) for i, s in enumerate(answer.SOURCES)}
    made = answer.find_towers(asked, edges, by_source, BY_POWER, elevation_dim(spark, sf_dir), most_rows=11, typical_km=35.0)
    document = "struct<towers:array<struct<rank:int,callsign:string,elevation_m:double>>,query:struct<altitude_m:double,radius_km:double,source:string>,count:bigint>"
    told = made.select("receiver_id", "source", F.from_json("document", document).alias("d"))
    listed = F.transform("d.towers", lambda t: F.concat_ws(":", t["rank"], t["callsign"], F.coalesce(t["elevation_m"].cast("string"), F.lit("-"))))
    return told.select("receiver_id", F.col("d.query.source").alias("source"), F.col("d.count").alias("n_towers"), F.array_join(listed, ",").alias("listed"), "d.query.radius_km", "d.query.altitude_m")


@query(
    "band_cube",
    f"WITH {towers_sql(matched=True)} SELECT CASE WHEN grouping(band) = 1 THEN 'all' ELSE band END AS band, CASE WHEN grouping(distance_class) = 1 THEN 'all' ELSE distance_class END AS distance_class,"
    " count(*)::BIGINT AS n_towers, max(received_power_dbm) AS strongest_dbm FROM u WHERE frequency_matched GROUP BY CUBE (band, distance_class)",
)
def band_cube(spark, sf_dir):
    """An extension: the measured towers by band and distance class, with all subtotals."""
    matched = match.match_nearest(_candidates(spark, sf_dir), derived.measurements(spark, sf_dir))
    return enrich.band_cube(ranking.keep_strongest(ranking.project(matched, CONFIG)).filter("frequency_matched"))


@query("fn_nearby_states", SQL["nearby_states"])
def fn_nearby_states(spark, sf_dir):
    """The states around each point by the registered table function, by way of SQL."""
    register(spark, CONFIG)
    return spark.sql("SELECT p.point_id, n.state_no, n.state FROM {points} AS p, LATERAL rf_nearby_states(p.lat, p.lon) AS n", points=derived.points(spark, sf_dir))


WIDE = "r AS (SELECT 1 AS receiver_id, 34.8526::DOUBLE AS rx_lat, -82.394::DOUBLE AS rx_lon, 300.0::DOUBLE AS radius_km)"
UNION_SQL = f"""{D}, {TV}, {FM}, a AS (
  SELECT 0 AS source_no, k, callsign, 'Winston-Salem, NC' AS name, mhz AS freq, lat, lon, eirp_w, NULL::DOUBLE AS transmit_w FROM tvs WHERE mhz IS NOT NULL
  UNION ALL SELECT 1, ordinal, callsign, 'St. Mary''S, GA', mhz, lat, lon, pow(10, eirp_db / 10), NULL FROM fms
  UNION ALL SELECT 2, k, callsign, name, freq, lat, lon, eirp_w, transmit_w FROM d
), ab AS (
  SELECT *, CASE WHEN freq BETWEEN 87.8::DOUBLE AND 108 THEN 'FM' WHEN freq BETWEEN 174 AND 216 THEN 'VHF' WHEN freq BETWEEN 470 AND 608 THEN 'UHF' END AS band FROM a
), {WIDE}, g AS (SELECT ab.*, r.*, {HAVERSINE} AS dist FROM ab, r WHERE band IS NOT NULL), h AS (SELECT *, {EIRP} AS eirp FROM g WHERE dist <= radius_km
), p AS (SELECT * FROM (SELECT *, eirp + 6 - ({LOSS}) AS power FROM h) WHERE power >= -120
), t AS (SELECT *, round_even(freq, 3) AS frequency_mhz, round_even(dist, 1) AS distance_km, round_even(power, 1) AS received_power_dbm, {CLASS} AS distance_class, source_no * 10000000000 + k AS first_k FROM p
), u AS (SELECT * FROM (SELECT * EXCLUDE (first_k), row_number() OVER (PARTITION BY callsign, frequency_mhz ORDER BY received_power_dbm DESC, first_k) AS nth,
                               min(first_k) OVER (PARTITION BY callsign, frequency_mhz) AS first_k FROM t) WHERE nth = 1)"""


@query("rank_sources", f"WITH {UNION_SQL} SELECT row_number() OVER (ORDER BY {BY_POWER_SQL})::INT AS rank, name, callsign, frequency_mhz, distance_km, received_power_dbm FROM u")
def rank_sources(spark, sf_dir):
    """Station lines, television before FM, then systems, as one: every tower within the widest radius, none cut off."""
    lines = stations.as_devices(stations.all_stations(derived.tv_lines(spark, sf_dir), derived.fm_lines(spark, sf_dir)))
    both = lines.unionByName(systems.explode_devices(derived.systems(spark, sf_dir), source_no=2))
    wide = derived.receiver(spark).selectExpr("*", "300D AS radius_km", "2147483647 AS max_rows")
    ranked = ranking.rank_towers(both, wide, BY_POWER, typical_km=300.0)
    return ranked.select("rank", "name", "callsign", "frequency_mhz", "distance_km", "received_power_dbm")
