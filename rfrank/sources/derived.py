"""Transmitters, measurements and their raw forms, derived from the star-schema tables.

The tables hold no radio data; these rules make some that grows with them. Integer arithmetic and one
division at the end keep the numbers the same in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.region import STATES
from .systems import SUBTYPES, explode_devices

RECEIVER = (34.8526, -82.394)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _spread(k: str) -> str:
    """Latitude and longitude: every third number near the first receiver, the others over a continent."""
    near = f"array(CAST(348526 + 10 * ((7919 * {k}) % 2001 - 1000) AS DOUBLE) / 10000, CAST(-823940 + 10 * ((104729 * {k}) % 2001 - 1000) AS DOUBLE) / 10000)"
    far = f"array(CAST(250000 + (7919 * {k}) % 240001 AS DOUBLE) / 10000, CAST(-1240000 + (104729 * {k}) % 570001 AS DOUBLE) / 10000)"
    return f"CASE WHEN {k} % 3 = 0 THEN {near} ELSE {far} END"


def tower_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transmitter for each part."""
    return _read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS k",
        "concat('W', p_partkey % 100) AS callsign",
        "p_name AS name",
        "concat('S', p_partkey % 50) AS state",
        "CAST(CASE WHEN p_partkey % 8 <= 2 THEN 879 + 4 * (p_partkey % 51) WHEN p_partkey % 8 <= 4 THEN 1770 + 60 * (p_partkey % 7)"
        " WHEN p_partkey % 8 <= 6 THEN 4730 + 120 * (p_partkey % 12) ELSE 3000 END AS DOUBLE) / 10 AS freq",
        f"{_spread('p_partkey')}[0] AS lat",
        f"{_spread('p_partkey')}[1] AS lon",
        "CAST(p_partkey % 300 AS DOUBLE) AS height_m",
        "CASE WHEN p_partkey % 6 <> 0 THEN p_retailprice END AS eirp_w",
        "CASE WHEN p_partkey % 12 <> 0 THEN p_size * 0.001D END AS transmit_w",
    )


def systems(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """The same transmitters as raw systems, one device each, numbers as JSON text and places as POINT.

    ``dealt`` over all tasks first: a file of a few megabytes is one task's, and has a million systems to parse.
    """
    numbers = tower_numbers(spark, sf_dir)
    return (numbers.repartition("k") if dealt else numbers).selectExpr(
        "k AS system_no",
        "concat('sys-', k) AS id",
        "array(named_struct('callsign', callsign, 'frequency', CAST(freq AS STRING), 'eirp', CAST(eirp_w AS STRING), 'transmitPower', CAST(transmit_w AS STRING),"
        " 'antennaHeight', height_m, 'antenna', CAST(NULL AS STRUCT<gain: DOUBLE>), 'location', named_struct('name', name, 'state', state,"
        " 'geom', named_struct('string', concat('POINT(', lon, ' ', lat, ')'), 'wkt', CAST(NULL AS STRING))))) AS devices",
        "named_struct('type', 'Broadcasting', 'subtype', CASE WHEN k % 2 = 0 THEN 'Television' ELSE 'FM Radio' END) AS licence",
    )


def devices(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    return explode_devices(systems(spark, sf_dir, dealt))


def receiver(spark: SparkSession) -> DataFrame:
    """One receiver."""
    lat, lon = RECEIVER
    return spark.range(1).select(F.lit(1).alias("receiver_id"), F.lit(lat).alias("rx_lat"), F.lit(lon).alias("rx_lon"))


def receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One receiver for each supplier, near the first or over a continent, with a radius of 20 to 49 km of its own."""
    return _read(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS receiver_id",
        f"{_spread('s_suppkey')}[0] AS rx_lat",
        f"{_spread('s_suppkey')}[1] AS rx_lon",
        "CAST(20 + s_suppkey % 30 AS DOUBLE) AS radius_km",
        "CAST(5 + s_suppkey % 7 AS INT) AS max_rows",
    )


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measurement for each event, in the lower part of each band and to the kilohertz: some near no transmitter."""
    return _read(spark, sf_dir, "events").selectExpr(
        "event_id AS ordinal",
        "CAST(CASE event_id % 3 WHEN 0 THEN 87900 + (37 * event_id) % 12001 WHEN 1 THEN 174000 + (53 * event_id) % 20001 ELSE 470000 + (71 * event_id) % 60001 END AS DOUBLE) / 1000 AS freq_mhz",
        "CAST(event_id % 60 AS DOUBLE) AS snr_db",
        "CAST(event_id % 100 AS DOUBLE) / 100 AS obw_fraction",
        "least(value / 500, 1.0D) AS score",
        "CAST(-(event_id % 90) AS DOUBLE) AS power_db",
        "CASE event_id % 3 WHEN 0 THEN 'FM' WHEN 1 THEN 'VHF' ELSE 'UHF' END AS band",
    )


def tv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A television line for each part; some unlicensed, short, or on a channel that is none."""
    head = "'', concat('K', p_partkey % 900), '', concat('DT', p_partkey % 3), concat(' ', p_partkey % 40, ' '), '', '', '', '', CASE WHEN p_partkey % 5 = 0 THEN 'CP' ELSE 'LIC ' END"
    return _read(spark, sf_dir, "part").selectExpr(
        f"concat_ws('|', {head}, 'WINSTON-SALEM', 'NC', '', '', concat(p_size, '.   kW'), '', CASE WHEN p_partkey % 4 = 0 THEN 'n/a' ELSE CAST(p_partkey % 500 AS STRING) END, '', '',"
        " CASE WHEN p_partkey % 9 = 0 THEN 'S' ELSE 'N' END, p_partkey % 60, p_partkey % 59, concat(p_partkey % 58, '.5'), CASE WHEN p_partkey % 7 = 0 THEN 'E' ELSE 'W' END,"
        " p_partkey % 170, p_partkey % 57, concat(p_partkey % 56, '.25'), repeat('|', CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 12 END)) AS line",
        "p_partkey AS ordinal",
    )


def state_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The television lines, dealt over all states."""
    codes = ", ".join(f"'{c}'" for c in STATES)
    return tv_lines(spark, sf_dir).selectExpr(f"replace(line, '|WINSTON-SALEM|NC|', concat('|WINSTON-SALEM|', array({codes})[ordinal % {len(STATES)}], '|')) AS line", "ordinal")


def write_answers(spark: SparkSession, sf_dir: str, folder: str, per_page: int = 20) -> None:
    """The systems as recorded answers of a paged service, to eight requests with three subtypes each: pages follow each other by cursor."""
    subtypes = ", ".join(f"'{s}'" for s in SUBTYPES)
    rows = systems(spark, sf_dir).selectExpr(
        "CAST(system_no % 8 AS INT) AS request_no", "CAST(system_no div 8 % 3 AS INT) AS subtype_no", "system_no",
        f"named_struct('cursor', CAST(system_no AS STRING), 'node', named_struct('id', id, 'devices', devices, 'licence', named_struct('type', 'Broadcasting', 'subtype', array({subtypes})[system_no div 8 % 3]))) AS edge",
    )
    numbered = rows.selectExpr("*", "row_number() OVER (PARTITION BY request_no, subtype_no ORDER BY system_no) - 1 AS i", "count(*) OVER (PARTITION BY request_no, subtype_no) AS n")
    paged = numbered.groupBy("request_no", "subtype_no", "n", F.expr(f"CAST(i div {per_page} AS INT)").alias("page_no")).agg(F.array_sort(F.collect_list(F.struct("system_no", "edge"))).alias("e"))
    paged = paged.selectExpr(
        "request_no", "subtype_no", "page_no",
        "coalesce(lag(element_at(e, -1).edge.cursor) OVER (PARTITION BY request_no, subtype_no ORDER BY page_no), '') AS after",
        f"to_json(named_struct('data', named_struct('systems', named_struct('edges', transform(e, x -> x.edge), 'pageInfo', named_struct('hasNextPage', (page_no + 1) * {per_page} < n))))) AS body",
    )
    paged.repartition("request_no", "subtype_no").sortWithinPartitions("request_no", "subtype_no", "page_no").drop("page_no").write.partitionBy("request_no", "subtype_no").json(folder)


def paged_requests() -> list[dict]:
    """What ``write_answers`` recorded the answers to."""
    return [{"source": "au", "lat": RECEIVER[0] + i, "lon": RECEIVER[1], "radius_km": 80} for i in range(8)]


def elevation_service(lats, lons) -> list:
    """A service that knows the ground of most places, by a rule: for tests and queries, in place of one on the network."""
    metres = (round(la * 10_000) + round(lo * 10_000) for la, lo in zip(lats, lons, strict=True))
    return [None if m % 7 == 0 else m % 1000 / 8 for m in metres]


def fm_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An FM line for each supplier."""
    return _read(spark, sf_dir, "supplier").selectExpr(
        "concat_ws('|', '', concat('W', s_suppkey), concat(87 + s_suppkey % 20, '.', s_suppkey % 10, '  MHz'), 'FM', '', '', '', '', '', CASE WHEN s_suppkey % 6 = 0 THEN 'APP' ELSE 'LIC' END,"
        " 'ST. MARY\\'S', 'GA', '', '', '0.25   kW', '', concat(s_suppkey % 300, '.'), '', '', 'N', s_suppkey % 60, s_suppkey % 59, '30', 'W', s_suppkey % 170, s_suppkey % 57, '6', repeat('|', 12)) AS line",
        "s_suppkey AS ordinal",
    )


def sweep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step event with two channels for each event; some lines broken, of another type, or in an unknown band."""
    return _read(spark, sf_dir, "events").selectExpr(
        "CASE WHEN event_id % 13 = 0 THEN concat('data: {broken', event_id) WHEN event_id % 11 = 0 THEN 'data: {\"type\":\"start\"}' ELSE"
        " concat('data: {\"type\":\"step\",\"channels\":[{\"band\":\"fm\",\"fc_mhz\":', CAST(CAST(879 + 2 * (event_id % 100) AS DOUBLE) / 10 AS STRING),"
        " ',\"snr_db\":', event_id % 60, '.5,\"obw_fraction\":0.25,\"score\":', CAST(CAST(event_id % 101 AS DOUBLE) / 100 AS STRING),"
        " '},{\"band\":\"', CASE event_id % 3 WHEN 0 THEN 'uhf' WHEN 1 THEN 'vhf_hi' ELSE 'am' END, '\",\"fc_mhz\":', 473 + 6 * (event_id % 20),"
        " ',\"channel_power_db\":-', event_id % 90, '.0,\"score\":\"', CAST(CAST(event_id % 97 AS DOUBLE) / 100 AS STRING), '\"}]}') END AS line",
        "event_id AS ordinal",
    )


def elevations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An elevation for four of five places, some of them twice."""
    return tower_numbers(spark, sf_dir).filter("k % 5 <> 0").selectExpr("lat", "lon", "CASE WHEN k % 7 <> 0 THEN CAST(k % 1000 AS DOUBLE) / 8 END AS elevation_m")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point of the globe for each customer, on a grid of half degrees."""
    return _read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS point_id",
        "CAST((31 * c_custkey) % 341 - 170 AS DOUBLE) / 2 AS lat",
        "CAST((97 * c_custkey) % 719 - 359 AS DOUBLE) / 2 AS lon",
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square with a square hole for each region of the star schema, in a row along the equator."""
    return _read(spark, sf_dir, "region").selectExpr(
        "r_regionkey AS region_no",
        "r_name AS region",
        "array(array(array(x0, -40D), array(x0 + 60, -40D), array(x0 + 60, 40D), array(x0, 40D), array(x0, -40D)),"
        " array(array(x0 + 20, -10D), array(x0 + 40, -10D), array(x0 + 40, 10D), array(x0 + 20, 10D), array(x0 + 20, -10D))) AS rings".replace("x0", "CAST(-170 + 70 * r_regionkey AS DOUBLE)"),
    )


def wkts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well-known text for each part: points, polygons, and text that is neither."""
    return tower_numbers(spark, sf_dir).selectExpr(
        "k",
        "CASE WHEN k % 5 = 0 THEN concat('POLYGON((', lon, ' ', lat, ', ', lon + 1, ' ', lat, ', ', lon + 1, ' ', lat + 1, ', ', lon, ' ', lat, '))')"
        " WHEN k % 5 = 1 THEN 'POINT 1 2' WHEN k % 5 = 2 THEN concat('multipolygon(((', lon, ' ', lat, ',', lon, ' x, ', lon + 2, ' ', lat + 2, ')))')"
        " ELSE concat(' Point (', lon, '  ', lat, ')') END AS wkt",
    )
