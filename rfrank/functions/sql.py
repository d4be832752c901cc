"""The scalar functions as SQL functions, so that they can be used from ``spark.sql``.

Each is an expression that the optimizer inlines; none is a Python function.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..plans.config import RankingConfig
from .geo import CARDINALS, EARTH_RADIUS_KM
from .rf import LOW_CHANNELS


def _case(pairs: list[tuple[str, str]], default: str) -> str:
    return f"CASE {' '.join(f'WHEN {test} THEN {value}' for test, value in pairs)} ELSE {default} END" if pairs else default


def definitions(config: RankingConfig) -> dict[str, str]:
    """Name: signature and body."""
    points = ", ".join(f"'{c}'" for c in CARDINALS)
    bands = [(" OR ".join(f"mhz BETWEEN {lo!r}D AND {hi!r}D" for lo, hi in r), f"'{b}'") for b, r in config.bands.items()]
    classes = [(f"km >= {lo!r}D" + ("" if hi == float("inf") else f" AND km < {hi!r}D"), f"'{n}'") for n, lo, hi in config.distance_classes]
    low = [(f"channel = {c}", f"{f}.0D") for c, f in LOW_CHANNELS.items()]
    return {
        "rf_haversine": f"(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE RETURN {2 * EARTH_RADIUS_KM}D * asin(least(1D, sqrt("
        "pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2))))",
        "rf_bearing": "(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE RETURN (degrees(atan2("
        "sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360D) % 360D",
        "rf_cardinal": f"(deg DOUBLE) RETURNS STRING RETURN element_at(array({points}), CAST(rint(deg / 22.5D) AS INT) % 16 + 1)",
        "rf_path_loss": "(km DOUBLE, mhz DOUBLE) RETURNS DOUBLE RETURN CASE WHEN km <= 0 OR mhz <= 0 THEN 0D ELSE 20D * log10(km * 1000D) + 20D * log10(mhz * 1000000D) - 147.55D END",
        "rf_dbm": "(watts DOUBLE) RETURNS DOUBLE RETURN CASE WHEN watts <= 0 THEN double('-Infinity') ELSE 10D * log10(watts) + 30D END",
        "rf_watts": "(dbm DOUBLE) RETURNS DOUBLE RETURN pow(10D, (dbm - 30D) / 10D)",
        "rf_band": f"(mhz DOUBLE) RETURNS STRING RETURN {_case(bands, 'CAST(NULL AS STRING)')}",
        "rf_distance_class": f"(km DOUBLE) RETURNS STRING RETURN {_case(classes, chr(39) + 'Far' + chr(39))}",
        "rf_channel": f"(channel INT) RETURNS DOUBLE RETURN {_case([*low, ('channel BETWEEN 7 AND 13', '177D + 6 * (channel - 7)'), ('channel BETWEEN 14 AND 36', '473D + 6 * (channel - 14)')], 'CAST(NULL AS DOUBLE)')}",
    }


def table_definitions() -> dict[str, str]:
    """Name: signature and body of functions that give tables, to be used with LATERAL."""
    from ..operators.region import MOST_STATES, STATE_REACH_DEGREES, STATES

    near = ", ".join(f"struct(sqrt(pow(lat - ({la!r}D), 2) + pow(lon - ({lo!r}D), 2)) AS d, '{c}' AS state)" for c, (la, lo) in STATES.items())
    kept = f"filter(slice(array_sort(array({near})), 1, {MOST_STATES}), (s, i) -> i = 0 OR s.d < {STATE_REACH_DEGREES!r}D)"
    return {
        "rf_nearby_states": "(lat DOUBLE, lon DOUBLE) RETURNS TABLE (state_no INT, state STRING) RETURN"
        f" SELECT n.state_no, n.state FROM inline(transform({kept}, (s, i) -> struct(i + 1 AS state_no, s.state AS state))) AS n",
    }


def register(spark: SparkSession, config: RankingConfig | None = None) -> list[str]:
    """Create the functions in the session; returns their names."""
    made = definitions(config or RankingConfig.default()) | table_definitions()
    for name, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(made)
