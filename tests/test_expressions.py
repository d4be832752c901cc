"""Scalar expressions against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rfrank.functions import geo, rf, sql, text
from rfrank.operators import region
from rfrank.plans.config import RankingConfig, check_measurement, check_request

CONFIG = RankingConfig.default()


def one(spark, column, **values):
    frame = spark.createDataFrame([values]) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


def test_haversine_and_bearing(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(-89, 89), rng.uniform(-180, 180), rng.uniform(-89, 89), rng.uniform(-180, 180)) for _ in range(200)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = frame.select(geo.haversine_km(*map(F.col, "abcd")).alias("km"), geo.bearing_deg(*map(F.col, "abcd")).alias("deg"), *"abcd").collect()
    for r in got:
        p, q, dl = math.radians(r.a), math.radians(r.c), math.radians(r.d - r.b)
        angle = math.acos(max(-1, min(1, math.sin(p) * math.sin(q) + math.cos(p) * math.cos(q) * math.cos(dl))))
        assert r.km == pytest.approx(6371.0 * angle, abs=1e-3)
        assert 0 <= r.deg < 360


@pytest.mark.parametrize("deg, point", [(0, "N"), (11.25, "N"), (33.75, "NE"), (45, "NE"), (90, "E"), (180, "S"), (359.9, "N"), (348.75, "N")])
def test_cardinal(spark, deg, point):
    assert one(spark, geo.cardinal(F.lit(float(deg)))) == point


@pytest.mark.parametrize("mhz, band", [(87.8, "FM"), (108.0, "FM"), (108.01, None), (174.0, "VHF"), (216.0, "VHF"), (470.0, "UHF"), (608.0, "UHF"), (608.1, None), (57.0, None)])
def test_bands(spark, mhz, band):
    assert one(spark, rf.band_of(F.lit(mhz), CONFIG.bands)) == band


@pytest.mark.parametrize("km, name", [(-1.0, "Far"), (0.0, "Too Close"), (7.999, "Too Close"), (8.0, "Ideal"), (30.0, "Good"), (60.0, "Far"), (1e9, "Far")])
def test_distance_classes(spark, km, name):
    assert one(spark, rf.distance_class(F.lit(km), CONFIG.distance_classes)) == name


def test_power(spark):
    assert one(spark, rf.path_loss_db(F.lit(0.0), F.lit(100.0))) == 0
    assert one(spark, rf.path_loss_db(F.lit(10.0), F.lit(100.0))) == pytest.approx(20 * 4 + 20 * 8 - 147.55)
    assert one(spark, rf.dbm(F.lit(0.0))) == float("-inf")
    assert one(spark, rf.watts(rf.dbm(F.lit(25.0)))) == pytest.approx(25)
    none = F.lit(None).cast("double")
    assert one(spark, rf.device_eirp_dbm(none, F.lit(1.0), none)) == pytest.approx(40)
    assert one(spark, rf.device_eirp_dbm(F.lit(-1.0), F.lit(1.0), F.lit(0.0))) == pytest.approx(30)
    assert one(spark, rf.device_eirp_dbm(none, F.lit(0.0), none)) is None


@pytest.mark.parametrize(
    "json, value",
    [("97.1", 97.1), ('"97.1"', 97.1), ('"abc"', None), ('{"value": 5}', 5.0), ('{"value": "abc", "low": 1, "high": 3}', None), ('{"low": 1, "high": 3}', 2.0), ('{"low": 1}', None), ("null", None), ("{}", None), ("true", 1.0), ("", None)],
)
def test_as_float(spark, json, value):
    assert one(spark, text.as_float(F.lit(json))) == value


@pytest.mark.parametrize(
    "wkt, at",
    [
        ("POINT(151.2 -33.9)", (-33.9, 151.2)),
        (" point ( 1e1  2 )", (2.0, 10.0)),
        ("POINT 1 2", None),
        ("POINT(1)", None),
        ("POINT(a b)", None),
        ("", None),
        ("LINESTRING(0 0, 1 1)", None),
        ("POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))", (4.0, 4.0)),
        ("MULTIPOLYGON(((0 0, 2 2)))", (1.0, 1.0)),
        ("POLYGON((0 0, 4 -, 2 2))", (1.0, 2.0)),  # the bad latitude's longitude still counts
    ],
)
def test_geometry(spark, wkt, at):
    got = one(spark, text.geometry(F.lit(wkt)))
    assert (None if got is None else (got.lat, got.lon)) == at


@pytest.mark.parametrize("word", ["WINSTON-SALEM", "o'neil", "st. mary's", "a1b", "élan ÉTÉ", "", "x"])
def test_title(spark, word):
    assert one(spark, text.title(F.lit(word))) == word.title()


def test_dms(spark):
    def dms(d, m, s, side):
        return one(spark, text.degrees_of(F.lit(d), F.lit(m), F.lit(s), F.lit(side), "S"))

    assert dms("10", "30", "36.0", "N") == pytest.approx(10.51)
    assert dms("10", "30", "36", "S") == pytest.approx(-10.51)
    assert dms("10.5", "30", "36", "N") is None


def test_cells_never_miss(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(3000):
        lat, lon, km = rng.choice([rng.uniform(-90, 90), 89.9, -89.99, 0.0]), rng.choice([rng.uniform(-180, 180), 179.99, -180.0]), rng.uniform(0, 300)
        rows.append((lat, lon, km, max(-90.0, min(90.0, lat + rng.uniform(-3, 3))), (lon + rng.uniform(-1, 1) * rng.choice([1, 10, 180]) + 180) % 360 - 180))
    frame = spark.createDataFrame(rows, "lat double, lon double, km double, a double, b double")
    near = frame.filter(geo.haversine_km(*map(F.col, ("lat", "lon", "a", "b"))) <= F.col("km"))
    missed = near.filter(~F.array_contains(geo.cells_in_reach(F.col("lat"), F.col("lon"), F.col("km")), geo.grid_cell(F.col("a"), F.col("b"))))
    assert near.count() > 100 and missed.count() == 0


def test_regions(spark):
    square = spark.createDataFrame([(0, "a", [[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]]), (1, "b", [[[5.0, 0.0], [20.0, 0.0], [20.0, 9.0], [5.0, 9.0]]])], "region_no int, region string, rings array<array<array<double>>>")
    from rfrank.sources.regions import edges

    points = spark.createDataFrame([(5.0, 5.0), (10.0, 5.0), (0.0, 0.0), (15.0, 5.0), (30.0, 5.0)], "lon double, lat double")
    got = {(r.lon, r.lat): r.region for r in region.classify(points, edges(square)).collect()}
    assert got == {(5.0, 5.0): "a", (10.0, 5.0): "a", (0.0, 0.0): "a", (15.0, 5.0): "b", (30.0, 5.0): None}


def test_sql_functions_are_inlined(spark):
    sql.register(spark)
    frame = spark.sql("SELECT rf_band(89.3D) AS band, rf_distance_class(9D) AS class, rf_channel(14) AS mhz, rf_cardinal(rf_bearing(0D, 0D, 0D, 1D)) AS point")
    assert tuple(frame.first()) == ("FM", "Ideal", 473.0, "E")
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()


def test_config(tmp_path):
    made = RankingConfig.from_dict({})
    assert (made.sensitivity_dbm, made.default_limit, made.bands) == (-95.0, 20, {})
    CONFIG.save(tmp_path / "c.json")
    assert RankingConfig.load(tmp_path / "c.json") == CONFIG
    assert check_request(10, 20, source="US") == "us"
    for bad in ({"lat": 91, "lon": 0}, {"lat": 0, "lon": 0, "limit": 201}, {"lat": 0, "lon": 0, "source": "nz"}):
        with pytest.raises(ValueError):
            check_request(**bad)
    with pytest.raises(ValueError):
        check_measurement({"freq_mhz": 0})
