"""The ranking as a whole against a plain Python account of it, with many ties."""

import json
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rfrank import queries
from rfrank.operators import enrich, match, ranking, region
from rfrank.plans.config import RankingConfig
from rfrank.sources import regions, stations, systems
from rfrank.sources.schema import SYSTEM
from rfrank.sources.stations import as_devices, tv_stations
from rfrank.streaming import feed
from rfrank.streaming import sweep as stream

CONFIG = RankingConfig.default()
SCHEMA = "ord struct<source_no:int,system_no:bigint,device_no:int>, callsign string, name string, state string, freq double, lat double, lon double, height_m double, eirp_w double, transmit_w double, gain_dbi double, licence_type string, licence_subtype string"


def made_up(seed, n):
    rng = random.Random(seed)
    return [
        ((0, i, 0), f"W{rng.randrange(6)}", "n", "s", rng.choice([89.3, 89.30004, 89.5, 177.0, 473.0, 479.0, 300.0, None]), rng.choice([34.9, 35.0, 35.3, 37.0, None]), -82.4,
         None, rng.choice([None, 0.0, 100.0, 1000.0]), rng.choice([None, 5.0]), None, "", "")
        for i in range(n)
    ]


def expected(rows, lat, lon, config, measurements):
    towers = []
    for o, call, _, _, f, la, lo, _, ew, tw, gain, *_ in rows:
        band = next((b for b, r in config.bands.items() if f is not None and any(x <= f <= y for x, y in r)), None)
        if band is None or la is None:
            continue
        p, q = math.radians(lat), math.radians(la)
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lo - lon) / 2) ** 2
        km = 2 * 6371.0 * math.asin(math.sqrt(h))
        if km > config.default_radius_km:
            continue
        dbm = 10 * math.log10(ew) + 30 if ew else 10 * math.log10(tw) + 40 if tw else 50.0 if band == "FM" else 60.0
        power = dbm + config.rx_gain_dbi - (20 * math.log10(km * 1000) + 20 * math.log10(f * 1e6) - 147.55)
        if power < config.sensitivity_dbm:
            continue
        tol = 0.15 if band == "FM" else 4.0
        near = [m for m in measurements if abs(m["freq_mhz"] - f) <= tol]
        best = min(near, key=lambda m: abs(m["freq_mhz"] - f)) if near else None
        towers.append({"ord": o[1], "callsign": call, "f": round(f, 3), "band": band, "power": round(power, 1), "score": best and best["score"]})
    kept = {}
    for t in towers:
        key = (t["callsign"], t["f"])
        if key not in kept or t["power"] > kept[key]["power"]:
            kept[key] = t
    out = list(kept.values())
    if measurements:
        out = [t for t in out if t["score"] is not None]
    out.sort(key=lambda t: (config.band_priority[t["band"]], -(t["score"] or 0)))
    return [(t["callsign"], t["f"], t["power"], t["score"]) for t in out[: config.default_limit]]


@pytest.mark.parametrize("seed, measured", [(1, False), (2, True), (3, True)])
def test_ranking(spark, seed, measured):
    rows = made_up(seed, 300)
    measurements = [{"freq_mhz": f, "score": s} for f, s in ((89.2, 0.5), (89.4, 0.5), (475.0, 0.9), (181.0, 0.5), (89.31, 0.7))] if measured else []
    devices = spark.createDataFrame(rows, SCHEMA)
    here = spark.createDataFrame([(1, 34.85, -82.4)], "receiver_id int, rx_lat double, rx_lon double")
    as_list = ranking.rank_towers(devices, here, CONFIG, measurements)
    want = expected(rows, 34.85, -82.4, CONFIG, measurements)

    def listed(frame):
        return [(r.callsign, r.frequency_mhz, r.received_power_dbm, r.score) for r in frame.orderBy("rank").collect()]

    assert listed(as_list) == want
    if measured:
        table = spark.createDataFrame([(i, m["freq_mhz"], None, None, m["score"], None) for i, m in enumerate(measurements)], "ordinal long, freq_mhz double, snr_db double, obw_fraction double, score double, power_db double")
        assert listed(ranking.rank_towers(devices, here, CONFIG, table)) == want


def test_one_receiver_of_many_is_ranked_alike(spark):
    devices = spark.createDataFrame(made_up(5, 200), SCHEMA)
    many = spark.createDataFrame([(i, 34.5 + i / 10, -82.4) for i in range(8)], "receiver_id int, rx_lat double, rx_lon double")
    together = ranking.rank_towers(devices, many, CONFIG)
    for i in (0, 5):
        alone = ranking.rank_towers(devices, many.filter(F.col("receiver_id") == i), CONFIG)
        assert sorted(map(tuple, alone.collect()), key=str) == sorted(map(tuple, together.filter(F.col("receiver_id") == i).collect()), key=str)


def test_requests_with_their_own_measurements(spark):
    """Each request among others is answered as it is alone; null and empty lists mean none were sent."""
    rng = random.Random(6)
    devices = spark.createDataFrame(made_up(6, 300), SCHEMA)
    sent = {i: [(j, rng.choice([89.2, 89.4, 177.5, 475.0, 300.0]), 1.0, rng.random(), None, 0.5) for j in range(rng.randrange(1, 6))] for i in range(4)} | {4: [], 5: None}
    schema = "receiver_id int, rx_lat double, rx_lon double, measurements array<struct<ordinal:bigint,freq_mhz:double,snr_db:double,score:double,power_db:double,obw_fraction:double>>"
    asked = spark.createDataFrame([(i, 34.6 + i / 10, -82.4, m) for i, m in sent.items()], schema)
    together = ranking.rank_requests(devices, asked, CONFIG).collect()
    for i, m in sent.items():
        values = [dict(zip(("ordinal", "freq_mhz", "snr_db", "score", "power_db", "obw_fraction"), x, strict=True)) for x in m or ()]
        alone = ranking.rank_towers(devices, asked.filter(F.col("receiver_id") == i).drop("measurements"), CONFIG, values)
        assert sorted((tuple(r) for r in together if r.receiver_id == i), key=str) == sorted(map(tuple, alone.collect()), key=str)
    many = spark.range(match.MAX_LITERAL + 1).selectExpr("1 AS receiver_id", "id AS ordinal", "89.3D AS freq_mhz", "1D AS snr_db", "1D AS score", "1D AS power_db", "1D AS obw_fraction")
    assert match.as_lists(many.limit(match.MAX_LITERAL)).selectExpr("size(measurements) AS n").first().n == match.MAX_LITERAL
    with pytest.raises(Exception, match="more than"):
        match.as_lists(many).collect()


def test_recall_without_signals(spark):
    towers = spark.createDataFrame([(True,)], "frequency_matched boolean")
    assert match.recall(towers, spark.createDataFrame([], "ordinal long")).first().recall == 0


def test_pages_end_where_they_should(spark):
    def page(edges, more=True, errors=None):
        import json

        body = {"data": {"systems": {"edges": edges, "pageInfo": {"hasNextPage": more}}}}
        return json.dumps(body | ({"errors": errors} if errors else {}))

    def edge(i, cursor=True):
        return {"cursor": str(i) if cursor else None, "node": {"id": f"s{i}"} if i % 7 else None}

    rows = [
        (0, 0, page([edge(1), edge(2)])), (0, 1, page([edge(3)], more=False)), (0, 2, page([edge(4)])),
        (1, 0, page([edge(5), edge(7)])), (1, 1, page([edge(7)])), (1, 2, page([edge(8)])),
        (2, 0, page([edge(9)])), (2, 1, page([edge(10)], errors="x")), (2, 2, page([edge(11)])),
        (3, 0, page([])), (3, 1, page([edge(12)])),
    ]
    pages = spark.createDataFrame(rows, "subtype_no int, page_no int, body string")
    got = [r.id for r in systems.page_systems(pages).orderBy("system_no").collect()]
    assert got == ["s1", "s2", "s3", "s5", "s9"]


def test_lines_feed_a_ranking(spark):
    fields = [""] * 40
    for i, v in {1: "KXYZ", 3: "DT", 4: "14", 9: "LIC", 10: "GREER", 11: "SC", 14: "100.   kW", 16: "300", 19: "N", 20: "34", 21: "50", 22: "0", 23: "W", 24: "82", 25: "20", 26: "0"}.items():
        fields[i] = v
    lines = spark.createDataFrame([("|".join(fields), 0), ("x" + "|".join(fields), 1), ("|a|b", 2)], "line string, ordinal long")
    found = as_devices(tv_stations(lines).withColumn("source_no", F.lit(0)))
    here = spark.createDataFrame([(1, 34.85, -82.4)], "receiver_id int, rx_lat double, rx_lon double")
    only = ranking.rank_towers(found, here, CONFIG).collect()
    assert [(r.callsign, r.frequency_mhz, r.name, r.eirp_dbm) for r in only] == [("KXYZ", 473.0, "Greer, SC", 82.2)]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('data: {"type":"step","channels":[{"band":"fm","fc_mhz":89.3,"score":"0.5","snr_db":1.0},{"band":"am","fc_mhz":1}]}\nnoise\ndata: {bad\n')
    (tmp_path / "in" / "b.txt").write_text('data: {"type":"step","channels":[{"band":"fm","fc_mhz":89.3,"score":0.9,"snr_db":2.0}]}\n')

    def run():
        best = stream.running_best(stream.read_stream(spark, str(tmp_path / "in")))
        stream.start(best, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return sorted((r.freq_mhz, r.score, r.snr_db) for r in stream.read_best(spark, str(tmp_path / "out")).collect())

    assert run() == [(89.3, 0.9, 2.0)]
    (tmp_path / "in" / "c.txt").write_text('data: {"type":"step","channels":[{"band":"fm","fc_mhz":89.3,"score":0.95,"snr_db":3.0},{"band":"fm","fc_mhz":90.1,"score":0.1}]}\n')
    assert run() == [(89.3, 0.95, 3.0), (90.1, 0.1, None)]


def test_feed_keeps_the_first_of_equals(spark, tmp_path):
    """Ties within a file, over files, over batches and after a restart, against a plain account."""
    rng = random.Random(3)
    folder, rows = tmp_path / "in", []
    folder.mkdir()

    def line(i):
        return json.dumps({"type": "step", "channels": [{"band": "fm", "fc_mhz": rng.choice([89.3, 90.1, 90.5]), "score": rng.choice([0.5, 0.7]), "snr_db": i + c / 2} for c in range(2)]})

    def run(n_files, first):
        for k in range(first, first + n_files):
            lines = [line(len(rows) + i) for i in range(40)]
            rows.extend(lines)
            (tmp_path / "new").write_text("".join(f"data: {x}\n" for x in lines))
            (tmp_path / "new").rename(folder / f"{k:03}.txt")
        best = stream.running_best(feed.read_feed(spark, str(folder)))
        stream.start(best, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return {r.freq_mhz: (r.score, r.snr_db) for r in stream.read_best(spark, str(tmp_path / "out")).collect()}

    def plain():
        kept = {}
        for x in rows:
            for c in json.loads(x)["channels"]:
                if c["fc_mhz"] not in kept or c["score"] > kept[c["fc_mhz"]][0]:
                    kept[c["fc_mhz"]] = (c["score"], c["snr_db"])
        return kept

    assert run(3, 0) == plain()
    assert run(2, 3) == plain()
    assert run(0, 5) == plain()


def test_feed_numbers_lines(tmp_path):
    reader = feed.FeedReader({"path": str(tmp_path)})
    assert reader.latestOffset() == reader.initialOffset()
    (tmp_path / "a").write_text("x\ny\n")
    (tmp_path / "_hidden").write_text("no\n")
    first = reader.latestOffset()
    (tmp_path / "b").write_text("z")
    last = reader.latestOffset()
    assert [list(reader.read(p)) for p in reader.partitions(reader.initialOffset(), first)] == [[("x", 0), ("y", 1)]]
    assert [list(reader.read(p)) for p in reader.partitions(first, last)] == [[("z", feed.LINES)]]
    assert reader.partitions(last, last) == []
    timed = feed.FeedReader({"path": str(tmp_path), "order": "time"})
    assert [p.value[1] for p in timed.partitions(timed.initialOffset(), timed.latestOffset())] == [0, 1]


def test_row_limits_beyond_two_hundred(spark):
    rows = [((0, i, 0), f"W{i}", "n", "s", 89.3, 34.9, -82.4, None, 100.0, None, None, "", "") for i in range(450)]
    here = spark.createDataFrame([(1, 34.85, -82.4, 400), (2, 34.85, -82.4, 3)], "receiver_id int, rx_lat double, rx_lon double, max_rows int")
    ranked = ranking.rank_towers(spark.createDataFrame(rows, SCHEMA), here, CONFIG)
    assert {r.receiver_id: r["count"] for r in ranked.groupBy("receiver_id").count().collect()} == {1: 400, 2: 3}


@pytest.mark.parametrize("per_degree", [1, 3, 40])
def test_cells_miss_no_pair(spark, per_degree):
    rng = random.Random(per_degree)
    places = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)] + [(90.0, 0.0), (-90.0, 10.0), (0.0, 180.0), (0.0, -180.0), (10.0, 179.99), (89.9, 120.0)]
    near = [(min(90.0, max(-90.0, la + rng.uniform(-1, 1))), (lo + rng.uniform(-2, 2) + 540) % 360 - 180) for la, lo in places for _ in range(5)]
    devices = spark.createDataFrame([((0, i, 0), *p) for i, p in enumerate(near)], "ord struct<source_no:int,system_no:bigint,device_no:int>, lat double, lon double")
    receivers = spark.createDataFrame([(i, *p, 100.0) for i, p in enumerate(places)], "receiver_id int, rx_lat double, rx_lon double, radius_km double")
    got = {(r.receiver_id, r.ord.system_no) for r in ranking.in_radius(devices, receivers, 222.0 / per_degree).collect()}

    def km(a, b):
        p, q = math.radians(a[0]), math.radians(b[0])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(max(1 - h, 0)))

    assert got == {(i, j) for i, p in enumerate(places) for j, q in enumerate(near) if km(p, q) <= 100.0} and got


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_plan_pairs_all_with_all(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # Only what asks a service beyond Spark runs Python.
    assert ("Python" in plan or "InPandas" in plan or "BatchScan" in plan) == (name in ("paged_scan", "paged_pushdown", "lookup_elevations"))


def test_readers(spark, tmp_path):
    (tmp_path / "tv.txt").write_text("header\n|" + "|".join(["KXYZ", "", "DT", "14", *[""] * 4, "LIC", "GREER", "SC", "", "", "100.   kW", "", "300", "", "", "N", "34", "50", "0", "W", "82", "20", "0", *[""] * 9]) + "\n|short|line\n")
    stations_ = tv_stations(stations.read_lines(spark, str(tmp_path / "tv.txt"))).collect()
    assert [(s.callsign, s.mhz, s.id) for s in stations_] == [("KXYZ", 473.0, "fcc-tv-KXYZ-14")]

    node = {"id": "s1", "devices": [{"callsign": "A", "frequency": 89.3, "eirp": {"value": "100"}, "location": {"name": "n", "state": "SC", "geom": {"string": "POINT(-82.4 34.9)"}}}], "licence": {"type": "Broadcasting", "subtype": "Commercial Radio"}}
    (tmp_path / "systems.json").write_text(json.dumps(node) + "\n" + json.dumps(node | {"id": "s2", "devices": None}) + "\n")
    export = systems.read_systems(spark, str(tmp_path / "systems.json"))
    (device,) = systems.explode_devices(export).collect()
    assert (device.callsign, device.freq, device.eirp_w, device.lat, device.lon) == ("A", 89.3, 100.0, 34.9, -82.4)
    assert systems.asked_for(export, "au").count() == 2 and systems.asked_for(export, "us").count() == 1

    ok = json.dumps({"data": {"systems": {"edges": [{"cursor": "1", "node": node}], "pageInfo": {"hasNextPage": False}}}})
    pages = [("au", 0, 0, ok), ("au", 1, 0, "not json"), ("au", 2, 0, ok), ("au", 3, 0, ok), ("us", 0, 0, ok), ("us", 1, 0, ok)]
    (tmp_path / "pages.json").write_text("".join(json.dumps(dict(zip(("source", "subtype_no", "page_no", "body"), p, strict=True))) + "\n" for p in pages))
    captured = systems.read_pages(spark, str(tmp_path / "pages.json"))
    assert [systems.source_systems(captured, s).count() for s in ("au", "us", "ca")] == [2, 1, 0]

    square = [[[-10, -10], [10, -10], [10, 10], [-10, 10], [-10, -10]]]
    features = [{"properties": {"ADMIN": a}, "geometry": {"type": t, "coordinates": c}} for a, t, c in (("Canada", "Polygon", [[[0, 0], [1, 0], [1, 1]]]), ("Canada", "Polygon", square), ("Elsewhere", "Polygon", square), ("Australia", "MultiPolygon", [[[[20, 0], [30, 0], [30, 10], [20, 10]]], [[[40, 0], [50, 0], [45, 10]]]]))]
    (tmp_path / "borders.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    edges = regions.edges(regions.read_borders(spark, str(tmp_path / "borders.json")))
    points = spark.createDataFrame([(0.5, 9.9), (10.0, 0.0), (45.0, 5.0), (35.0, 5.0), (None, 1.0)], "lon double, lat double")
    assert [r.region for r in region.classify(points, edges).orderBy(F.col("lon").asc_nulls_last()).collect()] == ["ca", "ca", None, "au", None]


def test_answers_and_captures(spark, tmp_path):
    devices = spark.createDataFrame(made_up(7, 40), SCHEMA)
    asked = spark.createDataFrame([(1, 34.85, -82.4, 80.0), (2, -60.0, 10.0, 80.0)], "receiver_id int, rx_lat double, rx_lon double, radius_km double")
    ranked = ranking.rank_towers(devices, asked, CONFIG)
    found = {r.receiver_id: json.loads(r.document) for r in enrich.result_documents(ranked, asked, "us").collect()}
    assert found[2] == {"towers": [], "query": {"latitude": -60.0, "longitude": 10.0, "altitude_m": 0.0, "radius_km": 80.0, "source": "us"}, "count": 0}
    want = [r.asDict() for r in ranked.filter("receiver_id = 1").drop("receiver_id").orderBy("rank").collect()]
    assert found[1]["towers"] == want and found[1]["count"] == len(want) > 5

    raw = spark.createDataFrame([(i, f"s{i}", None, None) for i in range(20)], "system_no long, " + SYSTEM)
    enrich.write_captures(raw, ranked, str(tmp_path / "captures"))
    assert [r.id for r in systems.read_systems(spark, str(tmp_path / "captures" / "raw")).orderBy("system_no").collect()] == [f"s{i}" for i in range(20)]
    assert spark.read.json(str(tmp_path / "captures" / "matched")).count() == len(want)


@pytest.mark.parametrize("config", [CONFIG, queries.BY_POWER])
def test_stages_rank_as_the_plain_plan_does(spark, config):
    """Full and empty limits, ties, powers next to a half, close frequencies, some that measure: row for row, and repeated ids as before."""
    rng = random.Random(11)
    devices = spark.createDataFrame(made_up(11, 400) + [((1, i, 0), f"W{i % 6}", "n", "s", 177.0, 34.85 + i / 100, -82.4, None, rng.choice([float("inf"), 50.0, 100.0]), None, None, "", "") for i in range(40)], SCHEMA)
    measured = [(j, f, 1.0, s, None, 0.5) for j, (f, s) in enumerate([(89.2, 0.5), (475.0, 0.9), (178.5, 0.5), (89.31, 0.7)])]
    schema = "receiver_id int, rx_lat double, rx_lon double, radius_km double, max_rows int, measurements array<struct<ordinal:bigint,freq_mhz:double,snr_db:double,score:double,power_db:double,obw_fraction:double>>"
    rows = [(i, 34.8 + (i % 7) / 10, -82.4, 15.0 + 9 * (i % 5), 1 + i % 13, rng.choice([None, [], measured, measured[:1], measured[2:3]])) for i in range(40)]
    asked = spark.createDataFrame(rows, schema)
    table = spark.createDataFrame(measured, "ordinal long, freq_mhz double, snr_db double, score double, power_db double, obw_fraction double")

    def listed(frame):
        return sorted(map(str, frame.collect()))

    for m in (None, table, [{"freq_mhz": 178.5, "score": 0.5}]):
        want = listed(ranking.rank_towers(devices, asked.drop("measurements"), config, m))
        assert listed(ranking.rank_towers(devices, asked.drop("measurements"), config, m, 35.0, 13)) == want and len(want) > 40
    want = listed(ranking.rank_requests(devices, asked, config))
    assert listed(ranking.rank_requests(devices, asked, config, 35.0, 13)) == want and len(want) > 40
    twice = asked.drop("measurements").withColumn("receiver_id", F.col("receiver_id") % 30).withColumn("max_rows", F.lit(5))
    assert not ranking.in_stages(twice, 13)
    assert listed(ranking.rank_towers(devices, twice, config, None, 35.0, 13)) == listed(ranking.rank_towers(devices, twice, config))


def test_filled_receivers_do_not_meet_later_bands(spark):
    from rfrank.shared import shared_dir

    def stages_written():
        top = shared_dir(spark).removeprefix("file:")
        return len(list(Path(top).glob("ranked-*")))

    devices = spark.createDataFrame(made_up(12, 300), SCHEMA)
    for most, stages in ((3, 1), (60, 3)):
        here = spark.createDataFrame([(i, 34.85, -82.4, 80.0, most) for i in range(5)], "receiver_id int, rx_lat double, rx_lon double, radius_km double, max_rows int")
        before = stages_written()
        assert ranking.rank_towers(devices, here, CONFIG, most_rows=most).count() > 0
        assert stages_written() - before == stages
    near = {**CONFIG.to_dict(), "broadcast_bands": {"FM": [[88, 108]], "VHF": [[108.0004, 216]]}}
    assert ranking.band_stages(CONFIG) == [["VHF"], ["UHF"], ["FM"]] and ranking.band_stages(RankingConfig.from_dict(near)) == [["FM", "VHF"]]


def test_tenths_of_powers(spark):
    """Half to even on the decimal value, as ``bround`` has it."""
    rows = [(x / 40,) for x in range(-400, 400)] + [(1e-7 + x / 20,) for x in range(50)] + [(-79.25,), (-79.35,), (0.05,), (0.15,), (float("inf"),), (float("nan"),)]
    got = spark.createDataFrame(rows, "p double").select(ranking._tenths(F.col("p")).alias("t"), F.bround("p", 1).alias("b")).collect()
    assert all(r.t == round(r.b * 10) for r in got[:-2]) and got[-2].t == 2**22 and got[-1].t == -(2**22)
