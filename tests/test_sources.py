"""Paged services, folders by state, elevations in batches, numbers over many tasks, answers end to end."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
import transports
from pyspark.sql import functions as F

from rfrank import queries
from rfrank.operators import enrich, numbering, ranking, region
from rfrank.plans.answer import find_towers, with_source
from rfrank.plans.config import RankingConfig
from rfrank.sources import derived, elevations, paged, regions, stations, systems

CONFIG = RankingConfig.default()


def page(edges, more=True, errors=None):
    body = {"data": {"systems": {"edges": edges, "pageInfo": {"hasNextPage": more}}}}
    return body | ({"errors": errors} if errors else {})


def edge(i, cursor=True):
    return {"cursor": str(i) if cursor else None, "node": transports.node(i, 89.3, "Commercial Radio") if i % 7 else None}


class Replay:
    def __init__(self, bodies):
        self.bodies, self.asked = list(bodies), []

    def send(self, part, cursor, page_size):
        self.asked.append(cursor)
        return self.bodies[len(self.asked) - 1]


PART = paged.Part(0, 0, paged.Request("au", 1.0, 2.0, 80.0, "Commercial Radio"))


@pytest.mark.parametrize("bodies, want, asked", [
    ([page([edge(1), edge(2)]), page([edge(3)], more=False), page([edge(4)])], [[1, 2], [3]], ["", "2"]),  # no next page
    ([page([edge(1)]), page([]), page([edge(4)])], [[1], []], ["", "1"]),  # no edges
    ([page([edge(1)]), page([edge(1, cursor=False)]), page([edge(4)])], [[1], [1]], ["", "1"]),  # the cursor does not move
    ([page([edge(1)]), page([edge(2)], errors="x"), page([edge(4)])], [[1]], ["", "1"]),  # errors: what came before stays
    ([page([edge(1)]), page([edge(2)]), page([edge(3)]), page([edge(4)])], [[1], [2], [3]], ["", "1", "2"]),  # as many pages as wanted
    ([{"data": None}], [[]], [""]), ([{}], [[]], [""]), ([{"data": {"systems": {"edges": None}}}], [[]], [""]),
])
def test_pages_end(bodies, want, asked):
    replay = Replay(bodies)
    got = [[int(e["node"]["id"][1:]) for e in edges] for _, edges in paged.pages(PART, replay, 3, 5)]
    assert got == want and replay.asked == asked


def test_request_text():
    text = paged.Request("au", -33.9, 151.2, 80.0, 'Commercial "Radio"', 88.0, 108.5).query('c"1', 5)
    for said in ('first: 5 after: "c\\"1" source: "au"', '{ type: CIRCLE, values: ["-33.9,151.2", "80"] }', '{ field: licence_subtype, values: "Commercial \\"Radio\\"" }', '{ field: device_frequency, type: RANGE, values: ["88000000", "108500000"] }', "pageInfo { hasNextPage }", "frequency(unit: MHz)"):
        assert said in text
    assert text.count("{") == text.count("}")


def test_equals_the_captured_pages(spark, sf_dir, tmp_path):
    """Row for row what ``page_systems`` reads from the same answers, with as many pages."""
    derived.write_answers(spark, sf_dir, str(tmp_path / "answers"))
    recorded = spark.read.schema("request_no int, subtype_no int, after string, body string").json(str(tmp_path / "answers"))
    numbered = recorded.selectExpr("request_no * 3 + subtype_no AS subtype_no", "CAST(row_number() OVER (PARTITION BY request_no, subtype_no ORDER BY TRY_CAST(after AS BIGINT) NULLS FIRST) - 1 AS INT) AS page_no", "body")
    key = F.struct((F.col("ord.system_no.request_no") * 3 + F.col("ord.system_no.subtype_no")).alias("s"), "ord.system_no.page_no", "ord.system_no.edge_no").alias("key")
    columns = ["callsign", "name", "state", "freq", "lat", "lon", "height_m", "eirp_w", "transmit_w", "gain_dbi", "licence_type", "licence_subtype"]
    want = systems.explode_devices(systems.page_systems(numbered)).select(F.struct(F.col("ord.system_no.subtype_no").alias("s"), "ord.system_no.page_no", "ord.system_no.edge_no").alias("key"), *columns)
    rows = paged.read_paged(spark, derived.paged_requests(), "captures", path=str(tmp_path / "answers"), page_size=20)
    got = paged.as_devices(rows).select(key, *columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 24 * 60
    missing = paged.read_paged(spark, [*derived.paged_requests(), {"source": "ca", "lat": 0, "lon": 0}], "captures", path=str(tmp_path / "answers"))
    assert [(r.request_no, r.subtype_no) for r in paged.failures(missing).collect()] == [(8, 0), (8, 1), (8, 2)]
    assert paged.as_devices(missing).count() == got.count()


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    """Workers find the module of transports as they would on a cluster."""
    spark.sparkContext.addPyFile(transports.__file__)


@pytest.fixture
def service(tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(systems.SUBTYPES), rng.choice([89.3, 99.1, 177.0, 205.0, 500.0, 600.0]), rng.choice([10, 40, 75])) for _ in range(120)]
    (tmp_path / "held.json").write_text(json.dumps(rows))

    def read(spark, source="au", **more):
        noted = tmp_path / f"noted-{random.random()}"
        noted.mkdir()
        asked = [{"source": source, "lat": 34.0, "lon": -82.4}, {"source": source, "lat": 35.0, "lon": -82.4, "radius_km": 50}]
        return paged.read_paged(spark, asked, "transports:Service", held=str(tmp_path / "held.json"), noted=str(noted), max_pages=100, **more), noted

    def sent(noted):
        return sum(int(f.name.rsplit("-", 1)[1]) for f in noted.iterdir())

    return rows, read, sent


@pytest.mark.parametrize("where, keep", [
    ("licence_subtype = 'Commercial Radio'", lambda r, km: r[0] == "Commercial Radio"),
    ("licence_subtype IN ('Commercial Radio', 'National Broadcasting') AND mhz >= 100", lambda r, km: r[0] != "Commercial Television" and r[1] >= 100),
    ("mhz BETWEEN 88 AND 108", lambda r, km: 88 <= r[1] <= 108), ("mhz > 90 AND mhz < 550 AND mhz <> 177", lambda r, km: 90 < r[1] < 550 and r[1] != 177), ("mhz = 177", lambda r, km: r[1] == 177),
    ("radius_km = 20", lambda r, km: r[2] <= 20), ("request_no = 1", lambda r, km: km == 50), ("source = 'ca'", lambda r, km: False), ("mhz > 300 AND mhz < 200", lambda r, km: False),
    ("mhz > 550 OR licence_subtype = 'Commercial Radio'", lambda r, km: r[1] > 550 or r[0] == "Commercial Radio"), ("id IS NOT NULL", lambda r, km: True),
])
def test_filters_become_requests(spark, service, where, keep):
    rows, read, sent = service
    frame, noted = read(spark)
    got = sorted((r.request_no, int(r.id[1:])) for r in frame.filter(where).select("request_no", "id").collect())
    want = sorted((no, i) for no, km in enumerate((80, 50)) for i, r in enumerate(rows) if keep(r, km) and (r[2] <= km if "radius" not in where else True))
    assert got == want
    plain, all_noted = read(spark)
    assert plain.count() == sum(r[2] <= 80 for r in rows) + sum(r[2] <= 50 for r in rows) == sent(all_noted)
    if "OR" in where or "NOT NULL" in where:
        assert sent(noted) == sent(all_noted)
    else:  # what is fetched is what is wanted, or little more
        assert len(want) <= sent(noted) <= len(want) + sum(r[1] == 177 for r in rows) * 2 * ("<>" in where)
        assert sent(noted) < sent(all_noted)


def test_a_country_asked_by_range(spark, service):
    rows, read, sent = service
    frame, noted = read(spark, "us")
    assert frame.filter("request_no = 0 AND mhz >= 470").count() == sum(r[1] >= 470 and r[2] <= 80 for r in rows) == sent(noted)


def test_a_failing_subtype_gives_nothing_and_the_others_stay(spark, service):
    rows, read, _ = service
    frame, _ = read(spark, failing="Commercial Radio", page_size=3)
    frame = frame.cache()
    assert paged.as_devices(frame).select("licence_subtype").distinct().count() == 2
    assert {(r.request_no, r.subtype_no, r.error) for r in paged.failures(frame).collect()} == {(0, 2, "TimeoutError: no answer"), (1, 2, "TimeoutError: no answer")}
    strict, _ = read(spark, failing="Commercial Radio", page_size=3, on_error="fail")
    with pytest.raises(Exception, match="no answer"):
        strict.collect()


class Handler(BaseHTTPRequestHandler):
    asked = []

    def do_POST(self):
        query = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["query"]
        Handler.asked.append((self.headers["X-Api-Key"], query))
        cursor = query.split('after: "')[1].split('"')[0]
        body = page([edge(int(cursor or 0) + 1)], more=int(cursor or 0) < 4)
        self._send(200, json.dumps(body).encode()) if "National" not in query else self._send(503, b"")

    def do_GET(self):
        asked = parse_qs(urlparse(self.path).query)
        self._send(200, json.dumps({"elevation": [float(x) * 2 for x in asked["latitude"][0].split(",")]}).encode())

    def _send(self, code, body):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def endpoint():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_over_http(spark, endpoint):
    Handler.asked.clear()
    rows = paged.read_paged(spark, [{"source": "AU", "lat": -33.9, "lon": 151.2}], endpoint=endpoint, api_key="k1").cache()
    assert sorted((r.subtype_no, r.page_no, r.id) for r in rows.filter("error is null").collect()) == [(s, p, f"s{p + 1}") for s in (0, 2) for p in range(3)]
    assert [r.subtype_no for r in paged.failures(rows).collect()] == [1] and {k for k, _ in Handler.asked} == {"k1"}
    assert any('values: "Commercial Television"' in q for _, q in Handler.asked)


# Folders by state


def test_states_are_pruned_and_failing_ones_reported(spark, sf_dir, tmp_path):
    lines = derived.state_lines(spark, sf_dir)
    folder = str(tmp_path / "states")
    stations.write_states(lines, folder)
    wanted = region.nearby_states(derived.receiver(spark), "receiver_id", "rx_lat", "rx_lon")
    near = stations.near_states(stations.read_states(spark, folder), wanted)
    states = {r.state for r in wanted.collect()}
    found = near.collect()
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and len(states) < 6
    expected = [(r.ordinal, r.line) for r in lines.collect() if r.line.startswith("|") and r.line.split("|")[11].strip() in states]
    assert sorted((r.ordinal, r.line) for r in found) == sorted(expected) and expected
    broken, gone = sorted(states)[:2]
    for f in (tmp_path / "states" / f"state={broken}").iterdir():
        f.write_bytes(b"not a file of this kind")
    for f in (tmp_path / "states" / f"state={gone}").iterdir():
        f.unlink()
    again = stations.read_states(spark, folder)
    assert {r.state for r in stations.unanswered(again, wanted).collect()} == {broken, gone}
    assert {r.state for r in stations.near_states(again, wanted).select("state").distinct().collect()} == states - {broken, gone}


def test_read_files_of_wanted_states_only(spark, sf_dir, tmp_path):
    """By the metrics of the scan: files of other states are not opened."""
    stations.write_states(derived.state_lines(spark, sf_dir), str(tmp_path / "states"))
    wanted = region.nearby_states(derived.receiver(spark), "receiver_id", "rx_lat", "rx_lon")
    near = stations.near_states(stations.read_states(spark, str(tmp_path / "states")), wanted)
    files = near.select(F.input_file_name().alias("f")).distinct().collect()
    states = {r.state for r in wanted.collect()}
    assert {r.f.split("state=")[1].split("/")[0] for r in files} == states
    assert len(list((tmp_path / "states").glob("state=*"))) == len(region.STATES)


# Elevations


def test_answers_by_position():
    assert elevations.answers(lambda a, b: [1, None, 3.5], [(0.0, 1.0), (2.0, 3.0), (4.0, 5.0), (6.0, 7.0)]) == [(0.0, 1.0, 1.0), (4.0, 5.0, 3.5)]
    assert elevations.answers(transports.broken, [(0.0, 1.0)]) == [] and elevations.answers(transports.broken, []) == []
    assert elevations.answers(lambda a, b: None, [(0.0, 1.0)]) == [] and elevations.answers(lambda a, b: ["x"], [(0.0, 1.0)]) == []


def test_lookup(spark, endpoint):
    rows = [(1.0000001, 5.0), (1.0, 5.0), (2.0, 5.0), (-3.0, 5.0), (None, 5.0), (float("nan"), 1.0), (7.0, 5.0)]
    places = spark.createDataFrame(rows, "latitude double, longitude double")
    asked = elevations.lookup_elevations(places, "transports:known_ground", callers=1)
    assert sorted(tuple(r) for r in asked.collect()) == [(1.0, 5.0, 10.0), (2.0, 5.0, 20.0)]  # the last, 7.0, has no answer
    assert elevations.lookup_elevations(places, transports.broken).count() == 0
    assert elevations.lookup_elevations(places.limit(0), transports.broken).count() == 0
    over = elevations.lookup_elevations(places, elevations.HttpClient(endpoint))
    assert sorted(tuple(r) for r in over.collect()) == [(la, 5.0, 2 * la) for la in (-3.0, 1.0, 2.0, 7.0)]
    assert elevations.lookup_elevations(places, elevations.HttpClient("http://127.0.0.1:9")).count() == 0


def test_lookup_in_batches(spark):
    sizes = spark.sparkContext.accumulator(0)
    calls = spark.sparkContext.accumulator(0)

    def client(lats, lons):
        assert len(lats) <= 7 and list(lats) == sorted(lats)
        calls.add(1)
        sizes.add(len(lats))
        return [1.0] * len(lats)

    places = spark.range(100).selectExpr("CAST(id % 50 AS DOUBLE) AS latitude", "1D AS longitude")
    assert elevations.lookup_elevations(places, client, batch=7, callers=2).count() == 50
    assert sizes.value == 50 and calls.value <= 9


# Numbers over many tasks


def test_numbers_equal_a_window(spark):
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(40), rng.choice(["a", "b", None]), i) for i in range(5000)] + [(9, 1, "x", 5000)]
    frame = spark.createDataFrame(rows, "receiver_id int, power int, name string, ord long")
    order = [F.col("power").desc(), F.col("name").asc(), F.col("ord").asc()]
    got = {r.ord: r["rank"] for r in numbering.numbered(frame, ["receiver_id"], order).collect()}
    want = {r.ord: r["rank"] for r in frame.selectExpr("ord", "row_number() OVER (PARTITION BY receiver_id ORDER BY power DESC, name, ord) AS rank").collect()}
    assert got == want
    assert numbering.numbered(frame.limit(0), ["receiver_id"], order).count() == 0


def test_no_task_sorts_a_whole_group(spark):
    """One group of all rows is written in parts of about equal size."""
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.range(40_000).selectExpr("1 AS receiver_id", "hash(id) AS power", "id AS ord")
        ranked = numbering.numbered(frame, ["receiver_id"], [F.col("power").desc(), F.col("ord").asc()])
        path = ranked.inputFiles()
        sizes = [spark.read.parquet(p).count() for p in path]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    assert len(path) >= 4 and max(sizes) < 0.5 * 40_000 and sum(sizes) == 40_000


def test_more_rows_than_told_fail(spark):
    devices = spark.createDataFrame([((0, i, 0), f"W{i}", "n", "s", 89.3, 34.9, -82.4, None, 100.0, None, None, "", "") for i in range(30)], "ord struct<source_no:int,system_no:bigint,device_no:int>, callsign string, name string, state string, freq double, lat double, lon double, height_m double, eirp_w double, transmit_w double, gain_dbi double, licence_type string, licence_subtype string")
    here = spark.createDataFrame([(1, 34.85, -82.4, 20)], "receiver_id int, rx_lat double, rx_lon double, max_rows int")
    with pytest.raises(Exception, match="more rows than"):
        ranking.rank_towers(devices, here, CONFIG, most_rows=10).collect()
    assert ranking.rank_towers(devices, here, CONFIG, most_rows=20).count() == ranking.rank_towers(devices, here, CONFIG).count() == 20


# Answers


def test_sources_of_requests(spark):
    square = spark.createDataFrame([(0, "au", [[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]]])], "region_no int, region string, rings array<array<array<double>>>")
    edges = regions.edges(square)
    rows = [(1, 5.0, 5.0, "auto"), (2, 50.0, 50.0, "AUTO"), (3, 5.0, 5.0, "ca"), (4, 5.0, 5.0, None), (5, 5.0, 5.0, "US")]
    asked = spark.createDataFrame(rows, "receiver_id int, rx_lat double, rx_lon double, source string")
    assert {r.receiver_id: r.source for r in with_source(asked, edges).collect()} == {1: "au", 2: "us", 3: "ca", 4: "au", 5: "us"}
    assert {r.receiver_id: r.source for r in with_source(asked.drop("source"), edges).collect()} == {1: "au", 2: "us", 3: "au", 4: "au", 5: "au"}
    with pytest.raises(Exception, match="no such source"):
        with_source(asked.withColumn("source", F.lit("uk")), edges).collect()


def test_answers_of_each_source(spark, sf_dir):
    devices = derived.devices(spark, sf_dir)
    square = spark.createDataFrame([(0, "au", [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]])], "region_no int, region string, rings array<array<array<double>>>")
    lat, lon = derived.RECEIVER
    asked = spark.createDataFrame([(1, lat, lon, "us", 0.0), (2, lat, lon, "au", 55.0), (3, 0.5, 0.5, "auto", 0.0), (4, lat, lon, "ca", 0.0)], "receiver_id int, rx_lat double, rx_lon double, source string, altitude_m double")
    ground = spark.createDataFrame([(lat, lon, 321.0)], "lat6 double, lon6 double, elevation_m double")
    found = {r.receiver_id: (r.source, json.loads(r.document)) for r in find_towers(asked, regions.edges(square), {"us": devices, "au": devices.filter("ord.system_no % 2 = 0")}, CONFIG, ground).collect()}
    assert {i: s for i, (s, _) in found.items()} == {1: "us", 2: "au", 3: "au", 4: "ca"}
    assert found[1][1]["count"] == CONFIG.default_limit and found[3][1]["count"] == found[4][1]["count"] == 0
    assert [found[i][1]["query"]["altitude_m"] for i in (1, 2, 3, 4)] == [321.0, 55.0, 0.0, 321.0]
    want = [r.callsign for r in enrich.add_elevations(ranking.rank_towers(devices, derived.receiver(spark), CONFIG), ground).orderBy("rank").collect()]
    assert [t["callsign"] for t in found[1][1]["towers"]] == want


def test_table_function_with_points(spark, sf_dir):
    plan = queries.fn_nearby_states(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan
