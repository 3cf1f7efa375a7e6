"""Configuration, the HTTP face, calendars, pattern-based queries and the density clustering."""

import json
import threading
import urllib.error
import urllib.request

import duckdb
import pytest

from perron import queries, server
from perron.operators import calendar, clustering, patterns, raptor
from perron.sources.config import ConfigError, load_config, parse_distance
from perron.sources.events_timetable import Timetable

SF = "/root/testdata/sf0.001"
STOP_TIMES = "trip_id long, stop_id int, stop_sequence int, arrival_time long, departure_time long"
WALKS = "from_stop int, to_stop int, duration_ms long"


@pytest.fixture(scope="module")
def small(spark):
    st = spark.createDataFrame([(0, 0, 0, 100_000, 100_000), (0, 1, 1, 500_000, 500_000), (1, 2, 0, 1_000_000, 1_000_000), (1, 3, 1, 1_500_000, 1_500_000)], STOP_TIMES)
    stops = spark.createDataFrame([(i, 0.0, float(i)) for i in range(4)], "stop_id int, lat double, lon double")
    trips = spark.createDataFrame([(0, 0), (1, 0)], "trip_id long, service_id int")
    return Timetable(stops, trips, None, st), spark.createDataFrame([(1, 2, 10_000), (2, 1, 10_000)], WALKS)


def test_config(tmp_path):
    (tmp_path / "a.yaml").write_text("version: 1\ndatasets:\n  - {id: x, format: gtfs, src: {path: a.zip}, license: ' CC0-1.0'}\ndataset_groups:\n  - {id: g, consistency: {stop_ids: true, stop_coordinates: {radius: 10m}}}\n")
    c = load_config(str(tmp_path / "a.yaml"))
    assert c.datasets[0].location == "a.zip" and c.datasets[0].license == "CC0-1.0" and c.validate
    assert c.consistency["g"] == {"stop_ids": True, "trip_ids": {"tolerance": 0.5}, "stop_coordinates": {"radius": 10.0}}
    (tmp_path / "b.json").write_text(json.dumps({"version": "1", "datasets": [], "features": {"preprocessing": {"validation": False}}}))
    assert not load_config(str(tmp_path / "b.json")).validate
    for name, text in (("c.json", "{"), ("d.txt", ""), ("e.json", '{"version": "2", "datasets": []}'), ("f.json", '{"version": 1, "datasets": [{"id": "x"}]}')):
        (tmp_path / name).write_text(text)
        with pytest.raises(ConfigError):
            load_config(str(tmp_path / name))
    assert parse_distance("42.5m") == 42.5 and parse_distance(3) == 3.0
    with pytest.raises(ConfigError):
        parse_distance("3 km")


def test_http(spark, small):
    s = server.make_server(*small, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()

    def get(path):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{s.server_port}{path}", timeout=120) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    status, body = get("/api/v1/routing?earliest_departure=0&range=101&start=0&target_type=all")
    assert status == 200 and sorted(len(j["legs"]) for j in body["journeys"]) == [1, 2, 3]
    assert get("/api/v1/routing?earliest_departure=0&range=98&start=3&target_type=all")[0] == 404
    assert get("/api/v1/routing?earliest_departure=0&range=98&start=3&target_type=single")[0] == 400
    assert get("/api/v1/routing?start=3")[0] == 400 and get("/x")[0] == 404
    assert get("/api/v1/stats") == (200, {"num_stops": 4, "num_clusters": 0, "num_trips": 2})
    s.shutdown()


def test_calendar(spark):
    flags = {d: d == "monday" for d in calendar.DAYS}
    row = [(1, *flags.values(), None, None), (2, *flags.values(), "2024-01-02", None)]
    sv = spark.createDataFrame(row, "service_id int, " + ", ".join(f"{d} boolean" for d in flags) + ", start_date string, end_date string").selectExpr("service_id", *flags, "date(start_date) start_date", "date(end_date) end_date")
    assert sorted((r[0], str(r[1])) for r in calendar.service_days(sv, "2024-01-01", "2024-01-14").collect()) == [(1, "2024-01-01"), (1, "2024-01-08"), (2, "2024-01-08")]


def test_patterns(spark, small):
    t, walks = small
    found = spark.createDataFrame([(0, [], 1), (0, [1], 2), (0, [1, 2], 3), (0, [2], 1)], "start int, intermediates array<int>, target int")
    ask = spark.createDataFrame([(7, 0, 0), (8, 0, 200_000)], "query_id int, start int, tau long")
    assert {tuple(r) for r in patterns.pattern_arrivals(found, t.stop_times, walks, ask).collect()} == {(7, 0, 1, 500_000), (7, 0, 2, 510_000), (7, 0, 3, 1_500_000)}
    assert patterns.pattern_arrivals(found.limit(0), t.stop_times, walks, ask).count() == 0


def test_patterns_agree_with_rounds(spark):
    by_rounds = {(r["query_id"], r["stop_id"]): r["arrival"] for r in queries.QUERIES["earliest_arrival_all"](spark, SF).collect()}
    assert {(r["query_id"], r["target"]): r["arrival"] for r in queries.QUERIES["pattern_arrivals"](spark, SF).collect()} == by_rounds


def test_density(spark):
    line = [(i, 48.0 + i * 0.001, 9.0) for i in range(6)] + [(90, 50.0, 9.0)]
    stops = spark.createDataFrame(line, "stop_id int, lat double, lon double")
    assert {r[0]: r[1] for r in clustering.optics(stops, 120.0, 3, 6).collect()} == {**dict.fromkeys(range(6), 1), 90: -1}
    assert {r[1] for r in clustering.optics(stops, 120.0, 3, 7).collect()} == {-1}


@pytest.mark.parametrize("name", ["service_days", "dated_stop_times", "optics_clusters"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    df, r = queries.QUERIES[name](spark, SF), con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(r.columns)
    order = [r.columns.index(c) for c in columns]
    assert sorted(str([x[c] for c in columns]) for x in df.collect()) == sorted(str([x[i] for i in order]) for x in r.fetchall())
