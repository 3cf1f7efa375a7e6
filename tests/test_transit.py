"""Golden networks, a feed round trip, and the queries against DuckDB on the smallest tables."""

import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from perron import queries
from perron.functions.transit import gtfs_time_ms, haversine, travel_ms
from perron.operators import raptor
from perron.sources import gtfs

SF = "/root/testdata/sf0.001"
STOP_TIMES = "trip_id long, stop_id int, stop_sequence int, arrival_time long, departure_time long"
WALKS = "from_stop int, to_stop int, duration_ms long"


def times(spark, trips):
    """{trip: [(stop, arr s, dep s), ...]}"""
    ms = lambda x: None if x is None else x * 1000
    return spark.createDataFrame([(t, s, i, ms(a), ms(d)) for t, v in trips.items() for i, (s, a, d) in enumerate(v)], STOP_TIMES)


@pytest.fixture(scope="module")
def case4(spark):
    n = None
    trips = {
        1001: [(0, n, 20), (2, 100, 110), (3, 300, n)], 1002: [(0, n, 220), (2, 250, 310), (3, 350, n)], 1011: [(3, n, 20), (2, 100, 110), (1, 150, n)], 1012: [(3, n, 220), (2, 300, 310), (1, 350, n)],
        1201: [(1, n, 0), (2, 80, 90), (4, 300, n)], 1202: [(1, n, 400), (2, 480, 490), (4, 700, n)], 1301: [(0, n, 0), (3, 250, n)],
    }
    return times(spark, trips), spark.createDataFrame([(3, 4, 410_000), (4, 3, 410_000)], WALKS)


def legs(rows):
    return {tuple((x["kind"], x["trip_id"], x["start"], x["end"]) for x in r["legs"]) for r in rows}


def test_best_arrivals(spark, case4):
    best = raptor.earliest_arrivals(*case4, spark.createDataFrame([(1, 0, 0)], "query_id int, stop_id int, tau long")).collect()
    assert {r["stop_id"]: r["tau"] // 1000 for r in best} == {0: 0, 1: 150, 2: 100, 3: 250, 4: 660}


def test_range(spark, case4):
    assert legs(raptor.range_query(*case4, 0, 0, 1000).where("departure = 0").collect()) >= {(("ride", 1301, 0, 3),), (("ride", 1301, 0, 3), ("walk", None, 3, 4))}
    found = legs(raptor.range_query(*case4, 0, 1000, 20_000).collect())
    assert found == {(("ride", 1001, 0, 2), ("ride", 1011, 2, 1)), (("ride", 1001, 0, 2),), (("ride", 1001, 0, 3),), (("ride", 1001, 0, 2), ("ride", 1202, 2, 4))}


def test_one_trip(spark):
    st, walks = times(spark, {0: [(0, 100, 100), (1, 500, 500)]}), spark.createDataFrame([], WALKS)
    with pytest.raises(raptor.NoRouteFound):
        raptor.one_route(raptor.range_query(st, walks, 0, 0, 98_000))
    found = raptor.range_query(st, walks, 0, 0, 101_000)
    assert legs(found.collect()) == {(("ride", 0, 0, 1),)}
    assert raptor.transfer_patterns(found).collect() == [(0, [], 1)]
    assert '"boarding_time":100' in raptor.journeys_json(found).first()["json"]


def test_pattern_graph(spark):
    p = spark.createDataFrame([(0, [], 1), (0, [1], 2)], "start int, intermediates array<int>, target int")
    assert {(r["node"], r["before"]) for r in raptor.pattern_edges(p).collect()} == {("target:1", "root"), ("prefix:0>1", "root"), ("target:2", "prefix:0>1")}


def test_all_rides_and_departures(spark, tmp_path):
    """A direct ride at six and three rides from nine on, of stops that no walk links."""
    trips = [[(90, 6), (50, 7)], [(90, 9), (5, 10)], [(5, 11), (99, 12)], [(99, 13), (50, 14)]]
    rows = [(10 * u + i, f"2024-01-01 {h:02}:00:00", u, "view", f'{{"k": {stop}}}') for u, trip in enumerate(trips) for i, (stop, h) in enumerate(trip)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, props string")
    events.withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    found = {(r[0], tuple(map(int, filter(None, r[1].split(">")))), r[2]) for r in queries.QUERIES["transfer_patterns"](spark, str(tmp_path)).collect()}
    assert found == {(90, (), 50), (90, (), 5), (90, (5,), 99), (90, (5, 99), 50), (5, (), 99), (5, (99,), 50), (99, (), 50)}
    latest = {r["stop_id"]: r["tau"] // 3_600_000 for r in queries.QUERIES["latest_departure"](spark, str(tmp_path)).collect()}
    assert latest == {50: 20, 99: 13, 5: 11, 90: 9}


def test_all_stops_and_clusters(spark, tmp_path):
    """A hop by way of stop 54 (10 and 54 lie in other clusters than their neighbours, 60 in that of 54)."""
    rows = [(i, f"2024-01-01 {8 + i:02}:00:00", 1, "view", f'{{"k": {stop}}}') for i, stop in enumerate((10, 54, 60))]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, props string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    found = lambda name: sorted(r["stop_id"] for r in queries.QUERIES[name](spark, str(tmp_path)).collect())
    assert found("border_stations") == [10, 54]
    assert found("used_stops") == [10, 54, 60]


def test_gaussian_restarts(spark, monkeypatch):
    from pyspark.ml.clustering import GaussianMixture

    fits, fit = [], GaussianMixture.fit
    monkeypatch.setattr(GaussianMixture, "fit", lambda self, data: fits.append(1) or fit(self, data))
    assert queries.QUERIES["gaussian_clusters"](spark, SF).count() == 100 and len(fits) == 10


def test_range_from_all(spark, case4):
    together = raptor.range_from_all(*case4, case4[0].where("stop_id IN (0, 3)").select("stop_id").distinct(), 0, 1_000_000).collect()
    assert legs(together) == set().union(*[legs(raptor.range_query(*case4, s, 0, 1_000_000).collect()) for s in (0, 3)])


def test_functions(spark):
    one = spark.createDataFrame([("03:42:31", "25:42:00", "x", None)], "a string, b string, c string, d string")
    assert tuple(one.select(*[gtfs_time_ms(F.col(c)) for c in "abcd"]).first()) == (13_351_000, 92_520_000, None, None)
    assert tuple(spark.range(1).select(travel_ms(F.lit(100.0), 10), travel_ms(F.lit(1000.0), 200)).first()) == (36_000, 18_000)
    assert round(spark.range(1).select(haversine(F.lit(9.0), F.lit(48.0), F.lit(42.0), F.lit(10.0))).first()[0]) == 5_216_815


def test_feed(spark, tmp_path):
    files = {
        "calendar.txt": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nS,1,1,1,1,1,0,0,20240101,20241231\n",
        "stops.txt": "stop_id,stop_name,stop_lat,stop_lon\nA,a,48.0,9.0\nB,b,48.1,9.1\nunused,u,1,1\n",
        "trips.txt": "route_id,service_id,trip_id\nR,S,T\n",
        "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nT,08:00:00,08:00:00,A,1\nT,25:00:00,25:00:00,B,2\n",
    }
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    t = gtfs.preprocess(spark, {"x": str(tmp_path / "f.zip")})
    assert sorted(map(tuple, t.stop_times.collect())) == [(0, 0, 1, 28_800_000, 28_800_000), (0, 1, 2, 90_000_000, 90_000_000)]
    assert t.stops.count() == 2 and t.services.first()["monday"] is True
    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.writestr("stops.txt", files["stops.txt"])
    with pytest.raises(gtfs.MissingFile):
        gtfs.import_gtfs(spark, str(tmp_path / "g.zip"), "g")


@pytest.mark.parametrize("name", ["lines", "direct_lines", "stop_incidence", "walk_edges", "border_stations", "stop_adjacency_weighted", "earliest_arrival_k2", "latest_departure", "range_json", "merged_clusters", "line_ids", "line_visit_index"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    df = queries.QUERIES[name](spark, SF)
    r = con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(r.columns)
    order = [r.columns.index(c) for c in columns]
    assert sorted(str([x[c] for c in columns]) for x in df.collect()) == sorted(str([x[i] for i in order]) for x in r.fetchall())
