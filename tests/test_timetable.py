"""Feeds from a configuration, sinks, frames, clusters, and what journeys and pattern graphs must be."""

import http.server
import math
import random
import threading
import zipfile
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from perron import staging
from perron.functions import frames
from perron.functions.transit import parse_stop, stop_name
from perron.operators import clustering, network, raptor
from perron.operators.components import connected_components
from perron.sources import gtfs
from perron.sources.config import Config, Dataset
from perron.sources.events_timetable import Timetable

FILES = {
    "calendar.txt": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nS,1,1,1,1,1,0,0,20240101,20241231\n",
    "stops.txt": "stop_id,stop_name,stop_lat,stop_lon\nA,a,48.0,9.0\nB,b,48.1,9.1\nunused,u,1,1\n",
    "trips.txt": "route_id,service_id,trip_id\nR,S,T\n",
    "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nT,08:00:00,08:00:00,A,1\nT,25:00:00,25:00:00,B,2\n",
}


def feed(path, **changed) -> str:
    with zipfile.ZipFile(path, "w") as z:
        for k, v in {**FILES, **changed}.items():
            if v is not None:
                z.writestr(k, v)
    return str(path)


def test_invalid_feeds(spark, tmp_path):
    """Each broken rule is reported; broken datasets are skipped, unless validation is off."""
    bad = feed(tmp_path / "bad.zip", **{"stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nT,09:00:00,08:00:00,A,1\nX,x,10:00:00,B,1\nT,11:00:00,11:00:00,C,1\n", "stops.txt": "stop_id,stop_lat,stop_lon\nA,91,9\nB,48,9\n"})
    report = {r["rule"]: r["rows"] for r in gtfs.validation_report(gtfs.import_gtfs(spark, bad, "b")).collect()}
    assert {k for k, v in report.items() if v} == {"unreadable time", "departure before arrival", "unknown stop", "unknown trip", "bad coordinate", "repeated stop sequence"}
    good, partial = feed(tmp_path / "good.zip"), feed(tmp_path / "partial.zip", **{"trips.txt": None})
    both = Config((Dataset("b", bad), Dataset("p", partial), Dataset("g", good)), {})
    assert gtfs.preprocess_config(spark, both).stop_times.count() == 2
    assert gtfs.preprocess_config(spark, Config(both.datasets, {}, validate=False)).stop_times.count() == 3
    with pytest.raises(gtfs.InvalidFeed):
        gtfs.preprocess_config(spark, Config((Dataset("b", bad),), {}))
    with pytest.raises(gtfs.UnsupportedFormat):
        gtfs.preprocess_config(spark, Config((Dataset("r", good, "gtfs-rt"),), {}))


def test_fetch_and_intermediate_tables(spark, tmp_path):
    """A download with the dataset's headers; the four tables are written; nothing extracted is left."""
    data, seen = Path(feed(tmp_path / "f.zip")).read_bytes(), []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.headers["X-Key"])
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    config = Config((Dataset("x", f"http://127.0.0.1:{s.server_port}/f.zip", headers={"X-Key": "k"}),), {})
    folder = Path(staging.run_dir(spark).removeprefix("file://"))
    before = set(folder.glob("gtfs-*"))
    t = gtfs.preprocess_config(spark, config, str(tmp_path / "out"))
    s.shutdown()
    assert seen == ["k"] and sorted(map(tuple, t.stop_times.collect())) == [(0, 0, 1, 28_800_000, 28_800_000), (0, 1, 2, 90_000_000, 90_000_000)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["services.parquet", "stop_times.parquet", "stops.parquet", "trips.parquet"]
    assert set(folder.glob("gtfs-*")) == before


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1, 2]), (2, "b", None), (1, None, [])], "k int, s string, v array<int>")
    gtfs.write_table(df, str(tmp_path / "p"), partition_by=["k"])
    assert sorted(x.name for x in (tmp_path / "p").glob("k=*")) == ["k=1", "k=2"] and frames.same_rows(spark.read.parquet(str(tmp_path / "p")).select("k", "s", "v"), df)
    gtfs.write_table(df.drop("v"), str(tmp_path / "c"), "csv")
    assert [t for _, t in gtfs.read_inferred(spark, str(tmp_path / "c")).dtypes] == ["int", "string"]
    gtfs.write_table(df, str(tmp_path / "t.arrow"), "ipc")
    with pa.OSFile(str(tmp_path / "t.arrow")) as f:
        assert sorted(map(str, pa.ipc.open_file(f).read_all().to_pylist())) == sorted(str(r.asDict()) for r in df.collect())
    st = spark.createDataFrame([(1, 0, 0, 0, 0), (1, 1, 1, 9, 9)], "trip_id long, stop_id int, stop_sequence int, arrival_time long, departure_time long")
    stops = spark.createDataFrame([(0, 48.0, 9.0), (1, 48.5, 9.5)], "stop_id int, lat double, lon double")
    gtfs.write_lines(network.line_geometry(st, stops), str(tmp_path / "l.arrow"))
    with pa.OSFile(str(tmp_path / "l.arrow")) as f:
        table = pa.ipc.open_file(f).read_all()
    assert table.schema.field("geometry").metadata[b"ARROW:extension:name"] == b"geoarrow.linestring"
    assert table.column("geometry").to_pylist() == [[{"x": 9.0, "y": 48.0}, {"x": 9.5, "y": 48.5}]]


def test_frames(spark):
    a = spark.createDataFrame([(1, "x", [1]), (2, None, [2]), (2, None, [2])], "b int, a string, l array<int>")
    assert frames.same_rows(a, a.orderBy(F.desc("b")).select("l", "a", "b")) and frames.in_order(a).columns == ["a", "b", "l"]
    assert not frames.same_rows(a, a.distinct()) and not frames.same_rows(a, a.drop("l")) and frames.sortable_columns(a) == ["b", "a"]
    assert [(r["times_a"], r["times_b"]) for r in frames.difference(a, a.distinct()).collect()] == [(2, 1)]
    names = spark.createDataFrame([("s:7",), ("7",), ("x:7",), ("",), (None,)], "t string")
    assert [r[0] for r in names.select(parse_stop(F.col("t"))).collect()] == [7, 7, None, None, None] and spark.range(1).select(stop_name(F.lit(3))).first()[0] == "s:3"


def test_walks_everywhere(spark):
    """Against all pairs, at the equator, at the date line, and at a pole."""
    rng = random.Random(3)
    places = [(rng.uniform(-0.03, 0.03), rng.uniform(-0.03, 0.03)) for _ in range(40)]
    places += [(rng.uniform(60, 60.03), rng.choice((-1, 1)) * rng.uniform(179.95, 180)) for _ in range(40)]
    places += [(rng.uniform(89.97, 90), rng.uniform(-180, 180)) for _ in range(40)] + [(-90.0, 5.0), (-89.999, -170.0), (0.0, 180.0), (0.0, -180.0)]
    found = {(r[0], r[1]) for r in network.walk_edges(spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "stop_id int, lat double, lon double")).collect()}

    def metres(a, b):
        p, q = map(math.radians, a), list(map(math.radians, b))
        p = list(p)
        h = math.sin((q[0] - p[0]) / 2) ** 2 + math.cos(p[0]) * math.cos(q[0]) * math.sin((q[1] - p[1]) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(min(1, h)))

    want = {(i, j) for i, a in enumerate(places) for j, b in enumerate(places) if i != j and int(metres(a, b) / 7000 * 3600000) <= 900_000}
    assert found == want and len(want) > 500


def test_components(spark):
    """A chain, a star, a loop and a pair, against their smallest nodes."""
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(300, 301), (302, 301), (302, 300), (7, 7), (400, 400)]
    random.Random(1).shuffle(edges)
    found = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, **dict.fromkeys(range(200, 250), 100), 300: 300, 301: 300, 302: 300, 400: 400}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_dbscan(spark):
    """Against a plain reading, with a crowded cell, a thin chain, a border stop and noise."""
    rng = random.Random(5)
    pts = [(rng.gauss(0, 0.05), rng.gauss(0, 0.05)) for _ in range(60)] + [(0.25 + 0.2 * i, 1.0) for i in range(12)] + [(rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(40)] + [(0.25, 1.25)]
    eps, least = 0.3, 3
    near = {i: [j for j, q in enumerate(pts) if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= eps * eps] for i, p in enumerate(pts)}
    core = {i for i, n in near.items() if len(n) >= least}
    label = {i: i for i in core}
    changed = True
    while changed:
        changed = False
        for i in core:
            m = min(label[j] for j in near[i] if j in core)
            changed, label[i] = changed or m < label[i], min(label[i], m)
    want = {i: label[i] if i in core else min((label[j] for j in near[i] if j in core), default=-1) for i in near}
    found = clustering.dbscan(spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "stop_id int, lat double, lon double"), eps, least)
    assert {r[0]: r[1] for r in found.collect()} == want and -1 in want.values() and len(set(want.values())) > 3


@pytest.mark.parametrize("cluster", [lambda s: clustering.kmeans(s, 3), lambda s: clustering.gaussian_mixture(s, 3, 4)], ids=["kmeans", "gaussian"])
def test_separated_groups(spark, cluster):
    rng = random.Random(2)
    stops = [(10 * g + i, 20.0 * g + rng.gauss(0, 0.1), rng.gauss(0, 0.1)) for g in range(3) for i in range(10)]
    found = {r[0]: r[1] for r in cluster(spark.createDataFrame(stops, "stop_id int, lat double, lon double")).collect()}
    assert [len({found[10 * g + i] for i in range(10)}) for g in range(3)] == [1, 1, 1] and len(set(found.values())) == 3


def test_merging(spark):
    """Smallest score first, weights of merged clusters added up, until so many are left or no pair is."""
    adjacency = spark.createDataFrame([(0, 1, 5), (1, 2, 1), (2, 1, 1), (2, 3, 9), (5, 6, 2)], "stop_a int, stop_b int, weight long")
    label = lambda n: {r[0]: r[1] for r in clustering.merge_clusters(adjacency, n).collect()}
    assert label(6) == {i: i for i in (0, 1, 2, 3, 5, 6)} and label(5) == {0: 0, 1: 1, 2: 1, 3: 3, 5: 5, 6: 6}
    assert label(1) == {0: 0, 1: 0, 2: 0, 3: 0, 5: 5, 6: 5}


def test_process_clusters(spark, tmp_path):
    """A trip through two clusters is a trip in each; patterns keep to clusters; tables are partitioned."""
    st = spark.createDataFrame([(7, s, i, 1000 * i, 1000 * i) for i, s in enumerate((0, 1, 2, 3))] + [(8, 1, 0, 5000, 5000), (8, 0, 1, 6000, 6000)], "trip_id long, stop_id int, stop_sequence int, arrival_time long, departure_time long")
    stops = spark.createDataFrame([(i, 0.0, float(i)) for i in range(4)], "stop_id int, lat double, lon double")
    trips = spark.createDataFrame([(7, 3), (8, 4)], "trip_id long, service_id int")
    clusters = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "stop_id int, cluster_id int")
    out = clustering.process_clusters(Timetable(stops, trips, None, st), clusters, 0, 10_000_000, str(tmp_path / "x"))
    assert {(r["cluster_id"], r["start"], tuple(r["intermediates"]), r["target"]) for r in out["patterns"].collect()} == {(0, 0, (), 1), (0, 1, (), 0), (1, 2, (), 3)}
    assert {(r["cluster_id"], r["service_id"]) for r in out["services"].collect()} == {(0, 3), (0, 4), (1, 3)}
    assert out["lines"].count() == 3 and sorted(p.name for p in (tmp_path / "x/stop_times").glob("cluster*")) == ["cluster_id=0", "cluster_id=1"]


def test_overtaking_and_lost_times(spark):
    """Trips of a line of which one overtakes, or one doesn't stop for boarding, against all trips apart."""
    rng = random.Random(9)
    rows = []
    for trip in range(60):
        line, begin = trip % 4, rng.randint(0, 50)
        t = begin
        for i, stop in enumerate([(0, 1, 2, 3), (2, 1, 4), (3, 0, 5, 1), (4, 5)][line]):
            arrival, t = t, t + rng.randint(0, 2)
            rows.append((trip, stop, i, None if rng.random() < 0.05 else arrival * 1000, None if rng.random() < 0.05 else t * 1000))
            t += rng.randint(1, 30)
    st = spark.createDataFrame(rows, "trip_id long, stop_id int, stop_sequence int, arrival_time long, departure_time long")
    walks = spark.createDataFrame([(1, 3, 4000), (5, 2, 2000)], "from_stop int, to_stop int, duration_ms long")
    asked = [(q, s, t) for q, (s, t) in enumerate((s, t * 1000) for s in range(6) for t in (0, 10, 25))]
    found = raptor.labels(raptor.prepare(st, walks), spark.createDataFrame(asked, "query_id int, stop_id int, tau long"))
    assert raptor.broken_journeys(found.where("size(legs) > 0")).count() == 0
    by_trip = {}
    for trip, stop, i, a, d in rows:
        by_trip.setdefault(trip, []).append((stop, a, d))
    for q, s, t in asked:
        best, fresh = {s: t}, {s: t}
        while fresh:
            ride = {}
            for v in by_trip.values():
                for i, (x, _, d) in enumerate(v):
                    if x in fresh and d is not None and d >= fresh[x]:
                        for y, a, _ in v[i + 1 :]:
                            if a is not None and a < min(best.get(y, 1 << 60), ride.get(y, 1 << 60)):
                                ride[y] = a
            best.update(ride)
            walk = {}
            for x, y, ms in ((1, 3, 4000), (5, 2, 2000)):
                if x in ride and ride[x] + ms < min(best.get(y, 1 << 60), walk.get(y, 1 << 60)):
                    walk[y] = ride[x] + ms
            best.update(walk)
            fresh = {**ride, **walk}
        assert {r["stop_id"]: r["tau"] for r in found.where(F.col("query_id") == q).collect()} == best, q


def test_broken_journeys(spark):
    ride = lambda a, b, t, u: ("ride", 1, a, b, t, u, None)
    walk = lambda a, b, ms: ("walk", None, a, b, None, None, ms)
    good = [[ride(0, 1, 5, 9)], [ride(0, 1, 5, 9), walk(1, 2, 3), ride(2, 3, 12, 20)]]
    bad = [[], [ride(0, 1, 9, 5)], [ride(0, 1, 5, 9), ride(2, 3, 10, 12)], [ride(0, 1, 5, 9), ride(1, 2, 8, 12)], [ride(0, 1, 5, 9), walk(1, 2, 4), ride(2, 3, 12, 20)], [walk(0, 1, -1)]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(good + bad)], f"i int, legs array<{raptor.LEG}>")
    assert {r["i"] for r in raptor.broken_journeys(df).collect()} == set(range(2, 8))
    with pytest.raises(raptor.InvalidJourney):
        raptor.checked(df)


def test_graph_faults(spark):
    p = spark.createDataFrame([(0, [], 1), (0, [1], 2), (0, [1, 2], 3), (4, [], 0)], "start int, intermediates array<int>, target int")
    edges = raptor.pattern_edges(p)
    assert raptor.graph_faults(edges).count() == 0
    more = spark.createDataFrame([(0, "prefix:0>1", "prefix:0>1>2"), (0, "target:9", "prefix:0>8"), (0, "prefix:0>7", "root"), (4, "target:3", "target:0")], edges.schema)
    assert {(r["node"], r["fault"]) for r in raptor.graph_faults(edges.unionByName(more)).collect()} == {("prefix:0>1", "wrong way back"), ("prefix:0>1", "several ways back"), ("target:9", "unknown node"), ("prefix:0>7", "leads to no target"), ("target:3", "wrong way back")}


def test_staging(spark):
    df = staging.stage(spark.range(5), "x")
    path = Path(df._perron_path.removeprefix("file://"))
    assert path.parent.name == f"perron-{spark.sparkContext.applicationId}" and df.count() == 5
    staging.discard(df, spark.range(1))
    assert not path.exists()
