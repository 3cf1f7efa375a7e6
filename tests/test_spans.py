"""The routing index: one span for each label and further stop, and which of equal rides counts."""

import random

import duckdb
from pyspark.sql import functions as F

from perron import queries
from perron.operators import clustering, raptor
from perron.sources.events_timetable import Timetable

STOP_TIMES = "trip_id long, stop_id int, stop_sequence int, arrival_time long, departure_time long"


def test_one_span_for_a_label(spark):
    """300 trips that nearly all differ: a label meets one row for each further stop, with the least arrival."""
    rng = random.Random(4)
    rows, by_trip = [], {}
    for trip in range(300):
        t = rng.randint(0, 20_000)
        for i in range(rng.randint(1, 6)):
            rows.append((trip, rng.randrange(6), i, t, t + rng.randint(0, 50)))
            by_trip.setdefault(trip, []).append(rows[-1])
            t = rows[-1][4] + rng.choice((0, rng.randint(1, 3000)))
    net = raptor.prepare(spark.createDataFrame(rows, STOP_TIMES), spark.createDataFrame([], "from_stop int, to_stop int, duration_ms long"))
    want = {}
    asked = [(stop, tau) for stop in range(6) for tau in (-5, 0, 7000, 12_345, 19_999, 40_000)]
    for stop, tau in asked:
        for v in by_trip.values():
            for i, b in enumerate(v):
                for e in v[i + 1 :]:
                    if b[1] == stop != e[1] and b[4] >= tau:
                        want[stop, tau, e[1]] = min(e[3], want.get((stop, tau, e[1]), 1 << 60))
    at = spark.createDataFrame(asked, "stop_id int, tau long").withColumn("slice", F.greatest(F.floor(F.col("tau") / net.width), F.lit(net.first)))
    met = at.join(net.spans, ["stop_id", "slice"])
    found = met.where("tau <= dep AND (after IS NULL OR tau > after)").select("stop_id", "tau", "to_stop", "arr").collect()
    assert len(found) == len(want) and {tuple(r)[:3]: r["arr"] for r in found} == want
    assert net.spans.count() <= 3 * net.spans.select("stop_id", "to_stop", "dep").distinct().count() and met.count() < 5 * len(asked) * 5


def test_patterns_of_copies(spark):
    """Trips repeated under other ids add no ride and change no pattern."""
    rng = random.Random(8)
    once = []
    for trip in range(40):
        at = sorted(rng.sample(range(30_000), 3))
        once += [(trip, stop, i, t, t) for i, (stop, t) in enumerate(zip(rng.sample(range(5), 3), at, strict=True))]
    stops = spark.createDataFrame([(i, 48.0 + i, 9.0) for i in range(5)], "stop_id int, lat double, lon double")
    clusters = stops.select("stop_id", F.lit(0).alias("cluster_id"))
    found = []
    for times in (1, 4):
        st = spark.createDataFrame([(r[0] + 1000 * k, *r[1:]) for k in range(times) for r in once], STOP_TIMES)
        trips = st.select("trip_id", F.lit(1).alias("service_id")).distinct()
        out = clustering.process_clusters(Timetable(stops, trips, None, st), clusters, 0, 100_000)["patterns"]
        found.append((sorted(map(str, out.collect())), raptor.prepare(st, spark.createDataFrame([], "from_stop int, to_stop int, duration_ms long")).rides.count()))
    assert found[0] == found[1] and len(found[0][0]) > 20


def test_a_trip_that_stands_still(spark, tmp_path):
    """A trip that calls twice at the target in one second, for riders of two stops: the smaller boarding stop counts, as in SQL."""
    trips = [[(37, "09:00:00.0"), (61, "09:20:00.0"), (99, "09:40:00.0")], [(61, "10:00:00.0"), (5, "11:00:00.1"), (99, "11:00:00.2"), (5, "11:00:00.3")]]
    rows = [(10 * u + i, f"2024-01-01 {at}", u, "view", f'{{"k": {stop}}}') for u, trip in enumerate(trips) for i, (stop, at) in enumerate(trip)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, props string")
    events.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM '{tmp_path}/events.parquet/*.parquet'")
    con.sql("SET TimeZone = 'UTC'")
    want = sorted(r[0] for r in con.sql(queries.oracle_sql()["range_json"]).fetchall())
    assert sorted(r["json"] for r in queries.QUERIES["range_json"](spark, str(tmp_path)).collect()) == want and '"boarding_stop":61,"alight_stop":5' in want[0]
