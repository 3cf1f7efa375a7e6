"""The transit queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perron.functions.transit import DAYS, gtfs_time_ms, parse_stop, stop_name, trips_per_year
from perron.operators import calendar, clustering, network, patterns, raptor
from perron.operators.components import connected_components
from perron.operators.prefix import prefix_sums
from perron.sources.events_timetable import EVENT_TYPES, Timetable, events_timetable

START, TARGET, AT = 3, 0, 8 * 3600 * 1000
ORIGINS = (0, 37, 73)
HOUR = 3600 * 1000
WEEK = 7 * 24 * HOUR
LATEST = 20 * HOUR
MERGES = 4
RANGE_FROM, TARGETS = 37, (5, 50, 95)

Query = Callable[[SparkSession, str], DataFrame]


def _clusters(stops: DataFrame) -> DataFrame:
    return stops.select("stop_id", F.floor(F.col("stop_id") / 25).cast("int").alias("cluster_id"))


def _origins(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(o, o, AT) for o in ORIGINS], "query_id int, stop_id int, tau long")


def _network(t: Timetable) -> raptor.Network:
    return raptor.prepare(t.stop_times, network.walk_edges(t.stops))


def timetable_stop_times(spark: SparkSession, d: str) -> DataFrame:
    return events_timetable(spark, d).stop_times


def line_ids(spark: SparkSession, d: str) -> DataFrame:
    return network.line_ids(events_timetable(spark, d, True).stop_times)


def line_visit_index(spark: SparkSession, d: str) -> DataFrame:
    return network.line_visit_index(events_timetable(spark, d, True).stop_times)


def line_progressions(spark: SparkSession, d: str) -> DataFrame:
    return network.line_progressions(events_timetable(spark, d, True).stop_times)


def lines(spark: SparkSession, d: str) -> DataFrame:
    found = network.lines(events_timetable(spark, d, True).stop_times)
    return found.select("line_key", F.array_join("stops", ",").alias("stops"), "trips")


def expanded_lines(spark: SparkSession, d: str) -> DataFrame:
    return network.expanded_lines(events_timetable(spark, d, True).stop_times)


def stop_incidence(spark: SparkSession, d: str) -> DataFrame:
    found = network.stop_incidence(events_timetable(spark, d, True).stop_times)
    return found.select("stop_id", F.expr("array_join(array_sort(transform(incidences, x -> concat(x.line_key, '/', x.stop_sequence))), ';')").alias("incidences"))


def direct_lines(spark: SparkSession, d: str) -> DataFrame:
    return network.direct_lines(events_timetable(spark, d, True).stop_times, START, TARGET)


def direct_earliest_after(spark: SparkSession, d: str) -> DataFrame:
    return network.direct_earliest_after(events_timetable(spark, d, True).stop_times, START, TARGET, AT)


def visit_index(spark: SparkSession, d: str) -> DataFrame:
    return network.visit_index(events_timetable(spark, d, True).stop_times).select("trip_id", "stop_id", "stop_sequence", "visit_idx")


def dense_trip_ids(spark: SparkSession, d: str) -> DataFrame:
    return prefix_sums(events_timetable(spark, d).trips, ["trip_id"], [], "dense_id").select("trip_id", "dense_id")


def gtfs_time_parse(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.concat_ws(":", (F.hour("ts") + 3).cast("string"), F.date_format("ts", "mm"), F.date_format("ts", "ss")).alias("t"))
    return t.select("event_id", gtfs_time_ms(F.col("t")).alias("ms"))


def walk_edges(spark: SparkSession, d: str) -> DataFrame:
    return network.walk_edges(events_timetable(spark, d).stops)


def used_stops(spark: SparkSession, d: str) -> DataFrame:
    t = events_timetable(spark, d)
    return t.stops.join(t.stop_times, "stop_id", "left_semi").select("stop_id")


def line_geometry(spark: SparkSession, d: str) -> DataFrame:
    t = events_timetable(spark, d, True)
    found = network.line_geometry(t.stop_times, t.stops)
    return found.select("line_key", F.expr("array_join(transform(points, p -> concat(cast(cast(round(p.lon * 100) as int) as string), ' ', cast(cast(round(p.lat * 100) as int) as string))), ',')").alias("points"))


def hops(spark: SparkSession, d: str) -> DataFrame:
    t = events_timetable(spark, d)
    return network.hops(t.stop_times, t.stops).select("line_key", "stop_id", "stop_sequence", F.round("distance", 3).alias("metres"))


def long_distance_stations(spark: SparkSession, d: str) -> DataFrame:
    t = events_timetable(spark, d)
    return network.long_distance_stations(t.stop_times, t.stops, 6_000.0)


def border_stations(spark: SparkSession, d: str) -> DataFrame:
    t = events_timetable(spark, d)
    return network.border_stations(t.stop_times, _clusters(t.stops))


def stop_adjacency_weighted(spark: SparkSession, d: str) -> DataFrame:
    t = events_timetable(spark, d)
    return network.stop_adjacency(t.stop_times, t.trips, t.services)


def service_trips_per_year(spark: SparkSession, d: str) -> DataFrame:
    return events_timetable(spark, d).services.select("service_id", trips_per_year().alias("per_year"))


def merge_score_top1(spark: SparkSession, d: str) -> DataFrame:
    t = events_timetable(spark, d)
    return clustering.best_merge(network.stop_adjacency(t.stop_times, t.trips, t.services)).select("stop_a", "stop_b", F.round("score", 6).alias("score"))


def cluster_sub_timetable(spark: SparkSession, d: str) -> DataFrame:
    t = events_timetable(spark, d)
    st, trips, services = network.sub_timetables(_clusters(t.stops), t.stop_times, t.trips)
    count = lambda df, c: df.groupBy("cluster_id").agg(F.count(F.lit(1)).alias(c))
    return count(st, "n_stop_times").join(count(trips, "n_trips"), "cluster_id").join(count(services, "n_services"), "cluster_id")


def merged_clusters(spark: SparkSession, d: str) -> DataFrame:
    t = events_timetable(spark, d)
    return clustering.merge_clusters(network.stop_adjacency(t.stop_times, t.trips, t.services), 100 - MERGES)


def cluster_patterns(spark: SparkSession, d: str) -> DataFrame:
    t = events_timetable(spark, d)
    found = clustering.process_clusters(t, _clusters(t.stops), 0, WEEK)["patterns"]
    return found.select("cluster_id", "start", F.array_join("intermediates", ">").alias("intermediates"), "target")


def stop_clusters_left(spark: SparkSession, d: str) -> DataFrame:
    """Every visit of a line with its stop's cluster, null where the stop has none."""
    t = events_timetable(spark, d)
    some = _clusters(t.stops).where("cluster_id < 3")
    return network.line_progressions(t.stop_times).join(some, "stop_id", "left")


def stop_names(spark: SparkSession, d: str) -> DataFrame:
    shown = events_timetable(spark, d).stops.select("stop_id", stop_name(F.col("stop_id")).alias("name"))
    return shown.withColumn("parsed", parse_stop(F.col("name")))


def dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    t = events_timetable(spark, d)
    c = _clusters(t.stops).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster_id").alias("m"))
    return c.select(F.lit("stops").alias("what"), F.col("n").alias("n")).unionByName(c.select(F.lit("clusters").alias("what"), F.col("m").alias("n"))).unionByName(t.trips.agg(F.count(F.lit(1)).alias("n")).select(F.lit("trips").alias("what"), "n"))


def earliest_arrival_k2(spark: SparkSession, d: str) -> DataFrame:
    t = events_timetable(spark, d)
    return raptor.arrivals(_network(t), _origins(spark), rounds=2).select("query_id", "stop_id", "tau")


def earliest_arrival_all(spark: SparkSession, d: str) -> DataFrame:
    return raptor.arrivals_at(_network(events_timetable(spark, d)), _origins(spark)).select("query_id", "stop_id", "tau", "departure", "arrival", F.size("legs").alias("n_legs"))


def earliest_arrival_to(spark: SparkSession, d: str) -> DataFrame:
    targets = spark.createDataFrame([(o, s) for o in ORIGINS for s in TARGETS], "query_id int, stop_id int")
    return raptor.arrivals_at(_network(events_timetable(spark, d)), _origins(spark), targets).select("query_id", "stop_id", "arrival")


def latest_departure(spark: SparkSession, d: str) -> DataFrame:
    t = events_timetable(spark, d)
    return raptor.latest_departures(t.stop_times, network.walk_edges(t.stops), spark.createDataFrame([(1, 50, LATEST)], "query_id int, stop_id int, tau long"))


def _from_one(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(RANGE_FROM,)], "stop_id int")


def range_all(spark: SparkSession, d: str) -> DataFrame:
    found = raptor.ranges(_network(events_timetable(spark, d)), _from_one(spark), AT, HOUR)
    return found.select("departure", "arrival", "departure_stop", "arrival_stop", F.size("legs").alias("n_legs"))


def range_departures(spark: SparkSession, d: str) -> DataFrame:
    t = events_timetable(spark, d)
    return t.stop_times.where((F.col("stop_id") == RANGE_FROM) & F.col("departure_time").between(AT, AT + HOUR)).select((F.col("departure_time") + 1000).alias("tau")).distinct()


def range_json(spark: SparkSession, d: str) -> DataFrame:
    return raptor.journeys_json(raptor.ranges(_network(events_timetable(spark, d)), _from_one(spark), AT, 12 * HOUR, list(TARGETS)))


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    t = events_timetable(spark, d)
    return raptor.transfer_patterns(raptor.ranges(_network(t), t.stops, 0, WEEK))


def transfer_patterns(spark: SparkSession, d: str) -> DataFrame:
    return _patterns(spark, d).select("start", F.array_join("intermediates", ">").alias("intermediates"), "target")


def transfer_pattern_graph(spark: SparkSession, d: str) -> DataFrame:
    return raptor.pattern_edges(_patterns(spark, d))


def long_walk_components(spark: SparkSession, d: str) -> DataFrame:
    edges = network.walk_edges(events_timetable(spark, d).stops).where("duration_ms <= 400000")
    return connected_components(edges.select(F.col("from_stop").alias("a"), F.col("to_stop").alias("b")))


def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clustering.kmeans(events_timetable(spark, d).stops)


def gaussian_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clustering.gaussian_mixture(events_timetable(spark, d).stops, 3)


def dbscan_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clustering.dbscan(events_timetable(spark, d).stops, 0.015, 4)


def optics_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clustering.optics(events_timetable(spark, d).stops, 1200.0, 5, 10)


def service_days(spark: SparkSession, d: str) -> DataFrame:
    return calendar.service_days(events_timetable(spark, d).services, "2023-12-28", "2024-01-10")


def dated_stop_times(spark: SparkSession, d: str) -> DataFrame:
    t = events_timetable(spark, d)
    return calendar.dated_stop_times(t.stop_times, t.trips, t.services, "2024-01-01", "2024-01-03")


def pattern_arrivals(spark: SparkSession, d: str) -> DataFrame:
    t = events_timetable(spark, d)
    prepared = _network(t)
    found = raptor.transfer_patterns(raptor.labels(prepared, _origins(spark)))
    return patterns.pattern_arrivals(found, t.stop_times, prepared.walks, _origins(spark).withColumnRenamed("stop_id", "start"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        timetable_stop_times, lines, line_progressions, expanded_lines, stop_incidence, direct_lines, direct_earliest_after, visit_index, dense_trip_ids, gtfs_time_parse,
        walk_edges, used_stops, line_geometry, hops, long_distance_stations, border_stations, stop_adjacency_weighted, service_trips_per_year, merge_score_top1,
        cluster_sub_timetable, dataset_stats, earliest_arrival_k2, earliest_arrival_all, earliest_arrival_to, latest_departure, range_all, range_departures, range_json,
        transfer_patterns, transfer_pattern_graph, long_walk_components, kmeans_clusters, gaussian_clusters, dbscan_clusters,
        optics_clusters, service_days, dated_stop_times, pattern_arrivals, line_ids, line_visit_index, merged_clusters, cluster_patterns, stop_clusters_left, stop_names,
    )
}

# --- the same in SQL -----------------------------------------------------------------------------

_TRIP = "CAST(user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT)"
_ORDER = f"row_number() OVER (PARTITION BY {_TRIP} ORDER BY ts, event_id) - 1"


def _base(few: bool) -> str:
    stop = "CASE event_type {} END".format(" ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(EVENT_TYPES))) if few else "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)"
    weekdays = ", ".join(f"service_id % {i + 2} = 0 AS {day}" for i, day in enumerate(DAYS))
    return f"""WITH RECURSIVE st AS (SELECT {_TRIP} AS trip_id, CAST({stop} AS INTEGER) AS stop_id, CAST({_ORDER} AS INTEGER) AS stop_sequence,
        CAST((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) * 1000 AS BIGINT) AS arrival_time, CAST((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) * 1000 AS BIGINT) AS departure_time FROM events),
    stops AS (SELECT DISTINCT stop_id, 48.0::DOUBLE + (stop_id // 10) * 0.01::DOUBLE AS lat, 9.0::DOUBLE + (stop_id % 10) * 0.01::DOUBLE AS lon FROM st),
    trips AS (SELECT DISTINCT {_TRIP} AS trip_id, CAST(user_id % 7 AS INTEGER) AS service_id FROM events),
    services AS (SELECT DISTINCT service_id, {weekdays} FROM trips),
    tl AS (SELECT trip_id, md5(string_agg(stop_id || '@' || stop_sequence, ',' ORDER BY stop_sequence)) AS line_key, string_agg(stop_id, ',' ORDER BY stop_sequence) AS stops FROM st GROUP BY trip_id),
    lp AS (SELECT DISTINCT line_key, stop_id, stop_sequence FROM tl JOIN st USING (trip_id))
    """


def _rounds(start: str, rounds: int, st: str = "st", walks: str = "walks") -> str:
    """CTEs that run so many rounds from the labels of ``start`` (query_id, stop_id, tau), by plain joins: a<k>
    has all labels after round k, with the journey's departure, its legs as JSON and the stops they start at."""
    none = "NULL::BIGINT AS departure, []::VARCHAR[] AS legs, []::INTEGER[] AS path"
    out = [f"f0 AS MATERIALIZED (SELECT query_id, stop_id, tau, {none} FROM ({start})), a0 AS MATERIALIZED (FROM f0)"]
    ride = """'{"ride":{"trip":' || x.t || ',"boarding_stop":' || x.b || ',"alight_stop":' || r.stop_id || ',"boarding_time":' || x.d // 1000 || ',"alight_time":' || x.a // 1000 || '}}'"""
    walk = """'{"transfer":{"start":' || x.via || ',"end":' || w.stop_id || ',"duration":' || x.ms // 1000 || '}}'"""
    for k in range(1, rounds + 1):
        f, a = f"f{k - 1}", f"a{k - 1}"
        out.append(f"""r{k} AS MATERIALIZED (SELECT r.query_id, r.stop_id, x.a AS tau, coalesce(l.departure, x.d) AS departure, list_append(l.legs, {ride}) AS legs, list_append(l.path, x.b) AS path FROM (
            SELECT query_id, stop_id, min({{'a': arrival_time, 't': trip_id, 'b': m.b, 'd': m.d}}) AS x FROM (
                SELECT query_id, b.trip_id, b.stop_sequence, any_value(b.stop_id) AS stop_id, any_value(b.arrival_time) AS arrival_time, max({{'p': c.stop_sequence, 'b': c.stop_id, 'd': c.departure_time}}) AS m
                FROM {f} l JOIN {st} c ON c.stop_id = l.stop_id AND c.departure_time >= l.tau JOIN {st} b ON b.trip_id = c.trip_id AND b.stop_sequence > c.stop_sequence GROUP BY 1, 2, 3)
            WHERE m.b <> stop_id GROUP BY 1, 2) r LEFT JOIN {a} o USING (query_id, stop_id) JOIN {f} l ON l.query_id = r.query_id AND l.stop_id = x.b WHERE o.tau IS NULL OR x.a < o.tau),
        w{k} AS MATERIALIZED (SELECT w.query_id, w.stop_id, x.tau, l.departure, list_append(l.legs, {walk}) AS legs, list_append(l.path, x.via) AS path FROM (
            SELECT query_id, to_stop AS stop_id, min({{'tau': tau + duration_ms, 'via': r.stop_id, 'ms': duration_ms}}) AS x FROM r{k} r JOIN {walks} ON from_stop = r.stop_id GROUP BY 1, 2) w
            JOIN r{k} l ON l.query_id = w.query_id AND l.stop_id = x.via LEFT JOIN {a} o ON o.query_id = w.query_id AND o.stop_id = w.stop_id LEFT JOIN r{k} n ON n.query_id = w.query_id AND n.stop_id = w.stop_id
            WHERE (o.tau IS NULL OR x.tau < o.tau) AND (n.tau IS NULL OR x.tau < n.tau)),
        f{k} AS MATERIALIZED (FROM w{k} UNION ALL FROM r{k} ANTI JOIN w{k} USING (query_id, stop_id)),
        a{k} AS MATERIALIZED (FROM f{k} UNION ALL FROM {a} ANTI JOIN f{k} USING (query_id, stop_id))""")
    return ", ".join(out)


#: Rounds in the SQL of queries that go on until nothing improves; further ones would change nothing.
ROUNDS = 8




def oracle_sql() -> dict[str, str]:
    few, many = _base(True), _base(False)
    hav = "asin(sqrt(least(1.0, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)))) * 12742017.6"
    walks = f"""walks AS (SELECT * FROM (SELECT a.stop_id AS from_stop, b.stop_id AS to_stop, CAST(trunc({hav.format(a='a.', b='b.')} / 1000 / 7 * 3600000) AS BIGINT) AS duration_ms
        FROM stops a JOIN stops b ON a.stop_id <> b.stop_id) WHERE duration_ms <= 900000)"""
    hop = f"""hop AS (SELECT line_key, stop_id, stop_sequence, {hav.format(a='p', b='')} AS distance FROM (
        SELECT lp.*, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM lp JOIN stops USING (stop_id) WINDOW w AS (PARTITION BY line_key ORDER BY stop_sequence)))"""
    adj = f"""adj AS (SELECT stop_id AS stop_a, stop_b, CAST(sum(per_year) AS BIGINT) AS weight FROM (
        SELECT trip_id, stop_id, lead(stop_id) OVER w AS stop_b, lead(stop_sequence) OVER w AS n, stop_sequence FROM st WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence))
        JOIN trips USING (trip_id) JOIN (SELECT service_id, 52 * ({" + ".join(f"CAST({x} AS INTEGER)" for x in DAYS)}) AS per_year FROM services) USING (service_id)
        WHERE n = stop_sequence + 1 GROUP BY 1, 2)"""
    origins = "FROM (VALUES {}) t(query_id, stop_id, tau)".format(", ".join(f"({o}, {o}, {AT}::BIGINT)" for o in ORIGINS))
    onward = "SELECT stop_id, departure_time FROM st s WHERE stop_sequence < (SELECT max(stop_sequence) FROM st e WHERE e.trip_id = s.trip_id)"
    probes = "SELECT {{'stop': stop_id, 'tau': tau}} AS query_id, stop_id, tau FROM (SELECT stop_id, {at}::BIGINT AS tau FROM stops UNION SELECT stop_id, departure_time + 1000 FROM ({onward}) WHERE departure_time BETWEEN {at} AND {to} - 1000) WHERE {which}"
    ranges = lambda at, span, which, rounds: f"{many}, {walks}, {_rounds(probes.format(at=at, to=at + span, onward=onward, which=which), rounds)}, j AS (SELECT DISTINCT departure, tau AS arrival, query_id.stop AS departure_stop, stop_id AS arrival_stop, legs, path FROM a{rounds} WHERE len(legs) > 0 AND departure <= {at + span})"
    one = f"stop_id = {RANGE_FROM}"
    every = f"{ranges(0, WEEK, 'true', ROUNDS)}, p AS (SELECT DISTINCT departure_stop AS start, path[2:] AS mid, arrival_stop AS target FROM j)"
    ea = f"{many}, {walks}, {_rounds(origins, ROUNDS)}"
    turned = f"""{many}, {walks}, tst AS (SELECT trip_id, stop_id, -stop_sequence AS stop_sequence, -departure_time AS arrival_time, -arrival_time AS departure_time FROM st),
        twalks AS (SELECT to_stop AS from_stop, from_stop AS to_stop, duration_ms FROM walks), {_rounds(f"SELECT 1 AS query_id, 50 AS stop_id, -{LATEST}::BIGINT AS tau", ROUNDS, "tst", "twalks")}"""
    crowd = """near AS (SELECT a.stop_id AS a, b.stop_id AS b FROM stops a JOIN stops b ON pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2) <= 0.015::DOUBLE * 0.015::DOUBLE),
        core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= 4), link AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
        r AS (SELECT a AS node, a AS reach FROM core UNION SELECT r.node, link.b FROM r JOIN link ON link.a = r.reach), comp AS (SELECT node, min(reach) AS c FROM r GROUP BY 1),
        edge AS (SELECT b AS stop_id, min(c) AS c FROM near JOIN comp ON node = a GROUP BY 1)"""
    # Each step relabels the better-scored pair of neighbouring clusters by the smaller of the two names.
    merges = ["m0 AS (SELECT DISTINCT s AS stop_id, s AS c FROM (SELECT stop_a AS s FROM adj UNION SELECT stop_b FROM adj))"]
    for k in range(MERGES):
        merges.append(f"""z{k} AS (SELECT c, count(*)::DOUBLE AS n FROM m{k} GROUP BY c), g{k} AS (SELECT a.c AS a, b.c AS b, sum(weight) AS w FROM adj JOIN m{k} a ON a.stop_id = stop_a JOIN m{k} b ON b.stop_id = stop_b WHERE a.c <> b.c GROUP BY 1, 2 HAVING sum(weight) > 0),
        b{k} AS (SELECT a, b FROM g{k} JOIN z{k} x ON x.c = a JOIN z{k} y ON y.c = b ORDER BY (1 / x.n) * (1 / y.n) * (w / sqrt(x.n) + w / sqrt(y.n)), a, b LIMIT 1),
        m{k + 1} AS MATERIALIZED (SELECT stop_id, CAST(coalesce((SELECT least(a, b) FROM b{k} WHERE greatest(a, b) = c), c) AS INTEGER) AS c FROM m{k})""")
    merges = ", ".join(merges)
    running = f"""sd AS (SELECT service_id, CAST(day AS DATE) AS date FROM services, generate_series(DATE '{{}}', DATE '{{}}', INTERVAL 1 DAY) g(day)
        WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-12-31' AND [{", ".join(DAYS)}][isodow(day)])"""
    dense = f"""near AS (SELECT * FROM (SELECT a.stop_id AS a, b.stop_id AS b, {hav.format(a='a.', b='b.')} AS m FROM stops a JOIN stops b ON a.stop_id <> b.stop_id) WHERE m <= 1200),
        core AS (SELECT a FROM near GROUP BY a HAVING count(*) + 1 >= 5), link AS (SELECT a, b FROM near SEMI JOIN core USING (a) WHERE b IN (SELECT a FROM core)),
        r AS (SELECT a AS node, a AS reach FROM core UNION SELECT r.node, link.b FROM r JOIN link ON link.a = r.reach), comp AS (SELECT node, min(reach) AS c FROM r GROUP BY 1),
        mem AS (SELECT node AS stop_id, c FROM comp UNION ALL SELECT b, c FROM (SELECT b, arg_min(a, trunc(m * 1000) * 1000 + a) AS node FROM near WHERE a IN (FROM core) AND b NOT IN (FROM core) GROUP BY b) JOIN comp USING (node))"""
    cl = "cl AS (SELECT stop_id, CAST(stop_id // 25 AS INTEGER) AS cluster_id FROM stops)"
    return {
        "timetable_stop_times": f"{many} SELECT * FROM st",
        "lines": f"{few} SELECT line_key, stops, count(*) AS trips FROM tl GROUP BY 1, 2",
        "line_ids": f"{few} SELECT line_key, CAST(row_number() OVER (ORDER BY line_key) - 1 AS INTEGER) AS line_id FROM (SELECT DISTINCT line_key FROM tl)",
        "line_visit_index": f"{few} SELECT line_key, stop_id, stop_sequence, CAST(row_number() OVER (PARTITION BY line_key, stop_id ORDER BY stop_sequence) - 1 AS INTEGER) AS visit_idx FROM lp",
        "merged_clusters": f"{many}, {adj}, {merges} SELECT stop_id, c AS cluster_id FROM m{MERGES}",
        "cluster_patterns": f"""{many}, {walks}, {cl}, cst AS (SELECT trip_id * 1000 + cluster_id AS trip_id, stop_id, stop_sequence, arrival_time, departure_time FROM st JOIN cl USING (stop_id)),
            cwalks AS (SELECT walks.* FROM walks JOIN cl a ON a.stop_id = from_stop JOIN cl b ON b.stop_id = to_stop WHERE a.cluster_id = b.cluster_id), {_rounds(probes.format(at=0, to=WEEK, onward=onward.replace(" st ", " cst "), which="true"), ROUNDS, "cst", "cwalks")}
            SELECT DISTINCT cluster_id, query_id.stop AS start, array_to_string(path[2:], '>') AS intermediates, a.stop_id AS target FROM a{ROUNDS} a JOIN cl ON cl.stop_id = query_id.stop WHERE len(legs) > 0 AND departure <= {WEEK}""",
        "stop_clusters_left": f"{many}, {cl} SELECT line_key, stop_id, stop_sequence, cluster_id FROM lp LEFT JOIN (FROM cl WHERE cluster_id < 3) USING (stop_id)",
        "stop_names": f"{many} SELECT stop_id, 's:' || stop_id AS name, stop_id AS parsed FROM stops",
        "line_progressions": f"{few} SELECT * FROM lp",
        "expanded_lines": f"{few} SELECT line_key, trip_id, stop_id, arrival_time, departure_time, stop_sequence FROM tl JOIN st USING (trip_id)",
        "stop_incidence": f"{few} SELECT stop_id, string_agg(line_key || '/' || stop_sequence, ';' ORDER BY line_key || '/' || stop_sequence) AS incidences FROM lp GROUP BY 1",
        "direct_lines": f"{few} SELECT a.line_key, a.stop_sequence AS from_sequence_num, b.stop_sequence AS to_sequence_num FROM lp a JOIN lp b USING (line_key) WHERE a.stop_id = {START} AND b.stop_id = {TARGET} AND a.stop_sequence < b.stop_sequence",
        "direct_earliest_after": f"{few} SELECT e.departure_time, e.trip_id, a.stop_sequence AS from_sequence_num, b.stop_sequence AS to_sequence_num FROM lp a JOIN lp b USING (line_key) JOIN (SELECT * FROM tl JOIN st USING (trip_id)) e ON e.line_key = a.line_key AND e.stop_sequence = a.stop_sequence WHERE a.stop_id = {START} AND b.stop_id = {TARGET} AND a.stop_sequence < b.stop_sequence AND e.stop_id = {START} AND e.departure_time >= {AT} ORDER BY 1, 2, 3, 4 LIMIT 1",
        "visit_index": f"{few} SELECT trip_id, stop_id, stop_sequence, CAST(row_number() OVER (PARTITION BY trip_id, stop_id ORDER BY stop_sequence) - 1 AS INTEGER) AS visit_idx FROM st",
        "dense_trip_ids": f"{many} SELECT trip_id, CAST(row_number() OVER (ORDER BY trip_id) - 1 AS BIGINT) AS dense_id FROM trips",
        "gtfs_time_parse": "SELECT event_id, CAST(((hour(ts) + 3) * 3600 + minute(ts) * 60 + second(ts)) * 1000 AS BIGINT) AS ms FROM events",
        "walk_edges": f"{many}, {walks} SELECT * FROM walks",
        "used_stops": f"{many} SELECT stop_id FROM stops WHERE stop_id IN (SELECT stop_id FROM st)",
        "line_geometry": f"{few} SELECT line_key, string_agg(CAST(round(lon * 100) AS INTEGER) || ' ' || CAST(round(lat * 100) AS INTEGER), ',' ORDER BY stop_sequence) AS points FROM lp JOIN stops USING (stop_id) GROUP BY 1",
        "hops": f"{many}, {hop} SELECT line_key, stop_id, stop_sequence, round(distance, 3) AS metres FROM hop",
        "long_distance_stations": f"{many}, {hop} SELECT DISTINCT stop_id FROM hop JOIN (SELECT line_key FROM hop GROUP BY 1 HAVING avg(distance) >= 6000) USING (line_key)",
        "border_stations": f"{many}, {cl}, b AS (SELECT stop_id, cluster_id, lag(stop_id) OVER w AS s, lag(cluster_id) OVER w AS c FROM lp JOIN cl USING (stop_id) WINDOW w AS (PARTITION BY line_key ORDER BY stop_sequence)) SELECT stop_id FROM b WHERE c <> cluster_id UNION SELECT s FROM b WHERE c <> cluster_id",
        "stop_adjacency_weighted": f"{many}, {adj} SELECT * FROM adj",
        "service_trips_per_year": f"{many} SELECT service_id, CAST(52 * ({' + '.join(f'CAST({x} AS INTEGER)' for x in DAYS)}) AS BIGINT) AS per_year FROM services",
        "merge_score_top1": f"{many}, {adj} SELECT stop_a, stop_b, round(2.0 * weight, 6) AS score FROM adj WHERE stop_a <> stop_b AND weight > 0 ORDER BY weight, stop_a, stop_b LIMIT 1",
        "cluster_sub_timetable": f"{many}, {cl}, s AS (SELECT * FROM st JOIN cl USING (stop_id)), t AS (SELECT DISTINCT cluster_id, trip_id FROM s), v AS (SELECT cluster_id, service_id FROM t JOIN trips USING (trip_id)) SELECT * FROM (SELECT cluster_id, count(*) AS n_stop_times FROM s GROUP BY 1) JOIN (SELECT cluster_id, count(*) AS n_trips, count(DISTINCT service_id) AS n_services FROM v GROUP BY 1) USING (cluster_id)",
        "dataset_stats": f"{many}, {cl} SELECT 'stops' AS what, count(*) AS n FROM cl UNION ALL SELECT 'clusters', count(DISTINCT cluster_id) FROM cl UNION ALL SELECT 'trips', count(*) FROM trips",
        "earliest_arrival_k2": f"{many}, {walks}, {_rounds(origins, 2)} SELECT query_id, stop_id, tau FROM a2",
        "earliest_arrival_all": f"{ea} SELECT query_id, stop_id, tau, departure, tau AS arrival, CAST(len(legs) AS INTEGER) AS n_legs FROM a{ROUNDS} WHERE len(legs) > 0",
        "earliest_arrival_to": f"{ea} SELECT query_id, stop_id, tau AS arrival FROM a{ROUNDS} WHERE len(legs) > 0 AND stop_id IN {TARGETS}",
        "latest_departure": f"{turned} SELECT query_id, stop_id, -tau AS tau FROM a{ROUNDS}",
        "range_all": f"{ranges(AT, HOUR, one, ROUNDS)} SELECT departure, arrival, departure_stop, arrival_stop, CAST(len(legs) AS INTEGER) AS n_legs FROM j",
        "range_json": f"""{ranges(AT, 12 * HOUR, one, ROUNDS)} SELECT '{{"legs":[' || array_to_string(legs, ',') || ']}}' AS json FROM j WHERE arrival_stop IN {TARGETS}""",
        "transfer_patterns": f"{every} SELECT start, array_to_string(mid, '>') AS intermediates, target FROM p",
        "transfer_pattern_graph": f"""{every}, c AS (SELECT DISTINCT start, target, list_prepend(start, mid) AS chain FROM p), n AS (SELECT start, chain[:i] AS path FROM c, range(2, len(chain) + 1) t(i))
            SELECT start, 'prefix:' || array_to_string(path, '>') AS node, CASE WHEN len(path) = 2 THEN 'root' ELSE 'prefix:' || array_to_string(path[:-2], '>') END AS before FROM n
            UNION SELECT start, 'target:' || target, CASE WHEN len(chain) = 1 THEN 'root' ELSE 'prefix:' || array_to_string(chain, '>') END FROM c""",
        "pattern_arrivals": f"{ea} SELECT query_id, query_id AS start, stop_id AS target, tau AS arrival FROM a{ROUNDS} WHERE len(legs) > 0",
        "dbscan_clusters": f"{many}, {crowd} SELECT stop_id, CAST(coalesce(comp.c, edge.c, -1) AS INTEGER) AS cluster_id FROM stops LEFT JOIN comp ON node = stop_id LEFT JOIN edge USING (stop_id)",
        "service_days": f"{many}, {running.format('2023-12-28', '2024-01-10')} SELECT * FROM sd",
        "dated_stop_times": f"{many}, {running.format('2024-01-01', '2024-01-03')} SELECT trip_id * 100000 + date_diff('day', DATE '1970-01-01', date) AS trip_id, stop_id, stop_sequence, arrival_time + epoch_ms(date::TIMESTAMP) AS arrival_time, departure_time + epoch_ms(date::TIMESTAMP) AS departure_time FROM st JOIN trips USING (trip_id) JOIN sd USING (service_id)",
        "optics_clusters": f"{many}, {dense} SELECT stop_id, CAST(coalesce(c, -1) AS INTEGER) AS cluster_id FROM stops LEFT JOIN (SELECT * FROM mem WHERE c IN (SELECT c FROM mem GROUP BY 1 HAVING count(*) >= 10)) USING (stop_id)",
        "range_departures": f"{many} SELECT DISTINCT departure_time + 1000 AS tau FROM st WHERE stop_id = 37 AND departure_time BETWEEN {AT} AND {AT} + 3600000",
        "long_walk_components": f"{many}, {walks}, w AS (SELECT from_stop AS a, to_stop AS b FROM walks WHERE duration_ms <= 400000), c AS (SELECT a AS node, a AS reach FROM w UNION SELECT c.node, w.b FROM c JOIN w ON w.a = c.reach) SELECT node, min(reach) AS component FROM c GROUP BY 1",
    }
