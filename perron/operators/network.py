"""Lines, incidence, direct connections, walking edges, geometry and station analytics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perron.functions.transit import EARTH_RADIUS_M, MAX_WALK_MS, WALKING_KMH, haversine, travel_ms, trips_per_year
from perron.operators.prefix import prefix_sums


def trip_lines(stop_times: DataFrame) -> DataFrame:
    """(trip_id, line_key, chain): trips with equal stops and equal sequence numbers share a line. The
    key is a 128-bit hash of the chain of stops, so it needs no global numbering, is the same on every
    run, and is all that other tables carry of the chain."""
    chain = F.array_sort(F.collect_list(F.struct("stop_sequence", "stop_id")))
    text = F.array_join(F.transform("c", lambda x: F.concat(x["stop_id"].cast("string"), F.lit("@"), x["stop_sequence"].cast("string"))), ",")
    return stop_times.groupBy("trip_id").agg(chain.alias("c")).select("trip_id", F.md5(text.cast("binary")).alias("line_key"), F.col("c").alias("chain"))


def lines(stop_times: DataFrame) -> DataFrame:
    """(line_key, stops, trips): the lines, their stops in sequence and their number of trips."""
    found = trip_lines(stop_times).groupBy("line_key").agg(F.first("chain").alias("chain"), F.count(F.lit(1)).alias("trips"))
    return found.select("line_key", F.transform("chain", lambda x: x["stop_id"]).alias("stops"), "trips")


def line_ids(stop_times: DataFrame) -> DataFrame:
    """(line_key, line_id): dense numbers from 0 in the order of the keys."""
    return prefix_sums(trip_lines(stop_times).select("line_key").distinct(), ["line_key"], [], "line_id").withColumn("line_id", F.col("line_id").cast("int"))


def line_progressions(stop_times: DataFrame) -> DataFrame:
    """(line_key, stop_id, stop_sequence): one row per stop of a line."""
    each = trip_lines(stop_times).groupBy("line_key").agg(F.first("chain").alias("chain")).select("line_key", F.explode("chain").alias("e"))
    return each.select("line_key", "e.stop_id", "e.stop_sequence")


def line_visit_index(stop_times: DataFrame) -> DataFrame:
    """(line_key, stop_id, stop_sequence, visit_idx): progressions with the number of the line's earlier visits of the stop."""
    order = Window.partitionBy("line_key", "stop_id").orderBy("stop_sequence")
    return line_progressions(stop_times).withColumn("visit_idx", (F.row_number().over(order) - 1).cast("int"))


def expanded_lines(stop_times: DataFrame) -> DataFrame:
    """Every trip of every line, stop by stop, with its times."""
    return trip_lines(stop_times).select("trip_id", "line_key").join(stop_times, "trip_id").select("line_key", "trip_id", "stop_id", "arrival_time", "departure_time", "stop_sequence")


def stop_incidence(stop_times: DataFrame) -> DataFrame:
    """(stop_id, incidences): the distinct lines and places at a stop."""
    return line_progressions(stop_times).groupBy("stop_id").agg(F.array_sort(F.collect_set(F.struct("line_key", "stop_sequence"))).alias("incidences"))


def direct_lines(stop_times: DataFrame, start: int, target: int) -> DataFrame:
    """Lines that visit ``start`` before ``target``, a row for each pair of visits."""
    p = line_progressions(stop_times)
    a = p.where(F.col("stop_id") == start).select("line_key", F.col("stop_sequence").alias("from_sequence_num"))
    b = p.where(F.col("stop_id") == target).select("line_key", F.col("stop_sequence").alias("to_sequence_num"))
    return a.join(b, "line_key").where("from_sequence_num < to_sequence_num")


def direct_earliest_after(stop_times: DataFrame, start: int, target: int, at: int) -> DataFrame:
    """The earliest departure at ``start`` of a trip that goes on to ``target``: one row or none."""
    d = direct_lines(stop_times, start, target)
    e = expanded_lines(stop_times).where((F.col("stop_id") == start) & (F.col("departure_time") >= at))
    found = d.join(e, (d["line_key"] == e["line_key"]) & (d["from_sequence_num"] == e["stop_sequence"])).select("departure_time", "trip_id", "from_sequence_num", "to_sequence_num")
    return found.orderBy("departure_time", "trip_id", "from_sequence_num", "to_sequence_num").limit(1)


def visit_index(stop_times: DataFrame) -> DataFrame:
    """``stop_times`` with the number of the trip's earlier visits of the same stop."""
    return stop_times.withColumn("visit_idx", (F.row_number().over(Window.partitionBy("trip_id", "stop_id").orderBy("stop_sequence")) - 1).cast("int"))


def walk_edges(stops: DataFrame, kmh: float = WALKING_KMH, most_ms: int = MAX_WALK_MS) -> DataFrame:
    """(from_stop, to_stop, duration_ms) of all pairs within walking reach.

    An equi-join on grid cells: bands of latitude as wide as the reach, and in every band cells of
    longitude as wide as the reach is there at most; a stop asks the cells it can reach in its own
    and the neighbouring bands. Longitudes go round, so stops on both sides of the date line are
    neighbours, and a band at a pole is one cell.
    """
    angle = most_ms / 3600000 * kmh * 1000 / EARTH_RADIUS_M
    degrees = math.degrees(angle) * 1.0001
    # The farthest longitude within reach of a latitude; all of them where the pole is.
    narrow = lambda band: F.cos(F.radians(F.greatest(F.abs(band * degrees), F.abs((band + 1) * degrees))))
    width = lambda band: F.when(narrow(band) > math.sin(angle) * 1.0001, F.degrees(F.asin(math.sin(angle) / F.greatest(narrow(band), F.lit(1e-9)))) * 1.0001).otherwise(360.0)
    round_ = F.pmod(F.col("lon") + 180, F.lit(360.0))
    band = F.floor(F.col("lat") / degrees)
    home = stops.withColumn("band", band).withColumn("cell", F.floor(round_ / width(F.col("band"))))
    ask = stops.withColumn("band", F.explode(F.sequence(band - 1, band + 1))).withColumn("_w", width(F.col("band")))
    at = lambda x: F.floor(F.pmod(x, F.lit(360.0)) / F.col("_w"))
    # The last cell of a band may be narrow: where the date line is in reach, both cells beside it are asked.
    beside = F.when((round_ - F.col("_w") < 0) | (round_ + F.col("_w") >= 360), F.array(F.lit(0).cast("long"), F.floor(F.lit(359.9999999) / F.col("_w"))))
    cells = F.concat(F.array(at(round_ - F.col("_w")), at(round_), at(round_ + F.col("_w"))), F.coalesce(beside, F.array().cast("array<bigint>")))
    near = ask.withColumn("cell", F.explode(F.array_distinct(cells))).alias("a").join(home.alias("b"), ["band", "cell"]).where("a.stop_id <> b.stop_id")
    metres = haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return near.select(F.col("a.stop_id").alias("from_stop"), F.col("b.stop_id").alias("to_stop"), travel_ms(metres, kmh).alias("duration_ms")).where(F.col("duration_ms") <= most_ms)


def line_geometry(stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """(line_key, points): a line's stops as a line string (lon, lat)."""
    p = line_progressions(stop_times).join(stops, "stop_id")
    return p.groupBy("line_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("stop_sequence", "lon", "lat"))), lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("points"))


def hops(stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """Line progressions with the distance in metres from the line's previous stop (null at its start)."""
    w = Window.partitionBy("line_key").orderBy("stop_sequence")
    p = line_progressions(stop_times).join(stops, "stop_id")
    return p.withColumn("distance", haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")))


def long_distance_stations(stop_times: DataFrame, stops: DataFrame, least_m: float = 10_000.0) -> DataFrame:
    """Stops on lines whose mean hop is at least ``least_m``."""
    mean = F.avg("distance").over(Window.partitionBy("line_key"))
    return hops(stop_times, stops).withColumn("mean", mean).where(F.col("mean") >= least_m).select("stop_id").distinct()


def border_stations(stop_times: DataFrame, clusters: DataFrame) -> DataFrame:
    """Both ends of every hop between clusters."""
    w = Window.partitionBy("line_key").orderBy("stop_sequence")
    p = line_progressions(stop_times).join(clusters, "stop_id")
    p = p.withColumns({"_s": F.lag("stop_id").over(w), "_c": F.lag("cluster_id").over(w)}).where("_c <> cluster_id")
    return p.select(F.explode(F.array("stop_id", "_s")).alias("stop_id")).distinct()


def stop_adjacency(stop_times: DataFrame, trips: DataFrame, services: DataFrame) -> DataFrame:
    """(stop_a, stop_b, weight): runs per year between consecutive stops (a gap in the sequence is no edge)."""
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    nexts = stop_times.withColumns({"stop_b": F.lead("stop_id").over(w), "_n": F.lead("stop_sequence").over(w)}).where("_n = stop_sequence + 1")
    yearly = services.select("service_id", trips_per_year().alias("per_year"))
    return nexts.join(trips.select("trip_id", "service_id"), "trip_id").join(yearly, "service_id").groupBy(F.col("stop_id").alias("stop_a"), "stop_b").agg(F.sum("per_year").alias("weight"))


def sub_timetables(clusters: DataFrame, stop_times: DataFrame, trips: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stop times, trips, services) of all clusters at once, with cluster_id as a key."""
    st = stop_times.join(clusters, "stop_id")
    own = trips.join(st.select("cluster_id", "trip_id").distinct(), "trip_id")
    return st, own, own.select("cluster_id", "service_id").distinct()
