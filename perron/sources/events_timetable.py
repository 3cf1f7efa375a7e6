"""A deterministic timetable over the ``events`` table: a user's day is a trip, an event a stop."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perron.functions.transit import DAYS


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@dataclass(frozen=True)
class Timetable:
    """The four tables every later stage works on."""

    stops: DataFrame  # stop_id, lat, lon
    trips: DataFrame  # trip_id, service_id
    services: DataFrame  # service_id, monday .. sunday, start_date, end_date
    stop_times: DataFrame  # trip_id, stop_id, stop_sequence, arrival_time, departure_time (ms)


def events_timetable(spark: SparkSession, sf_dir: str, few_stops: bool = False) -> Timetable:
    """Stops are the 100 values of ``props.k``, or the event types (``few_stops``: lines then have
    many trips and visit stops repeatedly)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "props")
    trip = (F.col("user_id") * 100000 + F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date"))).cast("long")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    stop = (F.array_position(F.array(*[F.lit(x) for x in EVENT_TYPES]), F.col("event_type")) - 1).cast("int") if few_stops else k
    at = ((F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts").cast("int")) * 1000).cast("long")
    order = Window.partitionBy("trip_id").orderBy("ts", "event_id")
    stop_times = (
        e.select(trip.alias("trip_id"), stop.alias("stop_id"), at.alias("arrival_time"), "ts", "event_id")
        .withColumn("stop_sequence", (F.row_number().over(order) - 1).cast("int"))
        .select("trip_id", "stop_id", "stop_sequence", "arrival_time", F.col("arrival_time").alias("departure_time"))
    )
    stops = e.select(stop.alias("stop_id")).distinct().select(
        "stop_id", (F.lit(48.0) + F.floor(F.col("stop_id") / 10) * 0.01).alias("lat"), (F.lit(9.0) + (F.col("stop_id") % 10) * 0.01).alias("lon")
    )
    trips = e.select(trip.alias("trip_id"), (F.col("user_id") % 7).cast("int").alias("service_id")).distinct()
    services = trips.select("service_id").distinct().select(
        "service_id",
        *[(F.col("service_id") % (i + 2) == 0).alias(d) for i, d in enumerate(DAYS)],
        F.lit("2024-01-01").cast("date").alias("start_date"),
        F.lit("2024-12-31").cast("date").alias("end_date"),
    )
    return Timetable(stops, trips, services, stop_times)
