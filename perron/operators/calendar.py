"""Service calendars: which services run on which dates, and stop times of real days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perron.functions.transit import DAYS

DAY_MS = 86_400_000


def service_days(services: DataFrame, first: str, last: str) -> DataFrame:
    """(service_id, date) for every date in [first, last] on which a service runs: inside its own
    start and end date (null: open) and on a weekday that it has."""
    begin = F.greatest(F.lit(first).cast("date"), F.col("start_date"))  # greatest and least skip nulls
    end = F.least(F.lit(last).cast("date"), F.col("end_date"))
    dated = services.where(begin <= end).withColumn("date", F.explode(F.sequence(begin, end)))
    runs = F.element_at(F.array(*DAYS), F.weekday("date") + 1)
    return dated.where(runs).select("service_id", "date")


def dated_stop_times(stop_times: DataFrame, trips: DataFrame, services: DataFrame, first: str, last: str) -> DataFrame:
    """Stop times of each run of a trip in [first, last], in milliseconds since the epoch (UTC).

    A run's trip_id is the trip's times 100000 plus the days since the epoch. Times beyond 24 h fall
    on the next day, so routing over several dates needs nothing else.
    """
    runs = trips.select("trip_id", "service_id").join(service_days(services, first, last), "service_id").select("trip_id", F.datediff("date", F.lit("1970-01-01").cast("date")).alias("_day"))
    shift = F.col("_day").cast("long") * DAY_MS
    return stop_times.join(runs, "trip_id").select(
        (F.col("trip_id").cast("long") * 100_000 + F.col("_day")).alias("trip_id"),
        "stop_id",
        "stop_sequence",
        (F.col("arrival_time") + shift).alias("arrival_time"),
        (F.col("departure_time") + shift).alias("departure_time"),
    )
