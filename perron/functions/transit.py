"""Column functions of the timetable domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8  # fixed value: mean earth radius
WALKING_KMH = 7.0
MAX_WALK_MS = 15 * 60 * 1000
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres of two points in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * EARTH_RADIUS_M)


def travel_ms(metres: Column, kmh: float) -> Column:
    """Whole milliseconds for a distance at a speed."""
    return (metres / 1000 / kmh * 3600000).cast("long")


def gtfs_time_ms(text: Column) -> Column:
    """``H:M:S`` as milliseconds since midnight; over 24 h is fine, missing parts add nothing, further
    parts are ignored; null for null or non-numeric parts (``bad_times`` finds those)."""
    part = F.split(text, ":")
    value = lambda i, w: F.when(F.size(part) > i, F.get(part, F.lit(i)).try_cast("long") * w).otherwise(0)
    return F.when(text.isNotNull(), (value(0, 3600) + value(1, 60) + value(2, 1)) * 1000)


def service_date(text: Column) -> Column:
    """Strict yyyyMMdd; null if it does not match."""
    return F.when(text.rlike("^[0-9]{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))


def merge_score(weight: Column, size_a: Column, size_b: Column) -> Column:
    """Score of merging two clusters; the smallest is merged first."""
    return (1 / size_a) * (1 / size_b) * (weight / F.sqrt(size_a) + weight / F.sqrt(size_b))


def trips_per_year() -> Column:
    """Weekday flags to runs per year (52 weeks)."""
    total = F.lit(0)
    for d in DAYS:
        total = total + F.col(d).cast("int")
    return (total * 52).cast("long")


def stop_name(stop_id: Column) -> Column:
    """A stop's id as it is shown: ``s:`` and the number."""
    return F.concat(F.lit("s:"), stop_id.cast("string"))


def parse_stop(text: Column) -> Column:
    """A stop's id from its number or from how it is shown; null for anything else."""
    return F.when(text.rlike("^(s:)?[0-9]+$"), F.regexp_replace(text, "^s:", "").try_cast("int"))
