"""Earliest arrivals by transfer patterns: only the stops that a pattern names are looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perron.staging import stage


def pattern_arrivals(patterns: DataFrame, stop_times: DataFrame, walks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, start, target, arrival): the best arrival along any pattern from start to target.

    ``patterns(start, intermediates, target)``; ``queries(query_id, start, tau)`` asks for all targets
    of the start's patterns, ``queries(query_id, start, tau, target)`` for one. A hop is a direct ride
    or a walk, no walk comes first or after a walk. All patterns of all queries take a hop at once,
    and the number of steps is that of the longest pattern. Targets without a feasible pattern give
    no row.
    """
    chain = F.concat(F.array("start"), F.col("intermediates"), F.array("target"))
    asked = queries.join(patterns, ["start", "target"] if "target" in queries.columns else ["start"])
    at = stage(asked.select("query_id", "start", "target", chain.alias("chain"), F.col("tau").cast("long").alias("tau"), F.lit(True).alias("walked")).distinct(), "pattern-states")
    longest = at.agg(F.max(F.size("chain"))).first()[0] or 0

    # Direct rides only between stops that follow each other in some pattern.
    pairs = at.select(F.explode(F.expr("transform(sequence(1, size(chain) - 1), i -> struct(chain[i - 1] AS a, chain[i] AS b))")).alias("p")).select("p.a", "p.b").distinct()
    board = stop_times.where("departure_time IS NOT NULL").select("trip_id", F.col("stop_id").alias("a"), F.col("stop_sequence").alias("_s"), "departure_time")
    alight = stop_times.where("arrival_time IS NOT NULL").select("trip_id", F.col("stop_id").alias("b"), F.col("stop_sequence").alias("_t"), "arrival_time")
    direct = stage(
        pairs.join(board, "a").join(alight, ["trip_id", "b"]).where("_s < _t").groupBy("a", "b", "departure_time").agg(F.min("arrival_time").alias("arrival_time")), "direct-rides"
    )

    done = None
    for k in range(1, longest):
        here = at.withColumns({"a": F.col("chain")[k - 1], "b": F.col("chain")[k]})
        key = ["query_id", "start", "target", "chain"]
        ride = here.groupBy(*key, "a", "b").agg(F.min("tau").alias("tau")).join(direct, ["a", "b"]).where("departure_time >= tau").groupBy(*key).agg(F.min("arrival_time").alias("tau")).withColumn("walked", F.lit(False))
        walk = (
            here.where("NOT walked")
            .join(walks.select(F.col("from_stop").alias("a"), F.col("to_stop").alias("b"), "duration_ms"), ["a", "b"])
            .groupBy(*key).agg(F.min(F.col("tau") + F.col("duration_ms")).alias("tau")).withColumn("walked", F.lit(True))
        )
        at = stage(ride.unionByName(walk), "pattern-states")
        ended = at.where(F.size("chain") == k + 1).select("query_id", "start", "target", "tau")
        done = ended if done is None else done.unionByName(ended)
        at = at.where(F.size("chain") > k + 1)
    if done is None:
        done = at.select("query_id", "start", "target", "tau").limit(0)
    return done.groupBy("query_id", "start", "target").agg(F.min("tau").alias("arrival"))
