"""Session settings shared by tests, the bench and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings every plan here assumes (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("perron")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", os.environ.get("SPARK_LOCAL_IP", "127.0.0.1"))
        .getOrCreate()
    )


def bound_arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower the session's rows per Arrow batch to at most ``rows``.

    Spark's default of 10,000 rows of text takes hundreds of MB of direct memory in an executor,
    which its Python workers then lack. The setting changes no result and stays for the session.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
