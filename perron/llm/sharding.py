"""Sharding by global byte-size prefix sums.

Documents are laid out in one global order, every document gets the number of bytes before it, and
the line is cut at equal byte targets, which gives contiguous and balanced shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perron.operators.prefix import prefix_sums
from perron.staging import stage


def shard_by_bytes(docs: DataFrame, shards: int, overhead: int = 8) -> DataFrame:
    """Contiguous shards of near-equal bytes over ``docs(doc_id, text)``.

    The order is doc_id (null first), then a hash of the text, then the scan position, so a
    repeated id or text never forms an indivisible block. A document belongs to the shard that
    holds its middle byte. Null text has no bytes (size = ``overhead``, crc32 0); repeated rows are
    separate documents; an empty table gives no rows; other columns are ignored. A document larger
    than a shard's target leaves neighbouring shards smaller.

    Returns doc_id, size, text_crc32, shard, slot (0-based position inside the shard).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = stage(
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.xxhash64(text).alias("_h"),
            F.monotonically_increasing_id().alias("_tie"),
        ),
        "shard-sizes",
    )
    line = prefix_sums(narrow, ["doc_id", "_h", "_tie"], ["size"])
    cut = line.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"((size_before * 2 + size) * {shards}) div (size_total * 2)")).cast("int"))
    firsts = cut.groupBy("shard").agg(F.min("idx").alias("_first"))  # one row per shard
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("idx") - F.col("_first")).cast("long").alias("slot")
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 24 shards under the law ``bytes``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_by_bytes(docs, 24).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
