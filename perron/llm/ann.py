"""Approximate nearest neighbours on several Hilbert orderings.

Vectors are projected at random to a few dimensions, several times; every projection is ordered
along a Hilbert curve, and the rows are range-partitioned by their place. A query looks at the rows
near it in each ordering, and what the windows find is merged and ranked by the exact cosine.

How wide the windows must be depends on the data alone, so it is measured: a bounded sample of
queries is answered by brute force (one linear pass), and the width is the one within which the
wanted share of their true neighbours lies in at least one ordering. Data without structure in 64
dimensions needs windows of some per cent of all rows, clustered data very few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perron.operators.prefix import prefix_sums
from perron.staging import stage

ORDERINGS = 16
PROJECTED = 6
BITS = 10
#: Queries in the sample that sets the window (bound), and the share of their neighbours it must hold.
SAMPLE = 256
AIM = 0.96
MIN_WINDOW = 128
MAX_BLOCK = 2048
#: Queries that meet one block of rows in one group.
GROUP_QUERIES = 2048


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows x dimensions, below 2**bits), by
    Skilling's transposition (AIP Conference Proceedings 707, 381); at most 63 bits in all."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        side = np.int64(1 << level)
        for i in range(dims):
            upper = (x[i] & side) != 0
            swap = np.where(upper, 0, (x[0] ^ x[i]) & (side - 1))
            x[0] ^= np.where(upper, side - 1, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1, np.int64((1 << level) - 1), 0)
    x ^= turn
    key = np.zeros(x.shape[1], dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def units(m: np.ndarray) -> np.ndarray:
    scaled = m / np.abs(m).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows in pairs, each from its own two rows alone, so equal pairs give equal bits."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    return dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))


def best_of(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of the k nearest rows of each query, ties to smaller ids."""
    near = units(queries) @ units(rows).T
    k = min(k, len(rows))
    floor = np.partition(near, len(rows) - k, axis=1)[:, len(rows) - k] - 1e-9
    q, r = np.nonzero(near >= floor[:, None])
    score = cosine(queries[q], rows[r])
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    keep = rank < k
    return q[keep], ids[r][keep], score[keep]


def valid_vectors(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that can take part, and their dimension.

    Out are null ids and vectors, empty and zero vectors, those with null or non-finite components,
    and those whose length is not the most frequent one (the smaller among equals).
    """
    v = F.col(vec)
    good = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & F.expr("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
        & F.expr("exists(v, x -> x <> 0)")
    )
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dims = int(sizes[0]["d"]) if sizes else 0
    return good.where(F.size("v") == dims), dims


def projections(dims: int) -> np.ndarray:
    """(ORDERINGS, dims, PROJECTED) random directions, orthogonal within an ordering where that is possible."""
    rng = np.random.default_rng(71)
    return np.stack([np.linalg.qr(rng.normal(size=(max(dims, PROJECTED), max(dims, PROJECTED))))[0][:dims, :PROJECTED] for _ in range(ORDERINGS)])


def orderings(rows: DataFrame, dims: int) -> DataFrame:
    """(ordering, pos, id): every row's place (from 0) in every ordering of ``rows(id, v)``."""
    directions = projections(dims)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros((ORDERINGS, PROJECTED)), np.zeros((ORDERINGS, PROJECTED))
        for batch in batches:
            if batch.num_rows:
                y = np.einsum("nd,odp->onp", units(matrix(batch.column(0), dims)), directions, optimize=True)
                n, total, square = n + y.shape[1], total + y.sum(1), square + (y * y).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.ravel().tolist()]), pa.array([square.ravel().tolist()])], names=["n", "s", "q"])

    m = ORDERINGS * PROJECTED
    sums = rows.select("v").mapInArrow(moments, "n long, s array<double>, q array<double>")
    head = sums.agg(F.sum("n"), *[F.sum(F.col(c)[i]) for c in "sq" for i in range(m)]).first()
    n = max(1, head[0] or 0)
    mean = np.array([x or 0.0 for x in head[1 : m + 1]]).reshape(ORDERINGS, 1, PROJECTED) / n
    spread = np.sqrt(np.maximum(np.array([x or 0.0 for x in head[m + 1 :]]).reshape(ORDERINGS, 1, PROJECTED) / n - mean * mean, 1e-18))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            y = (np.einsum("nd,odp->onp", units(matrix(batch.column(1), dims)), directions, optimize=True) - mean) / spread
            # About equal numbers of rows in every slab: the logistic curve is near the normal distribution's.
            cells = np.minimum((1 << BITS) - 1, ((1 << BITS) / (1 + np.exp(-1.702 * np.clip(y, -12, 12)))).astype(np.int64))
            for o in range(ORDERINGS):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, o, np.int32)), pa.array(hilbert_keys(cells[o], BITS)), batch.column(0)], names=["ordering", "key", "id"])

    placed = stage(rows.select("id", "v").mapInArrow(keys, "ordering int, key long, id long"), "curve")
    line = prefix_sums(placed, ["ordering", "key", "id"], [], "idx")
    return stage(line.select("ordering", (F.col("idx") - F.col("ordering") * F.lit(int(head[0] or 0))).alias("pos"), "id"), "places")


def window_width(rows: DataFrame, places: DataFrame, dims: int, k: int, sample: int = SAMPLE, aim: float = AIM) -> int:
    """The half-width within which the share ``aim`` of the true neighbours of a sample of rows lies
    in some ordering. The sample is the ``sample`` rows with the smallest hashes of their ids."""
    probe = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    ids, vectors = np.array([r["id"] for r in probe], dtype=np.int64), np.array([r["v"] for r in probe], dtype=np.float64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q, near, score = best_of(vectors, matrix(batch.column(1), dims), batch.column(0).to_numpy(), k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(near), pa.array(score)], names=["q", "id", "score"])

    found = rows.select("id", "v").mapInArrow(scan, "q long, id long, score double").where("q <> id")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    pairs = stage(found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("q", "id"), "true-neighbours")
    # Bounded by the sample: at most sample * k pairs.
    mine = places.join(F.broadcast(pairs.select(F.col("q").alias("id")).distinct()), "id").select("ordering", F.col("pos").alias("_at"), F.col("id").alias("q"))
    theirs = F.broadcast(pairs).join(places, "id")
    gaps = theirs.join(mine, ["ordering", "q"]).groupBy("q", "id").agg(F.min(F.abs(F.col("pos") - F.col("_at"))).alias("gap"))
    width = gaps.agg(F.percentile("gap", aim)).first()[0]
    return max(MIN_WINDOW, int(width or 0) + 1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, vec: str = "embedding", window: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each ``vec_id`` of ``queries`` its ``k`` nearest rows of
    ``vectors`` found, nearest first, ties to the smaller vec_id.

    Equal vectors are one point of the index that knows its ``k + 1`` smallest ids (more cannot be
    among the nearest), so a vector that a third of all rows share is neither compared nor shuffled
    more than once. Vectors that cannot take part (see ``valid_vectors``) neither ask nor answer;
    rows that repeat an id and a vector count once; empty tables give no rows; a query with fewer
    candidates returns them all. ``window`` None: measured by ``window_width``.
    """
    spark = vectors.sparkSession
    good, dims = valid_vectors(vectors, vec=vec)
    result = "query_id long, rank int, vec_id long, score double"
    if dims == 0:
        return spark.createDataFrame([], result)
    good = stage(good.distinct(), "vectors")
    copies = good.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    points = stage(copies.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("id", F.col("ids")[0]), "points")
    rows = points.select("id", "v")
    n = rows.count()
    places = orderings(rows, dims)
    half = window or window_width(rows, places, dims, k)
    block = int(min(MAX_BLOCK, max(64, half)))

    asked = stage(queries.select(F.col("vec_id").cast("long")).distinct().join(good, "vec_id").join(points.select("v", "id"), "v").select(F.col("vec_id").alias("query_id"), "id"), "queries")
    ask = asked.select("id").distinct()
    share = ask.count() / max(1, n)
    chunks = max(1, int((2 * half + block) * share / GROUP_QUERIES) + 1)

    first, last = F.floor(F.greatest(F.col("pos") - half, F.lit(0)) / block), F.floor(F.least(F.col("pos") + half, F.lit(n - 1)) / block)
    spread = places.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))) if chunks > 1 else places.withColumn("chunk", F.lit(0))
    hosts = spread.select("ordering", F.floor(F.col("pos") / block).alias("block"), "chunk", F.lit(False).alias("asks"), "id")
    guests = (
        places.join(ask, "id")
        .select("ordering", F.explode(F.sequence(first, last)).alias("block"), F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(True).alias("asks"), "id")
    )
    members = hosts.unionByName(guests).join(rows, "id")

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = table.column("asks").to_numpy()
        ids, m = table.column("id").to_numpy(), matrix(pa.concat_arrays(table.column("v").chunks), dims)
        if not asks.any() or asks.all():
            q, near, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            q, near, score = best_of(m[asks], m[~asks], ids[~asks], k + 1)
            q = ids[asks][q]
        return pa.table({"q": q, "id": near, "score": score})

    met = members.groupBy("ordering", "block", "chunk").applyInArrow(meet, "q long, id long, score double")
    merged = met.groupBy("q", "id").agg(F.max("score").alias("score"))
    merged = merged.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("_r") <= k + 1).drop("_r")
    # Points to rows: every id of a point, but not the query's own.
    listed = stage(merged.join(points.select("id", "ids"), "id").select("q", "score", F.explode("ids").alias("vec_id")), "found")
    final = asked.withColumnRenamed("id", "q").join(listed, "q").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return final.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vec_id divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), 5)
