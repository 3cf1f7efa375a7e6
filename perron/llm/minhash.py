"""Near-duplicates by circulant MinHash, banding and exact verification.

One permutation (sigma) spreads the shingles over a circle of 2**21 places; a second one (pi),
shifted circularly by 0, 1, 2, ..., gives every coordinate of the signature, so a shingle's values
are a contiguous slice of pi. Bands of the signature propose pairs; pairs are confirmed on whole
shingle sets.

No bucket is expanded into all of its pairs. First every member of a bucket meets the bucket's
pivot, the member that shares most buckets with others; these pairs (few, as a document is the
pivot of most of its buckets or of none) are compared on their sets, and their links give first
components. A proposed pair of different components then has at least one end outside of its
bucket's largest component, so it is enough that those outsiders meet the rest of their bucket,
once. That join evaluates an exact bound on the sets' bitmaps for each such pair and makes rows only
of pairs that can still reach the threshold, which are compared on their sets too. The components
then equal those of all proposed pairs; no bucket is capped and nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perron.llm.textkernel import chunks, mixed, shingles, word_hashes
from perron.operators.components import connected_components
from perron.plans.names import fresh
from perron.session import bound_arrow_batches
from perron.staging import discard, stage

CIRCLE_BITS = 21
BANDS = 40
ROWS = 6
#: Rows of sets that a slice copies at once: bounds the memory for very long documents.
SLICE_ROWS = 2048
#: Longs of the bitmaps that rule out pairs before their sets are compared.
MAP_LONGS = 32
#: Tables of document keys are broadcast up to this many rows (counted first), about 16 MB; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000

_tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def permutations(bits: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """sigma, and all circular slices of pi of the given length (a view)."""
    if (bits, length) not in _tables:
        rng = np.random.default_rng(97)
        sigma, pi = rng.permutation(1 << bits).astype(np.uint32), rng.permutation(1 << bits).astype(np.uint32)
        _tables[bits, length] = sigma, np.lib.stride_tricks.sliding_window_view(np.concatenate((pi, pi[: length - 1])), length)
    return _tables[bits, length]


def signatures(sets: np.ndarray, offsets: np.ndarray, length: int, bits: int = CIRCLE_BITS) -> np.ndarray:
    """Signatures (rows x length) of sets of 64-bit hashes; rows of empty sets hold the largest value."""
    sigma, slices = permutations(bits, length)
    places = sigma[(sets >> np.uint64(64 - bits)).astype(np.int64)]
    out = np.full((len(offsets) - 1, length), np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(len(offsets) - 1):
        for lo in range(offsets[i], offsets[i + 1], SLICE_ROWS):
            np.minimum(out[i], slices[places[lo : min(lo + SLICE_ROWS, offsets[i + 1])]].min(axis=0), out=out[i])
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per row and band; the band's number is part of it."""
    steps = np.random.default_rng(5).integers(1, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    split = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    return mixed((split * steps).sum(axis=2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def set_hashes(sets: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """16 bytes that identify a set; None for an empty one."""
    two = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(sets * np.uint64(k) + np.uint64(k >> 3))))) for k in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
    n = np.diff(offsets)
    both = np.stack([mixed(x[offsets[1:]] - x[offsets[:-1]] + n.astype(np.uint64)) for x in two], axis=1)
    return [b.tobytes() if k else None for b, k in zip(both, n, strict=True)]


def _each(batches: Iterator[pa.RecordBatch], ngram: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        for start, end, data, offsets in chunks(texts):
            h, row = word_hashes(data, offsets)
            yield (batch.slice(start, end - start), *shingles(h, row, end - start, ngram))


def signed(docs: DataFrame, ngram: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_hash, node, n, keys): a document's set hash, set size and band keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets, offsets in _each(batches, ngram):
            n = np.diff(offsets)
            keys = band_keys(signatures(sets, offsets, bands * rows), bands, rows).view(np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(set_hashes(sets, offsets), pa.binary()), pa.array(n.astype(np.int64)), keys], names=["doc_id", "text_hash", "node", "n", "keys"])

    return docs.select(F.col("doc_id").cast("long"), text_hash().alias("text_hash"), "text").mapInArrow(work, "doc_id long, text_hash long, node binary, n long, keys array<long>")


def text_hash() -> Column:
    """A hash that tells a document's texts apart where rows repeat its id; never null."""
    return F.xxhash64(F.lit("text"), "text")


def bitmaps(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of MAP_LONGS longs with a bit for every place (by hash) that a set's shingles take."""
    out = np.zeros((len(offsets) - 1, MAP_LONGS), dtype=np.uint64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    np.bitwise_or.at(out, (row, ((sets >> np.uint64(6)) % np.uint64(MAP_LONGS)).astype(np.int64)), np.uint64(1) << (sets & np.uint64(63)))
    return out.view(np.int64)


def may_link(percent: int) -> str:
    """SQL condition on rows x and p (n, bits, excess) that every pair at the threshold meets.

    A place that both sets take holds at least one shingle of each, and a set has ``excess`` more
    shingles than places, so the intersection has at most as many shingles as common places plus
    the smaller excess.
    """
    common = " + ".join(f"bit_count(x.bits[{i}] & p.bits[{i}])" for i in range(MAP_LONGS))
    return f"{100 + percent} * ({common} + least(x.excess, p.excess)) >= {percent} * (x.n + p.n)"


def shingle_sets(docs: DataFrame, ngram: int) -> DataFrame:
    """(node, shingles, bits, excess) of documents; one row per document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets, offsets in _each(batches, ngram):
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(sets.view(np.int64)))
            places = bitmaps(sets, offsets)
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(places) + 1, dtype=np.int32) * MAP_LONGS), pa.array(places.ravel()))
            excess = np.diff(offsets) - np.bitwise_count(places.view(np.uint64)).sum(axis=1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(set_hashes(sets, offsets), pa.binary()), lists, bits, pa.array(excess)], names=["node", "shingles", "bits", "excess"])

    return docs.select("text").mapInArrow(work, "node binary, shingles array<long>, bits array<long>, excess long")


def linked_pairs(ask: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of ``ask(a, b)`` whose whole sets reach the threshold."""
    return (
        ask.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("u")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("v")), "b")
        .select("a", "b", F.size(F.array_intersect("u", "v")).alias("i"), (F.size("u") + F.size("v")).alias("s"))
        .where(f"100 * i >= {percent} * (s - i)")
        .select("a", "b")
    )


def pivot_pairs(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Memberships ``(key, node)`` of the buckets with several members, and the distinct pairs
    ``(a, b)`` of a member and a pivot of its buckets whose sizes can reach the threshold."""
    banded = nodes.select("node", "n", F.explode("keys").alias("key"))
    # Staged, so that the joins by key are of two shuffled sides, whose hot partitions Spark splits.
    full = stage(banded.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "counts")
    shared = stage(banded.join(full, "key"), "buckets")
    degree = shared.groupBy("node").agg(F.sum("m").alias("degree"))
    ranked = shared.join(degree, "node").select("key", F.struct("degree", "node", "n").alias("p"))
    pivots = stage(ranked.groupBy("key").agg(F.max("p").alias("p")).select("key", F.col("p.node").alias("p"), F.col("p.n").alias("pn")), "pivots")
    met = shared.join(pivots, "key").where(f"node <> p AND 100 * least(n, pn) >= {percent} * greatest(n, pn)")
    ask = stage(met.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct(), "asked")
    return shared, ask


def outsider_pairs(shared: DataFrame, sets: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``(a, b, ca, cb)`` of a bucket's members in different components, of which one is
    outside of the bucket's largest, that the bounds on sizes and bitmaps leave possible."""
    # A bucket of two has its one pair tested by now.
    members = shared.where("m > 2").join(components, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    members = stage(members, "members")
    sizes = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    open_ = sizes.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count(F.lit(1)).alias("k")).where("k > 1").select("key", "main")
    open_ = stage(open_, "mains")
    told = members.join(open_, "key").join(sets.select("node", F.size("shingles").alias("n"), "bits", "excess"), "node")
    told = stage(told, "open")
    pairs = told.where("component <> main").alias("x").join(
        told.alias("p"),
        # Part of the join, so that a pair that cannot link is never a row; two outsiders meet once.
        F.expr(f"x.key = p.key AND x.component <> p.component AND (p.component = p.main OR p.node < x.node) AND 100 * least(x.n, p.n) >= {percent} * greatest(x.n, p.n) AND {may_link(percent)}"),
    )
    ends = "least(struct(x.node AS node, x.component AS c), struct(p.node AS node, p.component AS c))", "greatest(struct(x.node AS node, x.component AS c), struct(p.node AS node, p.component AS c))"
    found = stage(pairs.selectExpr(f"{ends[0]} AS a", f"{ends[1]} AS b").select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.c").alias("ca"), F.col("b.c").alias("cb")).distinct(), "asked")
    discard(members, open_, told)
    return found


def counted_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A staged frame of keys with a broadcast hint if its counted rows allow it; else it is shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def components_of(docs: DataFrame, nodes: DataFrame, ngram: int, percent: int) -> DataFrame | None:
    """(node, component) of the nodes with links, or None if nothing is linked."""
    shared, ask = pivot_pairs(nodes, percent)
    wanted = stage(shared.select("node").distinct().join(nodes.select("node", "id"), "node").select(F.col("id").alias("doc_id")).distinct(), "wanted")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(counted_small(wanted), "doc_id", "left_semi")
    # Rows that repeat an id bring texts of their own along, which nobody asks for.
    sets = stage(shingle_sets(texts, ngram).where("node IS NOT NULL").dropDuplicates(["node"]), "sets")

    links = stage(linked_pairs(ask, sets, percent), "links")
    if not links.limit(1).count():
        components = stage(nodes.select("node", F.col("node").alias("component")).limit(0), "labels")
    else:
        components = connected_components(links, smallest=False)
    more = outsider_pairs(shared, sets, components, percent)
    met = linked_pairs(more, sets, percent).join(more, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    met = stage(met, "links")
    if met.limit(1).count():
        # Only the components that these links join are renamed; single nodes are their own.
        joined = connected_components(met, smallest=False).select(F.col("node").alias("component"), F.col("component").alias("whole"))
        every = components.unionByName(met.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(components, "node", "left_anti").select("node", F.col("node").alias("component")))
        components = stage(every.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component")), "labels")
    discard(shared, ask, wanted, sets, more)
    return components if components.limit(1).count() else None


def verdicts(docs: DataFrame, ngram: int, percent: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept) for every row of ``docs(doc_id, text)``."""
    bound_arrow_batches(docs.sparkSession)
    sig = stage(signed(docs, ngram, bands, rows), "signatures")
    nodes = stage(
        sig.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.min_by("keys", "doc_id").alias("keys")),
        "nodes",
    )
    components = components_of(docs, nodes, ngram, percent)
    labels = nodes.select("node", "id")
    if components is not None:
        named = components.join(labels, "node").groupBy("component").agg(F.min("id").alias("least"))
        labels = labels.join(components.join(named, "component").select("node", "least"), "node", "left")
    else:
        labels = labels.withColumn("least", F.lit(None).cast("long"))
    # Staged, so that the last join is of two shuffled sides: a set that very many copies share is split.
    labels = stage(labels.select("node", F.coalesce("least", "id").alias("least")), "labels")
    return (
        sig.select("doc_id", "text_hash", "node", "n")
        .join(labels, "node", "left")
        .select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def near_duplicates(docs: DataFrame, ngram: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text)``.

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets of distinct
    ``ngram``-word shingles (A-Z lower-cased); component_id is the smallest doc_id reachable, and
    the document that has it is kept. Equal sets (exact copies, repeated rows) are one node and
    linked without being compared. Null, empty and blank texts have no set and stand alone; so does
    a row without doc_id (component_id null, kept). Rows that repeat an id share its verdict if
    their texts are linked; else each stands for itself. Other columns are ignored, whatever their
    names; an empty table gives no rows.

    A pair at the threshold is proposed by 40 bands of 6 with probability 1 - 6e-6; after that
    nothing is lost. The signature has 32-bit values of 2**21 places, and nodes are told apart by
    128-bit hashes.
    """
    return verdicts(docs, ngram, percent, bands, rows).drop("text_hash")


def deduplicated(docs: DataFrame, ngram: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows whose document is not the one kept of its group.

    Of several rows that repeat the kept id and text, one stays; rows that repeat an id with another
    text have a verdict of their own. Rows without id stay. All columns of ``docs`` stay as they are.
    """
    verdict = stage(verdicts(docs, ngram, percent, BANDS, ROWS).where("doc_id IS NOT NULL").select("doc_id", "text_hash", "kept"), "verdicts")
    id_, hash_, kept = fresh(docs.columns, "id", "hash", "kept")
    names = [F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)]
    gone = counted_small(stage(verdict.where("NOT kept").select(*names).distinct(), "gone"))
    again = stage(verdict.where("kept").groupBy(*names).count().where("count > 1").select(id_, hash_), "repeated")
    match = (F.col("doc_id").cast("long") == F.col(id_)) & (text_hash() == F.col(hash_))
    left = docs.join(gone, match, "left_anti")
    if not again.limit(1).count():
        return left
    again = counted_small(again)
    once = left.join(again, match, "left_semi").withColumn(kept, text_hash()).dropDuplicates(["doc_id", kept]).drop(kept)
    return left.join(again, match, "left_anti").unionByName(once)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents on two-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ngram=2)
