"""Mixing sources to target weights with a low-discrepancy schedule.

Golden-ratio points, taken one per slot, are mapped through the cumulative target weights of the
sources, so every stretch of the schedule holds each source near its weight. Slots are ranked per
source, and slot k of a source takes block k of that source's shuffled stream of words, read in a
circle, in blocks of equal length: ranked slots are joined with the blocks' parts of documents. What
a document gives is the sum of its parts in the blocks that the schedule takes; the mixed documents
come in the order of the slots. Ranking and joining move narrow rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perron.operators.prefix import prefix_sums
from perron.plans.names import fresh
from perron.staging import discard, stage

#: 2**32 / golden ratio, odd: j * STEP mod 2**32 is the golden-ratio sequence on a 32-bit circle.
STEP = 2654435769
CIRCLE = 1 << 32
CELL_BITS = 12
CHUNK = 1 << 16
#: There are at least SLOTS slots unless the words are fewer, and a block has at most BLOCK words.
SLOTS = 1 << 16
BLOCK = 4096
#: Frames of at most this many rows (counted first) are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 10_000
#: Slots of the blocks that follow the schedule.
LATE = 1 << 60


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def small(df: DataFrame) -> DataFrame:
    """A staged frame with a broadcast hint if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def ordered_sums(df: DataFrame, keys: list[str], sums: list[str], index: str) -> DataFrame:
    """``prefix_sums`` of a table of one row a source: where there are few (counted first), in one partition."""
    df = stage(df, "sources")
    if df.count() > BROADCAST_ROWS:
        return prefix_sums(df, keys, sums, index)
    line = Window.orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    before, whole = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    added = [F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long").alias(f"{c}_before") for c in sums] + [F.coalesce(F.sum(c).over(whole), F.lit(0)).cast("long").alias(f"{c}_total") for c in sums]
    return df.select("*", (F.row_number().over(line) - 1).cast("long").alias(index), *added)


def source_targets(sizes: DataFrame, pattern: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Targets per source from ``sizes(source, source_size)``.

    Sources in code-point order, null last, weigh ``pattern``, repeating. Together they get all
    words; a target above ``most`` times its source's size is cut to that, and the excess goes to
    the others by weight until none is above. The fixed point is min(most * size, level * weight):
    sources are sorted by most * size / weight, and the level is the first one at which the sources
    from there on stay below their caps.
    """
    n = len(pattern)
    ranked = ordered_sums(
        sizes.select("source", "source_size", F.col("source").isNull().alias("_last")).where("source_size is not null"),
        ["_last", "source"], [], "_rank",
    )
    weights = F.array(*[F.lit(w) for w in pattern])
    ratio = (
        ranked.withColumn("weight", F.element_at(weights, (F.col("_rank") % n + 1).cast("int")).cast("long"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("_ratio", F.col("cap") / F.col("weight"))
    )
    line = ordered_sums(ratio, ["_ratio", "_rank"], ["cap", "weight", "source_size"], "_i")
    level = (F.col("source_size_total") - F.col("cap_before")) / (F.col("weight_total") - F.col("weight_before"))
    line = stage(line.withColumn("_level", level), "levels")
    # The first source in this order that its level leaves below its cap; there always is one, or all sizes are 0.
    common = line.where(F.col("_level") <= F.col("_ratio")).agg(F.min_by("_level", "_i")).first()[0] or 0.0
    return stage(
        line.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.lit(common) * F.col("weight")).alias("target")),
        "targets",
    )


def schedule_slots(targets: DataFrame, slots: int = SLOTS, block: int = BLOCK) -> tuple[DataFrame, int]:
    """The schedule: rows ``(slot, source)`` and the words of a block.

    Slot j's point is j / golden ratio mod 1; the source is the one whose stretch of the cumulative
    weights holds it. Stretches are found through a grid of equal cells, an equi-join.
    """
    spark = targets.sparkSession
    line = ordered_sums(targets.withColumn("_t", F.ceil("target").cast("long")).withColumn("_null", F.col("source").isNull()), ["_null", "source"], ["_t"], "_i")
    line = stage(line, "stretches")
    head = line.agg(F.coalesce(F.max("_t_total"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    total, words = int(head[0]), int(head[1])
    length = max(1, min(block, -(-words // slots)))
    n = words // length
    shift = 32 - CELL_BITS
    lo = F.floor(F.col("_t_before").cast("double") / max(total, 1) * CIRCLE).cast("long")
    hi = F.floor((F.col("_t_before") + F.col("_t")).cast("double") / max(total, 1) * CIRCLE).cast("long")
    stretches = line.where("_t > 0").select("source", lo.alias("_lo"), hi.alias("_hi")).where("_hi > _lo")
    stretches = stretches.select("*", F.explode(F.sequence(F.shiftright("_lo", shift), F.shiftright(F.col("_hi") - 1, shift))).alias("_cell"))
    points = spark.range(n).select(F.col("id").alias("slot"), F.pmod(F.expr(f"(id % {CIRCLE}L) * {STEP >> 16}L % {CIRCLE}L * 65536L % {CIRCLE}L + (id % {CIRCLE}L) * {STEP & 0xFFFF}L % {CIRCLE}L"), F.lit(CIRCLE)).alias("_u"))
    points = points.withColumn("_cell", F.shiftright("_u", shift))
    found = points.join(F.broadcast(stretches) if stretches.count() <= 2 * BROADCAST_ROWS else stretches, "_cell").where("_u >= _lo AND _u < _hi")
    return found.select("slot", "source"), length


def ranked_slots(schedule: DataFrame) -> DataFrame:
    """Add ``k``, the rank of a slot among those of its source (from 0), chunk by chunk so that a
    source with a third of all slots is not ranked in one task."""
    chunked = stage(schedule.withColumn("_chunk", F.floor(F.col("slot") / CHUNK)), "schedule")
    counts = chunked.groupBy("source", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_o", F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (
        chunked.withColumn("_r", F.row_number().over(Window.partitionBy("source", "_chunk").orderBy("slot")) - 1)
        .alias("a")
        .join(before.alias("b"), F.expr("a.source <=> b.source AND a._chunk = b._chunk"))
        .select("a.slot", "a.source", (F.col("a._r") + F.col("b._o")).cast("long").alias("k"))
    )


def shuffle_key() -> Column:
    """A document's place in its source's shuffled stream, from its id and text alone."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def block_plan(targets: DataFrame, slots: int = SLOTS, block: int = BLOCK) -> tuple[DataFrame, int]:
    """The blocks that the mix takes, ``(source, k, slot, words)``, and the words of a whole block.

    Slot k of a source takes its block k until its target, rounded to a word, is reached; the last
    block is cut there and later slots take nothing. Where a source has too few slots (a target of
    less than a block, or the discrepancy of the points), its further blocks follow after the
    schedule, so every source gets its target to the word.
    """
    schedule, length = schedule_slots(targets, slots, block)
    need = targets.select("source", F.least(F.round("target").cast("long"), "most_words").alias("words")).where("words > 0")
    every = need.select("source", "words", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / length))).alias("k"))
    joined = every.alias("e").join(ranked_slots(schedule).alias("s"), F.expr("e.source <=> s.source AND e.k = s.k"), "left")
    late = F.lit(LATE) + F.col("e.k")
    plan = joined.select("e.source", "e.k", F.coalesce("s.slot", late).alias("slot"), F.least(F.lit(length).cast("long"), F.col("e.words") - F.col("e.k") * length).alias("words"))
    return stage(plan, "blocks"), length


def taken_parts(docs: DataFrame, pattern: tuple[int, ...] = (1, 2, 3), most: int = 3, slots: int = SLOTS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """What the mix takes: ``rows`` (source, key, id, size, source_size, target, copies), one for every
    distinct document, and ``parts`` (source, key, id, lap, words, slot), the words taken of it in each
    round through its source's stream and the first slot that takes some."""
    rows = docs.select("source", shuffle_key().alias("key"), F.col("doc_id").cast("long").alias("id"), word_count(F.col("text")).alias("size"))
    groups = stage(rows.groupBy("source", "key", "id", "size").agg(F.count(F.lit(1)).alias("copies")).withColumn("g", F.col("size") * F.col("copies")), "mix-groups")
    sizes = stage(groups.groupBy("source").agg(F.sum("g").cast("long").alias("source_size")), "source-sizes")
    targets = source_targets(sizes, pattern, most).withColumn("most_words", F.col("source_size") * most)
    plan, length = block_plan(targets, slots, block)

    line = stage(prefix_sums(groups.where("g > 0").withColumn("_null", F.col("source").isNull()), ["_null", "source", "key", "id"], ["g"], "_i"), "mix-line")
    starts = line.groupBy("source").agg(F.min("g_before").alias("start"))
    heads = targets.alias("t").join(starts.alias("s"), F.expr("t.source <=> s.source")).select("t.source", "t.source_size", F.least(F.round("t.target").cast("long"), "t.most_words").alias("want"), "s.start")
    heads = small(stage(heads.where("want > 0"), "mix-starts"))
    # Every round through the stream, as far as the target reaches, cut into blocks.
    laps = (
        line.alias("l").join(heads.alias("h"), F.expr("l.source <=> h.source"))
        .select("l.source", "l.key", "l.id", "l.g", "h.want", "h.source_size", (F.col("l.g_before") - F.col("h.start")).alias("at"), F.explode(F.expr("sequence(0L, (h.want - 1) div h.source_size)")).alias("lap"))
        .select("source", "key", "id", "lap", (F.col("lap") * F.col("source_size") + F.col("at")).alias("a"), F.least(F.col("lap") * F.col("source_size") + F.col("at") + F.col("g"), "want").alias("b"))
        .where("a < b")
        .select("*", F.explode(F.expr(f"sequence(a div {length}L, (b - 1) div {length}L)")).alias("k"))
    )
    overlap = F.expr(f"least(d.b, d.k * {length}L + p.words) - greatest(d.a, d.k * {length}L)")
    joined = laps.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source AND d.k = p.k")).select("d.source", "d.key", "d.id", "d.lap", "p.slot", overlap.alias("w")).where("w > 0")
    parts = stage(joined.groupBy("source", "key", "id", "lap").agg(F.sum("w").alias("words"), F.min("slot").alias("slot")), "mix-parts")
    known = targets.select("source", "source_size", "target")
    known = small(stage(known, "mix-targets"))
    rows = stage(groups.alias("g").join(known.alias("t"), F.expr("g.source <=> t.source")).select("g.source", "g.key", "g.id", "g.size", "t.source_size", "t.target", "g.copies"), "mix-rows")
    discard(groups, line, plan)
    return rows, parts


def mix(docs: DataFrame, pattern: tuple[int, ...] = (1, 2, 3), most: int = 3, slots: int = SLOTS, block: int = BLOCK) -> DataFrame:
    """``docs`` with the words that the mix takes from each row.

    Adds ``_size``, ``_source_size``, ``_target``, ``_taken`` and ``_slot``, the first slot that takes
    words of the row (null: none); input columns of these names, in any case, are replaced, all others
    stay as they are. A source's stream is ordered by a hash of (doc_id, text); rows equal in both are
    one document whose words are split evenly among them (rounded down). A source gives its target,
    rounded to a word, whatever its size, and no row more than ``most`` times its own size. Null
    source is a source of its own, null text has size 0, an empty table gives no rows.
    """
    rows, parts = taken_parts(docs, pattern, most, slots, block)
    whole = parts.groupBy("source", "key", "id").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    found = rows.alias("r").join(whole.alias("w"), F.expr("r.source <=> w.source AND r.key = w.key AND r.id <=> w.id"), "left").select(
        "r.*", F.expr("coalesce(w.words, 0L) div r.copies").alias("taken"), "w.slot"
    )
    added = {"_size": "size", "_source_size": "source_size", "_target": "target", "_taken": "taken", "_slot": "slot"}
    own = [c for c in docs.columns if c.lower() not in added]
    return _joined(docs, found, own, [F.col(f"m.{v}").alias(k) for k, v in added.items()])


def _joined(docs: DataFrame, found: DataFrame, own: list[str], more: list[Column], how: str = "inner") -> DataFrame:
    """Rows of ``docs`` with what ``found`` (source, key, id, ...) says of their documents."""
    (key,) = fresh(docs.columns, "key")
    match = f"d.source <=> m.source AND d.`{key}` = m.key AND cast(d.doc_id AS long) <=> m.id"
    return docs.withColumn(key, shuffle_key()).alias("d").join(found.alias("m"), F.expr(match), how).select(*[F.col(f"d.`{c}`") for c in own], *more)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix holds them, in the order of its schedule.

    A row comes once for every round through its source in which the mix takes at least half of its
    words, at the first slot that takes some; a row without words comes once, at the start. Columns
    stay as they are.
    """
    rows, parts = taken_parts(docs, **options)
    taken = rows.alias("r").join(parts.alias("p"), F.expr("r.source <=> p.source AND r.key = p.key AND r.id <=> p.id"), "left")
    copies = taken.where("r.size = 0 OR 2 * p.words >= r.size * r.copies").select("r.source", "r.key", "r.id", F.coalesce("p.slot", F.lit(-1)).alias("slot"))
    (slot,) = fresh(docs.columns, "slot")
    placed = _joined(docs, stage(copies, "mix-copies"), docs.columns, [F.col("m.slot").alias(slot)])
    return placed.repartitionByRange(F.col(slot), F.col("doc_id")).sortWithinPartitions(slot, "doc_id").drop(slot)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rows, parts = taken_parts(docs)
    whole = parts.groupBy("source", "key", "id").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    found = rows.alias("r").join(whole.alias("w"), F.expr("r.source <=> w.source AND r.key = w.key AND r.id <=> w.id"), "left")
    # Repeated rows are counted, so the narrow table has all that is returned.
    every = found.select("r.*", F.expr("coalesce(w.words, 0L) div r.copies").alias("taken"), F.col("w.slot").alias("first_slot")).withColumn("_copy", F.explode(F.expr("sequence(1L, copies)")))
    return every.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "first_slot", "source")
