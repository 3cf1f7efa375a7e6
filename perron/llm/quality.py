"""Quality rules: counts of words, symbols, repeated lines and repeated word windows, and the
divergence of a document's histograms from those of its language.

All of it is Spark SQL. The language references are histograms over all documents of a language
(one row per language); a document is compared with its own language's by Jensen-Shannon distance.
Short documents are not judged by it, nor are those of a language without a reference (or of none):
far from other languages says nothing about them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perron.staging import stage

# Frequent function words of English, German, French and Spanish, in that order.
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for",
    "der", "die", "und", "den", "das", "von", "mit", "ist",
    "le", "la", "les", "des", "et", "en", "un", "que",
    "el", "los", "de", "y", "por", "con", "se", "para",
)
CODES = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef"
CLASSES = ("space", "upper", "digit", "symbol", "punct", "nonascii", "other")
WHITE = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Minimum lengths: characters for the class histogram; words, and common words expected among them, for the word histogram.
MIN_CLASS_CHARS = 200
MIN_WORD_WORDS = 150
MIN_REFERENCE_CHARS = 20_000
MAX_CLASS_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.265
#: Least share of listed words in a language's reference for distances of words to mean anything.
MIN_LISTED_SHARE = 0.05
#: References of up to this many languages (counted first) are broadcast; more are shuffled.
BROADCAST_LANGUAGES = 10_000


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; empty for null."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def with_counts(docs: DataFrame, repeats: bool = True) -> DataFrame:
    """``docs`` with ``q_``-columns: the counts of the base rules and the two histograms.

    q_classes: characters by class; q_common: occurrences of each common word, then all other words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("q_words", words_of(text))
    plain = [w for w in COMMON_WORDS]
    both = plain + [w.capitalize() for w in plain]
    listed = ", ".join(f"'{w}'" for w in both)
    code = f"substr('{CODES}{CODES}', array_position(array({listed}), w), 1)"
    df = df.withColumn("q_code", F.expr(f"array_join(transform(filter(q_words, w -> w IN ({listed})), w -> {code}), '')"))
    df = df.withColumns(
        {
            "q_n_words": F.size("q_words").cast("long"),
            "q_word_chars": F.length(F.array_join("q_words", "")).cast("long"),
            "q_n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "q_chars": F.length(text).cast("long"),
            "q_upper": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
            "q_digit": F.regexp_count(text, F.lit("[0-9]")).cast("long"),
            "q_punct": F.regexp_count(text, F.lit(r"""[.,;:!?'"()\[\]{}/\\=+~^_@`-]""")).cast("long"),
            "q_nonascii": F.when(F.octet_length(text) > F.length(text), F.regexp_count(text, F.lit(r"[^\x00-\x7F]"))).otherwise(0).cast("long"),
        }
    )
    if repeats:
        df = df.withColumn("q_lines", F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != ""))
        df = df.withColumn("q_n_dup_lines", (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long")).drop("q_lines")
        # Windows of three words as hashes. Only where two are equal they are sorted, hash above and place below (as many
        # bits as places need): equal neighbours mark the places of repeated windows. Where the hash bits that are left
        # are equal and the words are not, the marked windows are sorted by their words instead.
        df = df.withColumn("q_place", F.expr("shiftleft(1L, cast(ceil(log2(greatest(size(q_words), 2))) as int)) - 1"))
        df = df.withColumn("q_hashes", F.expr("if(size(q_words) < 4, cast(array() as array<bigint>), transform(slice(q_words, 1, size(q_words) - 2), (w, i) -> xxhash64(w, q_words[i + 1], q_words[i + 2])))"))
        df = df.withColumn("q_windows", F.expr("if(size(array_distinct(q_hashes)) = size(q_hashes), cast(array() as array<bigint>), sort_array(transform(q_hashes, (h, i) -> (h & ~q_place) | i)))"))
        window = "array_join(slice(q_words, cast({0} & q_place as int) + 1, 3), ' ')"
        bits = "(x | q_place) = (coalesce(get({a}, i {o} 1), ~x) | q_place)"
        same = f"{window.format('x')} = {window.format('q_marked[i + 1]')}"
        df = df.withColumn("q_marked", F.expr(f"filter(q_windows, (x, i) -> {bits.format(a='q_windows', o='+')} OR {bits.format(a='q_windows', o='-')})"))
        df = df.withColumn("q_mixed", F.expr(f"exists(transform(q_marked, (x, i) -> {bits.format(a='q_marked', o='+')} AND NOT {same}), y -> y)"))
        by_words = f"sort_array(transform(q_marked, x -> named_struct('w', {window.format('x')}, 'p', x & q_place)))"
        twice = f"transform(array({by_words}), s -> transform(filter(s, (x, i) -> x.w <=> get(s, i + 1).w OR x.w <=> get(s, i - 1).w), x -> x.p))[0]"
        df = df.withColumn("q_places", F.expr(f"sort_array(if(q_mixed, {twice}, transform(q_marked, x -> x & q_place)))"))
        df = df.withColumn(
            "q_n_repeat_words",
            F.expr("aggregate(q_places, named_struct('n', 0L, 'last', -3L), (a, p) -> named_struct('n', a.n + least(3L, p - a.last), 'last', p), a -> a.n)"),
        ).drop("q_hashes", "q_windows", "q_places", "q_place", "q_marked", "q_mixed")
    space = "q_chars - q_word_chars"
    # White space is ASCII, so the classes add up to all characters.
    rest = "q_word_chars - q_upper - q_digit - q_n_symbols - q_punct - q_nonascii"
    df = df.withColumn("q_classes", F.expr(f"transform(array({space}, q_upper, q_digit, q_n_symbols, q_punct, q_nonascii, {rest}), x -> cast(x as double))"))
    counts = ", ".join(f"length(q_code) - length(replace(q_code, '{c}', ''))" for c in CODES)
    df = df.withColumn("q_common", F.expr(f"transform(array({counts}, size(q_words) - length(q_code)), x -> cast(x as double))"))
    return df.drop("q_words", "q_code", "q_upper", "q_digit", "q_punct", "q_nonascii")


def language_references(docs: DataFrame) -> DataFrame:
    """(lang, ref_classes, ref_common): each language's class and common-word histograms (shares), over
    all of its documents.

    Documents without lang or text add nothing; languages with under MIN_REFERENCE_CHARS characters
    give no reference, and one in which the listed words have under MIN_LISTED_SHARE of all words
    has no ref_common (null).
    """
    return references_of(with_counts(docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang"), repeats=False))


def references_of(counted: DataFrame) -> DataFrame:
    """The same from the columns that ``with_counts`` adds."""
    sums = counted.where("lang IS NOT NULL").groupBy("lang").agg(
        F.sum("q_chars").alias("n"),
        F.array(*[F.sum(F.col("q_classes")[i]) for i in range(len(CLASSES))]).alias("a"),
        F.array(*[F.sum(F.col("q_common")[i]) for i in range(len(CODES) + 1)]).alias("b"),
    )
    found = sums.where(F.col("n") >= MIN_REFERENCE_CHARS).select("lang", shares("a").alias("ref_classes"), shares("b").alias("ref_common"))
    return found.withColumn("ref_common", F.when(1 - F.element_at("ref_common", -1) >= MIN_LISTED_SHARE, F.col("ref_common")))


def shares(counts: str) -> Column:
    """A histogram column as shares of its sum."""
    total = f"array_repeat(aggregate({counts}, 0D, (a, x) -> a + x), size({counts}))"
    return F.expr(f"zip_with({counts}, {total}, (x, t) -> x / greatest(t, 1D))")


def js_distance(p: str, reference: str) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two columns of shares; null if either is."""
    half = "if({0} > 0, {0} * log2(2 * {0} / ({0} + {1})), 0D)"
    term = half.format("x", "q") + " + " + half.format("q", "x")
    return F.expr(f"if({p} IS NULL OR {reference} IS NULL, NULL, sqrt(greatest(0D, aggregate(zip_with({p}, {reference}, (x, q) -> {term}), 0D, (a, x) -> a + x) / 2)))")


#: What ``judge`` adds.
ADDED = ("q_n_words", "q_word_chars", "q_n_symbols", "q_n_dup_lines", "q_n_repeat_words", "q_chars", "q_classes", "q_common", "q_base_failed", "q_class_distance", "q_word_distance", "q_kept")


def judge(docs: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """``docs`` with the counts, ``q_base_failed``, the two distances and ``q_kept`` (names in ``ADDED``).

    The base rules reject documents of under MIN_WORDS words or with over MAX_REPEAT_PERCENT of
    their words in repeated windows (so null and empty texts). Beyond that a document is rejected if
    its distance from its own language's reference is over MAX_CLASS_DISTANCE (texts of
    MIN_CLASS_CHARS or more) or MAX_WORD_DISTANCE (MIN_WORD_WORDS or more). Where there is no such
    reference (lang null, under MIN_REFERENCE_CHARS characters in all, or for words a language in
    which the listed ones are rare) the distance is null and only the other rules count. Rows are
    judged one by one: repeats, other columns and ties make no difference; columns that have a name
    of ``ADDED``, in any case, are replaced, all others stay. An empty table gives no rows.
    """
    own = [c for c in docs.columns if c.lower() not in ADDED]
    refs = language_references(docs) if references is None else references
    # The row travels in one struct, so that no column of it meets a helper's name.
    judged = verdicts(with_counts(_carried(docs, own)), refs)
    return judged.select(*[F.col("q_row")[f"{c}"].alias(c) for c in own], *ADDED)


def _carried(docs: DataFrame, own: list[str]) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("q_row"), "text", "lang")


def verdicts(df: DataFrame, refs: DataFrame) -> DataFrame:
    """The verdict columns from the columns that ``with_counts`` adds and the languages' references."""
    refs = stage(refs.withColumnRenamed("lang", "ref_lang"), "references")
    refs = F.broadcast(refs) if refs.count() <= BROADCAST_LANGUAGES else refs
    df = df.withColumns({"q_p_classes": shares("q_classes"), "q_p_common": shares("q_common")})
    df = df.join(refs, F.col("lang") == F.col("ref_lang"), "left")
    df = df.withColumns({"q_class_distance": js_distance("q_p_classes", "ref_classes"), "q_word_distance": js_distance("q_p_common", "ref_common")})
    df = df.withColumn("q_base_failed", (F.col("q_n_words") < MIN_WORDS) | (F.col("q_n_repeat_words") * 100 > F.col("q_n_words") * MAX_REPEAT_PERCENT))
    odd = ((F.col("q_chars") >= MIN_CLASS_CHARS) & F.coalesce(F.col("q_class_distance") > MAX_CLASS_DISTANCE, F.lit(False))) | (
        (F.col("q_n_words") >= MIN_WORD_WORDS) & F.coalesce(F.col("q_word_distance") > MAX_WORD_DISTANCE, F.lit(False))
    )
    # The row number is always true, but as it is not deterministic, a filter on the verdict stays above the
    # projections and is not written out into them, which would compute the counts many times over.
    kept = ~F.col("q_base_failed") & ~odd & (F.monotonically_increasing_id() >= 0)
    return df.withColumn("q_kept", kept).drop("ref_lang", "ref_classes", "ref_common", "q_p_classes", "q_p_common")


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    # Counted once: the references and the verdicts both come from the written rows.
    counted = stage(with_counts(_carried(docs, docs.columns)).drop("text"), "quality-rows")
    kept = verdicts(counted, references_of(counted)).where("q_kept")
    return kept.select(*[F.col("q_row")[f"{c}"].alias(c) for c in docs.columns])


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    # Counts are written once, without the texts: the references and the verdicts both come from them.
    counted = stage(with_counts(docs).drop("text"), "quality-counts")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
    judged = verdicts(counted, references_of(counted)).select("doc_id", *[F.col(f"q_{n}").alias(n) for n in names])
    # Verdicts come from the full distances; shown are six places.
    return judged.withColumns({n: F.round(n, 6) for n in ("class_distance", "word_distance")})
