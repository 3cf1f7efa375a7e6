"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram is bound from its letters: the first
letter's vector permuted (rolled) n-1 times, the second n-2 times, and so on, multiplied element by
element. A document bundles (adds) the vectors of its n-grams, a language bundles its documents,
and a document is compared with every language by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perron.operators.prefix import prefix_sums
from perron.session import bound_arrow_batches
from perron.staging import stage

DIMENSIONS = 512
NGRAM = 3
#: Letters have ids 1 to LETTERS - 1 (by code point, modulo); 0 is everything between words.
LETTERS = 256
#: Prototypes that go to the tasks at once (4 KB each); the documents pass by again for every further thousand.
LANGUAGES_AT_ONCE = 1000
UNKNOWN = "und"
#: Characters, and different n-grams, worked on at once; the bundles of a longer document are added up.
SLICE_CHARS = 1 << 20
SLICE_GRAMS = 1 << 12

_state: dict[str, np.ndarray] = {}


def letter_ids(text: str) -> np.ndarray:
    """Ids of a lower-cased text: letters, and one 0 for every run of anything else, also at both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    if "letters" not in _state:
        _state["letters"] = np.array([chr(c).isalpha() for c in range(0x110000)])
    isletter = _state["letters"][codes]
    ids = np.where(isletter, codes % (LETTERS - 1) + 1, 0).astype(np.int64)
    keep = np.ones(len(ids), dtype=bool)
    keep[1:] = (ids[1:] != 0) | (ids[:-1] != 0)
    return ids[keep]


def letter_vectors() -> np.ndarray:
    """(NGRAM, LETTERS, DIMENSIONS): letter vectors, rolled by their place in the n-gram."""
    if "vectors" not in _state:
        base = np.random.default_rng(11).choice(np.array([-1, 1], dtype=np.int8), (LETTERS, DIMENSIONS))
        _state["vectors"] = np.stack([np.roll(base, NGRAM - 1 - j, axis=1) for j in range(NGRAM)])
    return _state["vectors"]


def document_vector(text: str | None) -> np.ndarray | None:
    """The bundle of a text's n-grams; None without letters."""
    if not text:
        return None
    total = None
    vectors = letter_vectors()
    # Slices overlap by nothing: a boundary between slices counts as one between words.
    for lo in range(0, len(text), SLICE_CHARS):
        ids = letter_ids(text[lo : lo + SLICE_CHARS])
        if len(ids) < NGRAM or not ids.any():
            continue
        code = ids[: len(ids) - NGRAM + 1].copy()
        for j in range(1, NGRAM):
            code = code * LETTERS + ids[j : len(ids) - NGRAM + 1 + j]
        grams, counts = np.unique(code, return_counts=True)
        for at in range(0, len(grams), SLICE_GRAMS):
            some = grams[at : at + SLICE_GRAMS]
            bound = vectors[NGRAM - 1][some % LETTERS]
            for j in range(1, NGRAM):
                bound = bound * vectors[NGRAM - 1 - j][some // LETTERS**j % LETTERS]
            part = counts[at : at + SLICE_GRAMS].astype(np.float32) @ bound.astype(np.float32)
            total = part if total is None else total + part
    return total


def prototypes(docs: DataFrame) -> DataFrame:
    """(lang, v): the languages of ``docs(text, lang)`` and their unit prototypes, over all documents.

    Documents count alike (unit vectors); those without lang or letters add nothing. A task adds up
    its own documents, so one row per task and language is shuffled. An empty table has no language.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                v = document_vector(text.as_py())
                if v is not None and (n := np.linalg.norm(v)) > 0:
                    lang = lang.as_py()
                    if lang not in sums:
                        sums[lang] = np.zeros(DIMENSIONS)
                    sums[lang] += v / n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    bound_arrow_batches(docs.sparkSession)
    parts = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").mapInArrow(work, "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    size = "greatest(sqrt(aggregate(s, 0D, (a, y) -> a + y.x * y.x)), 1e-12D)"
    return stage(sums.select("lang", F.expr(f"transform(array({size}), n -> transform(s, y -> y.x / n))[0]").alias("v")), "prototypes")


def in_blocks(profiles: DataFrame, most: int = LANGUAGES_AT_ONCE) -> Iterator[tuple[list[str], np.ndarray]]:
    """Languages by name with their prototypes, at most so many at a time."""
    placed = prefix_sums(profiles, ["lang"], [], "_i") if profiles.count() > most else profiles.withColumn("_i", F.lit(0))
    first = 0
    while rows := placed.where((F.col("_i") >= first) & (F.col("_i") < first + most)).collect():
        rows.sort(key=lambda r: r["lang"])
        yield [r["lang"] for r in rows], np.array([r["v"] for r in rows], dtype=np.float64)
        first += most


def identify(docs: DataFrame, profiles: DataFrame, most: int = LANGUAGES_AT_ONCE) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (cosine with the language's prototype, at least 0).

    The language with the largest cosine wins, the first by name among equals. Null texts, texts
    without letters, and all texts if there is no language, are ``und`` with score 0. Columns named
    lang_pred or score, in any case, are replaced; all others stay; rows are independent; an empty
    table gives no rows.
    """
    bound_arrow_batches(docs.sparkSession)
    own = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    out = docs.select(*[F.col(f"`{c}`") for c in own], F.lit(None).cast("string").alias("lang_pred"), F.lit(-2.0).alias("score"))
    names, schema = out.columns, out.schema
    blocks = in_blocks(profiles, most)
    for languages, vectors in blocks:

        def work(batches: Iterator[pa.RecordBatch], languages: list[str] = languages, vectors: np.ndarray = vectors) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found, scores = batch.column(len(own)).to_pylist(), batch.column(len(own) + 1).to_pylist()
                for row, text in enumerate(batch.column(own.index("text"))):
                    v = document_vector(text.as_py())
                    if v is None:
                        continue
                    n = float(np.linalg.norm(v))
                    cosines = vectors @ v.astype(np.float64) / n if n else np.zeros(len(languages))
                    best = int(np.argmax(cosines))
                    if cosines[best] > scores[row]:
                        found[row], scores[row] = languages[best], float(cosines[best])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=names)

        out = out.mapInArrow(work, schema)
    return out.select(*[F.col(f"`{c}`") for c in own], F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose crc32 is not 1 modulo 3."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), prototypes(docs.where(~held))).drop("text")
