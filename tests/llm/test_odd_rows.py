"""Every operator and every pipeline stage on nulls, empty and long texts, ties, repeated rows, clashing
column names and empty tables: no row is lost, no column of the caller changes."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from perron.llm import ann, html, langid, minhash, mixing, packing, pii, quality, sharding, warc

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402

CLEAN = " ".join(f"{quality.COMMON_WORDS[i % 8]} word{i}" for i in range(120))
TEXTS = [(1, CLEAN, "en", "a"), (1, CLEAN, "en", "a"), (2, CLEAN, "en", "b"), (3, None, None, None), (4, "", "en", "a"), (5, " \t\n", "de", "b"), (None, "no id here", "en", "a"), (6, "x" * 200_000, "zz", "a"), (7, "w " * 60_000, "zz", None), (8, CLEAN + " me@a.de", "en", "a"), (9, "é 😀 İ", "xx", "b")]
#: Names that helpers or results have or had, in different cases.
CLASH = {"size": "int", "Shard": "string", "_copy": "int", "_times": "int", "_late_row": "int", "_h": "long", "_s": "string", "_full": "int", "key": "string", "node": "string", "spans": "string", "_spans": "int", "_pii_email": "int", "q_words": "string", "q_row": "int", "q_kept": "boolean", "slot": "int", "_slot": "int", "_taken": "long", "component_id": "int", "kept": "boolean", "text_hash": "long", "_hash": "long", "lang_pred": "string", "score": "double", "piece": "int", "v": "int", "ids": "int", "_key": "string"}


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(k % 2).cast(t).alias(c) if t not in ("string",) else F.lit(c).alias(c) for k, (c, t) in enumerate(CLASH.items())])


def rows(df, columns=None):
    return sorted(map(str, df.select(*[f"`{c}`" for c in columns or df.columns]).collect()))


def test_sharding(docs):
    found = sharding.shard_by_bytes(docs, 4).collect()
    assert len(found) == len(TEXTS) and sorted(r["size"] for r in found) == sorted(8 + len((t or "").encode()) for _, t, _, _ in TEXTS)
    for s in {r["shard"] for r in found}:
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sum(r["shard"] == s for r in found)))
    # Contiguous by id: no shard begins before the one below it ends.
    ends = [(min(r["doc_id"] or 0 for r in found if r["shard"] == s), max(r["doc_id"] or 0 for r in found if r["shard"] == s)) for s in sorted({r["shard"] for r in found})]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    # Balance, as far as whole documents allow.
    even = sharding.shard_by_bytes(docs.sparkSession.range(1000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("text")), 8)
    sizes = [r["b"] for r in even.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2 * 14


def own(df, added):
    return [c for c in df.columns if c.lower() not in added]


@pytest.mark.parametrize(
    "run, added",
    [
        (lambda d: mixing.mix(d), ("_size", "_source_size", "_target", "_taken", "_slot")),
        (lambda d: pii.find_pii(d), ("spans",)),
        (lambda d: pii.redact(d).drop("text"), ("text",)),
        (lambda d: quality.judge(d), quality.ADDED),
        (lambda d: langid.identify(d, langid.prototypes(d)), ("lang_pred", "score")),
    ],
    ids=["mix", "find_pii", "redact", "judge", "identify"],
)
def test_columns_stay(docs, run, added):
    """Operators that add columns keep every row and every other column as it was."""
    out = run(docs)
    keep = own(docs, added)
    assert [c for c in out.columns if c in keep] == keep and rows(out, keep) == rows(docs, keep)
    assert run(docs.limit(0)).count() == 0


def test_narrow_results(docs):
    assert minhash.near_duplicates(docs).count() == packing.pack(docs, length=1 << 20).count() == len(TEXTS)
    assert minhash.near_duplicates(docs.limit(0)).count() == packing.pack(docs.limit(0)).count() == sharding.shard_by_bytes(docs.limit(0), 3).count() == 0
    verdict = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert verdict[2, 236] == (1, False) and verdict[8, 237] == (1, False) and verdict[3, 0] == (3, True) and verdict[None, 1] == (None, True)


def test_repeated_ids(spark):
    """A repeated id with another text has a verdict of its own."""
    t, u = CLEAN, " ".join(f"other{i}" for i in range(80))
    df = spark.createDataFrame([(3, t), (5, t), (5, u), (5, u), (None, t), (None, t)], "doc_id long, text string")
    assert sorted(map(str, minhash.deduplicated(df).collect())) == sorted(map(str, df.limit(0).collect() + spark.createDataFrame([(3, t), (5, u), (None, t), (None, t)], df.schema).collect()))


def test_pages(spark):
    page = "<html><body><article><h1>T</h1><p>Some words that say something of use here.</p></article></body></html>"
    base = [(1, "u", page), (1, "u", page), (2, None, None), (3, "", ""), (None, "n", page)]
    df = spark.createDataFrame([(*b, 1, "mine", "x") for b in base], "page_id long, url string, html string, warc int, payload string, record_type string")
    records = warc.archived_records(warc.archive_pages(df)).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["payload_bytes"]) for r in records) == [(0, "response", len(page)), (1, "response", len(page)), (1, "response", len(page)), (2, "response", 0), (3, "response", 0)]
    assert warc.archived_records(warc.archive_pages(df.limit(0))).count() == 0
    assert html.extract_text(df).columns == ["page_id", "url", "warc", "payload", "record_type", "text", "n_chars"] and html.extract_text(df).count() == 5


def test_vectors(spark):
    """Fewer candidates than asked for, ties, repeated rows, vectors that take no part, clashing names."""
    v = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [float("inf"), 1.0]), (7, [1.0, None]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*x, 5, "x", 0.5) for x in v], "vec_id long, embedding array<double>, rank int, id string, score double")
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, df.where("vec_id < 5"), 5).collect())
    assert found == [(1, 1, 2, 1.0), (1, 2, 3, 0.0), (2, 1, 1, 1.0), (2, 2, 3, 0.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0)]


def test_pipeline_stages(spark, docs):
    """Order and names of the stages; each keeps the columns of its input and all that its rules keep."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert set(rows(out, [c for c in docs.columns if c != "text"])) <= set(rows(docs, [c for c in docs.columns if c != "text"])), name
        assert stage(spark, docs.limit(0), "").count() == 0, name
    assert sorted(r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, "").collect()) == [1, 1, 2, 8]
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == len(TEXTS) - 3
    assert corpus_pipeline.personal_data(spark, docs, "").count() == len(TEXTS)
    assert {r["doc_id"] for r in corpus_pipeline.packing(spark, docs, "").collect()} == {i for i, *_ in TEXTS}


def test_pipeline(spark, docs, tmp_path):
    """The whole pipeline on odd rows, and on a given table stage by stage against plain readings."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1}
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0

    folder = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"] for r in quality.judge(given).where("q_kept").collect()}
    good = corpus_pipeline.quality_rules(spark, given, folder)
    assert {r["doc_id"] for r in good.collect()} == kept
    import re

    sets = {}
    for r in good.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    one = {i for i in ids if root(i) == i}
    assert {r["doc_id"] for r in minhash.deduplicated(good).collect()} == one
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} <= one
