"""Personal data against a plain reading of the contract, and the cost of texts with many matches."""

import hashlib
import random
import re
import time

from perron.llm import pii

KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 if d > 4 else 2 * d
    return total % 10 == 0


def base(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in KINDS:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def texts(n: int) -> list[str]:
    rng = random.Random(8)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "256.1.1.1", "999", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 901820-0", "+1", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "123-45-6789", "ssn", "é", "😀", " ", "-", ".", "0", "12", "tel", "iban", "\n"]
    return ["".join(rng.choice(parts) + rng.choice(("", " ", "", "-")) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_base_spans(spark):
    """Every base span of random texts, and redaction by a plain reading."""
    rows = list(enumerate([*texts(1500), None, ""]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find_pii(df).collect()}
    assert {i: [s for s in v if s[0] in pii.BASE] for i, v in found.items()} == {i: base(t or "") for i, t in rows}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    for i, t in rows:
        want, pos = "", 0
        for kind, a, b in sorted(found[i], key=lambda s: (s[1], -s[2])):
            if a >= pos:
                want += (t or "")[pos:a] + f"<{kind.upper()}>"
            pos = max(pos, b)
        assert clean[i] == (None if t is None else want + t[pos:]), i


def test_whole_table(spark):
    """op3 over a whole given table: counts, hash and span strings."""
    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = pii.op3_pii(spark, folder).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        spans = base(docs[r["doc_id"]])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in spans) for k in pii.BASE]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in pii.BASE] == (text.split(",") if text else [])


def test_added_kinds(spark):
    said = ["DE89 3704 0044 0532 0130 00 BIC COBADEFF", "DE89370400440532013000 NOW", "DE89 3704 0044 0532 0130 00 2024-01-01", "DE89 3704 0044 0532 0130 01", "xDE89370400440532013000", "DE89370400440532013000x", "social security 123-45-6789, 321-54-9876", "123-45-6789", "NO93 8601 1117 947 GB82 WEST 1234 5698 7654 32", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962", "password: correcthorsebatterystaple"]
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], r["text"][s["start"] : s["end"]]) for s in r["spans"] if s["kind"] not in pii.BASE] for r in pii.find_pii(df).collect()}
    de = "DE89 3704 0044 0532 0130 00"
    assert got == {0: [("iban", de)], 1: [("iban", "DE89370400440532013000")], 2: [("iban", de)], 3: [], 4: [], 5: [], 6: [("ssn", "123-45-6789"), ("ssn", "321-54-9876")], 7: [], 8: [("iban", "NO93 8601 1117 947"), ("iban", "GB82 WEST 1234 5698 7654 32")], 9: [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")], 10: [], 11: []}


def test_many_matches(spark):
    """A hundred thousand addresses in one text."""
    text = " ".join(f"user{i}@mail{i % 7}.example.org" for i in range(100_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    spans = pii.find_pii(df).first()["spans"]
    assert len(spans) == 100_000 and all(text[s["start"] : s["end"]] == f"user{i}@mail{i % 7}.example.org" for i, s in enumerate(spans))
    assert pii.redact(df).first()["text"] == " ".join(["<EMAIL>"] * 100_000)
    assert time.time() - began < 40


def test_clashing_names(spark):
    """Columns that have the names of helpers or results, null and repeated rows, an empty table."""
    df = spark.createDataFrame([(1, "a@b.de", "own", 1, 2), (1, "a@b.de", "own", 1, 2), (None, None, None, None, None)], "doc_id long, text string, spans string, _spans int, _pii_email int")
    out = pii.redact(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.where("doc_id = 1").collect())) == [(1, "<EMAIL>", "own", 1, 2)] * 2 and out.count() == 3
    assert pii.find_pii(df).columns == ["doc_id", "text", "_spans", "_pii_email", "spans"]
    assert pii.redact(df.limit(0)).count() == 0 and pii.find_pii(df.limit(0)).count() == 0
