"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts a score.

Everything is a Spark SQL expression. A kind's matches come from ``regexp_extract_all`` and the text
between them from ``split`` with the same pattern; their lengths give the offsets. Patterns use
possessive repetition and start only where a match can start, so a scan is linear even over runs of
many thousand digits or letters. Running sums over matches are made block by block, so that a text
with a hundred thousand matches costs little more than in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perron.plans.names import fresh

# The countries of the IBAN registry and the lengths of their numbers.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 "
    "HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 "
    "QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()


def _iban() -> str:
    """The countries of each length, then check digits and as many more characters as the length says."""
    lengths = sorted({int(x[2:]) for x in IBAN_LENGTHS})
    each = [f"(?:{'|'.join(x[:2] for x in IBAN_LENGTHS if int(x[2:]) == n)})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n in lengths]
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(each)})(?![A-Za-z0-9])"


LOCAL = "[A-Za-z0-9._%+-]"
#: Kind -> (pattern, cheap test (a character or a pattern that every match holds), score without context, words that raise the score when near, threshold).
#: The first four are the base kinds; their spans stay whatever the score is (threshold 0).
KINDS: dict[str, tuple[str, str, float, str, float]] = {
    "email": (rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write|kontakt|courriel|correo", 0.0),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, "ip|address|host|server|adresse", 0.0),
    "card": (r"[0-9](?:[\x20-]?[0-9]){12,}+", "", 0.7, "card|visa|credit|karte|carte|tarjeta", 0.0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|tel|call|mobile|fax", 0.0),
    "iban": (_iban(), "[A-Z]{2}[0-9]{2}", 0.7, "iban|account|bank|konto|compte|cuenta", 0.6),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, "ssn|social|security", 0.5),
    "secret": (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}", "[0-9]", 0.3, "token|secret|passw|api.?key|credential|bearer|auth|clave|passe", 0.5),
}
BASE = ("email", "ip", "card", "phone")
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.25


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    """Whether a string of digits passes Luhn's check."""
    v = f"cast(substr({d}, length({d}) + 1 - i, 1) as int)"
    return f"aggregate(sequence(1, length({d})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN {v} WHEN {v} > 4 THEN 2 * {v} - 9 ELSE 2 * {v} END) % 10 = 0"


def _mod97(m: str) -> str:
    """Whether an IBAN's check digits hold: moved to the end, letters as 10..35, remainder 1."""
    s = f"regexp_replace({m}, ' ', '')"
    turned = f"concat(substr({s}, 5), substr({s}, 1, 4))"
    c = f"ascii(substr({turned}, i, 1))"
    return f"aggregate(sequence(1, length({s})), 0, (a, i) -> CASE WHEN {c} < 58 THEN (a * 10 + {c} - 48) % 97 ELSE (a * 100 + {c} - 55) % 97 END) = 1"


#: SQL condition of a match ``x.m``.
VALID = {
    "email": "true",
    "ip": "forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND cast(concat('0', right(ltrim('0', p), 3)) as int) <= 255)",
    "card": f"length({_digits('x.m')}) BETWEEN 13 AND 19 AND {_luhn(_digits('x.m'))}",
    "phone": f"length({_digits('x.m')}) BETWEEN 9 AND 15",
    "iban": _mod97("x.m"),
    "secret": "x.m rlike '[0-9]' AND x.m rlike '[A-Za-z]'",
    "ssn": "substr(x.m, 1, 3) NOT IN ('000', '666') AND substr(x.m, 1, 1) <> '9'",
}
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
#: Matches whose running sums are made in one go: appending copies what is there.
BLOCK = 256


def _literal(s: str) -> str:
    return "r'" + s.replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` in which ``name`` stands for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _blocks(array: str) -> str:
    return f"transform(sequence(0, (size({array}) - 1) div {BLOCK}), b -> slice({array}, b * {BLOCK} + 1, {BLOCK}))"


def kind_spans(kind: str, text: str) -> Column:
    """Spans of one kind in the SQL expression ``text``, in order of their start (code points, end
    exclusive), after validation and scoring."""
    pattern, cheap, score, words, least = KINDS[kind]
    pat = _literal(pattern)
    # The text before a match, as far as it counts: the piece before it, and earlier matches with theirs.
    tail = lambda k: f"coalesce(right(get(s.p, i - {k}), {CONTEXT_CHARS}), '')"
    near = ", ".join(f"{tail(k)}, coalesce(get(s.m, i - {k}), '')" for k in (3, 2, 1)) + f", {tail(0)}"
    rated = f"cast(if(lower(x.near) rlike {_literal('(?:' + words + ')')}, {min(1.0, score + CONTEXT_BONUS)}, {score}) as double)"
    matches = f"transform(s.m, (m, i) -> named_struct('m', m, 'n', length(m), 'skip', length(get(s.p, i)), 'near', right(concat({near}), {CONTEXT_CHARS})))"
    bases = "aggregate(bl, array(0), (a, c) -> concat(a, array(cast(element_at(a, -1) + aggregate(c, 0, (t, x) -> cast(t + x.skip + x.n as int)) as int))))"
    placed = "array<struct<x:struct<m:string,n:int,skip:int,near:string>,start:int>>"
    starts = f"""flatten(transform(bl, (c, j) -> aggregate(c, named_struct('pos', base[j], 'out', cast(array() as {placed})),
        (a, x) -> named_struct('pos', cast(a.pos + x.skip + x.n as int), 'out', cast(concat(a.out, array(named_struct('x', x, 'start', a.pos + x.skip))) as {placed})), a -> a.out)))"""
    keep = f"filter({starts}, y -> {_let('x', 'y.x', VALID[kind] + (f' AND {rated} >= {least}' if least else ''))})"
    spans = f"transform({keep}, y -> {_let('x', 'y.x', f"named_struct('kind', '{kind}', 'start', y.start, 'end', y.start + x.n, 'score', {rated})")})"
    found = _let("s", f"named_struct('m', regexp_extract_all({text}, {pat}, 0), 'p', split({text}, {pat}, -1))", _let("ms", matches, _let("bl", _blocks("ms"), _let("base", bases, spans))))
    quick = f"contains({text}, '{cheap}')" if len(cheap) == 1 else f"{text} rlike {_literal(cheap)}"
    test = (f"{quick} AND " if cheap else "") + f"{text} rlike {pat}"
    return F.expr(f"coalesce(CASE WHEN {test} THEN cast({found} as {SPANS}) END, cast(array() as {SPANS}))")


def find_pii(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` with ``spans``: every confirmed span of its whole text.

    Spans are listed by kind in the order of ``KINDS``, then by start; each has kind, start, end
    (code points, end exclusive) and score. Base kinds keep every span that passes its check; the
    others need a checksum or context words as well. Null text has no spans; an existing column of
    that name is replaced; rows are independent, so repeats and other columns do not matter; an empty
    table gives no rows.
    """
    own = [c for c in docs.columns if c.lower() != name.lower()]
    return docs.select(*[F.col(f"`{c}`") for c in own], F.concat(*[kind_spans(k, f"`{text}`") for k in KINDS]).alias(name))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets.

    Where spans of different kinds overlap, all that they cover is replaced by the kind of the one
    that starts first (then the longest). Texts without spans, null texts and all other columns,
    whatever their names, stay as they are; an empty table gives no rows.
    """
    (spans,) = fresh(docs.columns, "spans")
    ordered = f"array_sort(transform(`{spans}`, s -> named_struct('start', s.start, 'back', -s.end, 'end', s.end, 'kind', s.kind)))"
    covers = "array<struct<start:int,end:int,kind:string>>"
    # Spans in sequence, with the furthest end before each block, are joined into covers of the text.
    reach = "aggregate(bl, array(0), (a, c) -> concat(a, array(greatest(element_at(a, -1), coalesce(array_max(transform(c, x -> x.end)), 0)))))"
    covered = f"""flatten(transform(bl, (c, j) -> aggregate(c, named_struct('pos', far[j], 'out', cast(array() as {covers})),
        (a, x) -> named_struct('pos', greatest(a.pos, x.end), 'out', cast(concat(a.out, array(named_struct('start', if(x.start >= a.pos, x.start, -1), 'end', greatest(a.pos, x.end), 'kind', x.kind))) as {covers})),
        a -> a.out)))"""
    # A cover that goes on from the one before it has no start; it only reaches further.
    block = f"""transform(sequence(0, (size(cs) - 1) div {BLOCK}), b -> {_let('from', f'coalesce(get(cs, b * {BLOCK} - 1).end, 0)', _let('part', f'slice(cs, b * {BLOCK} + 1, {BLOCK})', _let('piece', 'substring(`text`, from + 1, element_at(part, -1).end - from)',
        "array_join(transform(part, (x, i) -> if(x.start < 0, '', concat(substring(piece, coalesce(get(part, i - 1).end, from) - from + 1, x.start - coalesce(get(part, i - 1).end, from)), '<', upper(x.kind), '>'))), '')")))})"""
    whole = f"concat(array_join({block}, ''), substring(`text`, element_at(cs, -1).end + 1))"
    cut = _let("os", ordered, _let("bl", _blocks("os"), _let("far", reach, _let("cs", covered, whole))))
    replaced = F.when(F.size(F.col(spans)) > 0, F.expr(cut)).otherwise(F.col("text")).alias("text")
    return find_pii(docs, name=spans).select(*[replaced if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, cast(s.start as string), cast(s.end as string))), ',')"
    base = "filter(spans, s -> s.kind IN ('email', 'ip', 'card', 'phone'))"
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE],
        F.sha2(F.expr(joined.format(base)), 256).alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"),
    )
