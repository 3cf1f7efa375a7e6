"""DuckDB SQL for the operators that SQL can express, over the same whole tables.

Each text states the contract in its own way (sets joined on single shingles, a table-driven CRC,
windows as rows), so that an agreement of the two forms is evidence for both.
"""

from __future__ import annotations

from perron.llm.mixing import BLOCK, CIRCLE, LATE, SLOTS, STEP
from perron.llm.quality import (
    COMMON_WORDS,
    MAX_CLASS_DISTANCE,
    MAX_REPEAT_PERCENT,
    MAX_WORD_DISTANCE,
    MIN_CLASS_CHARS,
    MIN_LISTED_SHARE,
    MIN_REFERENCE_CHARS,
    MIN_WORD_WORDS,
    MIN_WORDS,
    SYMBOLS,
)
from perron.llm.warc import MIN_REVISIT_BYTES

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CRC_POLYNOMIAL = 0xEDB88320  # fixed value: the reflected CRC-32 polynomial


def sharding(shards: int = 24, overhead: int = 8) -> str:
    """Equal byte targets over documents in doc_id order; a document is where its middle byte is."""
    return f"""
    WITH RECURSIVE bits AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
        UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {CRC_POLYNOMIAL}::BIGINT) ELSE c >> 1 END FROM bits WHERE k < 8),
    crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
    d AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, '')))::BIGINT + {overhead} AS size FROM documents),
    line AS (SELECT doc_id, size, text, sum(size) OVER (ORDER BY doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM d),
    cut AS (SELECT *, least({shards - 1}, ((before * 2 + size) * {shards}) // (total * 2))::INTEGER AS shard FROM line)
    SELECT doc_id, size,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32,
        'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, NULL::INTEGER AS grown_shard
    FROM cut, crc"""


def mixing(pattern: tuple[int, ...] = (1, 2, 3), most: int = 3) -> str:
    """Targets by water-filling, golden-ratio slots ranked per source, blocks of each source's stream by interval overlap."""
    weights = "[" + ", ".join(map(str, pattern)) + "]"
    return f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')), 1, 15))::BIGINT AS key FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM d GROUP BY source),
    c AS (SELECT *, {weights}[rank % {len(pattern)} + 1]::BIGINT AS weight, source_size * {most} AS cap, (source_size * {most})::DOUBLE / {weights}[rank % {len(pattern)} + 1] AS ratio FROM s),
    l AS (SELECT *, (sum(source_size) OVER () - (sum(cap) OVER w - cap))::DOUBLE / (sum(weight) OVER () - (sum(weight) OVER w - weight)) AS level FROM c WINDOW w AS (ORDER BY ratio, rank ROWS UNBOUNDED PRECEDING)),
    t AS MATERIALIZED (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT arg_min(level, (ratio, rank)) FROM l WHERE level <= ratio), 0.0) * weight) AS target,
        row_number() OVER (ORDER BY source IS NULL, source) AS i FROM l),
    n AS MATERIALIZED (SELECT greatest(1, least({BLOCK}, (sum(source_size) + {SLOTS - 1}) // {SLOTS}))::BIGINT AS len, sum(source_size)::BIGINT // greatest(1, least({BLOCK}, (sum(source_size) + {SLOTS - 1}) // {SLOTS}))::BIGINT AS slots FROM t),
    st AS (SELECT source, floor((after - part)::DOUBLE / total * {CIRCLE})::BIGINT AS lo, floor(after::DOUBLE / total * {CIRCLE})::BIGINT AS hi
        FROM (SELECT source, ceil(target)::BIGINT AS part, (sum(ceil(target)) OVER (ORDER BY i))::BIGINT AS after, (sum(ceil(target)) OVER ())::BIGINT AS total FROM t) WHERE total > 0),
    p AS (SELECT j AS slot, (j * {STEP}) % {CIRCLE} AS u FROM n, range(slots) r(j)),
    r AS MATERIALIZED (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k FROM p JOIN st ON u >= lo AND u < hi),
    w AS (SELECT source, source_size, least(round(target)::BIGINT, source_size * {most}) AS want FROM t),
    b AS MATERIALIZED (SELECT w.source, e.k, coalesce(slot, {LATE} + e.k) AS slot, e.k * len AS lo, least((e.k + 1) * len, want) AS hi
        FROM w, n, unnest(range((want + len - 1) // len)) e(k) LEFT JOIN r ON r.source IS NOT DISTINCT FROM w.source AND r.k = e.k),
    g AS (SELECT rid, source, size, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, rid ROWS UNBOUNDED PRECEDING) - size AS pos FROM d),
    o AS (SELECT rid, g.source, lap * source_size + pos AS lo, least(lap * source_size + pos + size, want) AS hi
        FROM g JOIN w ON w.source IS NOT DISTINCT FROM g.source, unnest(range((want + source_size - 1) // greatest(source_size, 1))) x(lap) WHERE size > 0),
    m AS (SELECT rid, sum(least(o.hi, b.hi) - greatest(o.lo, b.lo))::BIGINT AS taken, min(slot) AS first_slot
        FROM (SELECT *, unnest(range((lo // len)::BIGINT, ((hi - 1) // len + 1)::BIGINT)) AS k FROM o, n WHERE lo < hi) o JOIN b ON b.source IS NOT DISTINCT FROM o.source AND b.k = o.k GROUP BY rid)
    SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot, d.source FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source LEFT JOIN m USING (rid)"""


def archives() -> str:
    """What reading the archives back must say about every page."""
    return f"""
    WITH k AS (SELECT page_id, coalesce(nullif(url, ''), '-') AS url, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT payload_digest, min(page_id) AS least_id FROM k WHERE payload_bytes >= {MIN_REVISIT_BYTES} GROUP BY 1)
    SELECT page_id, url, payload_bytes, k.payload_digest, CASE WHEN least_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN least_id <> page_id THEN least_id END AS refers_to, '2026-01-01T00:00:00Z' AS warc_date
    FROM k LEFT JOIN f ON k.payload_digest = f.payload_digest AND payload_bytes >= {MIN_REVISIT_BYTES}"""


def near_duplicates(percent: int = 80) -> str:
    """Two-word shingle sets, all linked pairs by an inverted index, components by recursion."""
    return f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
    s AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END)) AS sh FROM w),
    n AS MATERIALIZED (SELECT sh, min(doc_id) AS node FROM s WHERE len(sh) > 0 GROUP BY sh),
    e AS MATERIALIZED (SELECT node, len(sh) AS k, unnest(sh) AS g FROM n),
    l AS (SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.g = b.g AND a.node < b.node WHERE 100 * least(a.k, b.k) >= {percent} * greatest(a.k, b.k)
        GROUP BY a.node, b.node, a.k, b.k HAVING 100 * count(*) >= {percent} * (a.k + b.k - count(*))),
    u AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    c AS (SELECT node, node AS reach FROM n UNION SELECT c.node, u.b FROM c JOIN u ON u.a = c.reach),
    m AS (SELECT node, min(reach) AS component FROM c GROUP BY 1)
    SELECT doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
    FROM s LEFT JOIN n ON s.sh = n.sh LEFT JOIN m USING (node)"""


def _distance(histogram: str, reference: str) -> str:
    half = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
    x, q = f"({histogram}[i] / greatest(list_sum({histogram}), 1.0))", f"{reference}[i]"
    return f"sqrt(greatest(0.0, list_sum(list_transform(range(1, len({histogram}) + 1), lambda i: {half.format(x, q)} + {half.format(q, x)})) / 2))"


def quality() -> str:
    """The counts, and the verdicts by the histograms of each language."""
    common = ", ".join(f"len(list_filter(ws, lambda w: w = '{w}' OR w = '{w.capitalize()}'))::DOUBLE" for w in COMMON_WORDS)
    count = lambda p: f"len(regexp_extract_all(text, '{p}'))::BIGINT"
    n_classes, n_words = 7, len(COMMON_WORDS) + 1
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{i + 1}])" for i in range(n)) + "]"
    share = lambda c: f"list_transform({c}, lambda x: x / greatest(list_sum({c}), 1.0))"
    return f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
    win AS (SELECT rid, unnest(list_transform(range(1, len(ws) - 1), lambda i: {{'p': i, 'w': ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]}})) AS x FROM d WHERE len(ws) > 3),
    twice AS (SELECT rid, x.p AS p FROM win QUALIFY count(*) OVER (PARTITION BY rid, x.w) > 1),
    rep AS (SELECT rid, count(DISTINCT p + o) AS n FROM twice, range(3) t(o) GROUP BY rid),
    b AS (SELECT rid, doc_id, lang, ws, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, {count(SYMBOLS)} AS n_symbols, length(text)::BIGINT AS chars,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ln, {count('[A-Z]')} AS upper, {count('[0-9]')} AS digit,
        {count('''[.,;:!?''"()\\[\\]{}/\\\\=+~^_@`-]''')} AS punct, {count('[^\\x00-\\x7F]')} AS nonascii FROM d),
    h AS MATERIALIZED (SELECT rid, doc_id, lang, n_words, word_chars, n_symbols, chars, (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        [(chars - word_chars)::DOUBLE, upper, digit, n_symbols, punct, nonascii, word_chars - upper - digit - n_symbols - punct - nonascii] AS classes,
        list_append(c, len(ws) - list_sum(c)) AS common FROM (SELECT *, [{common}] AS c FROM b) LEFT JOIN rep USING (rid)),
    total AS (SELECT lang, {sums('classes', n_classes)} AS a, {sums('common', n_words)} AS b FROM h WHERE lang IS NOT NULL GROUP BY lang HAVING sum(chars) >= {MIN_REFERENCE_CHARS}),
    ref AS (SELECT lang, {share('a')} AS ra, CASE WHEN b[{n_words}] <= {1 - MIN_LISTED_SHARE} * list_sum(b) THEN {share('b')} END AS rb FROM total),
    far AS (SELECT rid, CASE WHEN ra IS NOT NULL THEN {_distance('classes', 'ra')} END AS class_distance, CASE WHEN rb IS NOT NULL THEN {_distance('common', 'rb')} END AS word_distance FROM h LEFT JOIN ref USING (lang)),
    v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM h JOIN far USING (rid))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND NOT (chars >= {MIN_CLASS_CHARS} AND coalesce(class_distance, 0) > {MAX_CLASS_DISTANCE}) AND NOT (n_words >= {MIN_WORD_WORDS} AND coalesce(word_distance, 0) > {MAX_WORD_DISTANCE}) AS kept,
        round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance FROM v"""
