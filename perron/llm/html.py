"""Main text of web pages with a recurrent block labeller.

A page is parsed into its sequence of leaf blocks (runs of text between block-level tags). Each
block is described by its tag path, its hashed words and a few measures; a bidirectional LSTM in
numpy reads the whole sequence and says of every block whether it belongs to the main text, so a
block is judged with all of the page around it.

The tag path is read from the leaf: the tokens (tag, and known words of class, id and role) of the
innermost element that has any, those of the next one, and the set of all further ones; each of
the three is pooled by maximum. Elements without a known token (plain or oddly named wrappers) are
not in it, so a block looks the same however deep it lies, and no ancestor is cut.

The weights in ``html_weights.npz`` are made by ``html_train`` from pages that a generator composes
with known labels (fixed seed).
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perron.llm.textkernel import chunks, word_hashes
from perron.session import bound_arrow_batches

# HTML element names by how the parser treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template title svg iframe object math canvas audio video".split())
RAW = frozenset("script style title textarea iframe noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ITEMS = frozenset("li dt dd tr td th option".split())
LISTS = frozenset("ul ol dl table select".split())
#: Elements that say nothing of their text.
PLAIN = INLINE | frozenset("html head body div tbody tr center".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)>""")
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")

WORD_BUCKETS, MEASURES = 1024, 8
EMBEDDED, HIDDEN = 24, 20
BATCH_PAGES = 128
THRESHOLD = 0.5
#: Known words of this many letters are found at the ends of longer ones too ("commentlist").
STEM = 5
WEIGHTS = Path(__file__).with_name("html_weights.npz")


@dataclass
class Block:
    """A run of text between block-level tags, and what the labeller sees of it."""

    path: tuple[int, int, int]
    box: int  # the element around it
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


class Vocabulary:
    """The tokens of tag paths, and the bit set of a tag."""

    def __init__(self, tokens: list[str]):
        self.tokens = tokens
        self.place = {t: i for i, t in enumerate(tokens)}
        self.stems = [t[1:] for t in tokens if t[0] == "." and len(t) > STEM]
        self.cache: dict[tuple[str, str], int] = {}

    def words(self, named: str) -> list[str]:
        """The words of class, id and role; of unknown ones the known word at their start or end."""
        out = []
        for w in WORD.findall(CAMEL.sub(r"\1 \2", named).lower()):
            if "." + w in self.place or len(w) <= STEM:
                out.append(w)
            else:
                out += sorted((s for s in self.stems if w.startswith(s) or w.endswith(s)), key=len)[-1:]
        return out

    def bits(self, name: str, attributes: str) -> int:
        """The bit set of a tag's known tokens; every word counts."""
        named = " ".join(b or c or d for _, b, c, d in NAMED.findall(attributes)) if attributes and name not in ("html", "body") else ""
        key = (name, named)
        if key not in self.cache:
            if len(self.cache) > 20_000:
                self.cache.clear()
            tokens = [] if name in PLAIN else [name]
            tokens += ["." + w for w in self.words(named)]
            self.cache[key] = sum(1 << i for i in {self.place[t] for t in tokens if t in self.place})
        return self.cache[key]


@lru_cache(maxsize=64)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I)


def parse_blocks(page: str, vocabulary: Vocabulary) -> list[Block]:
    """The blocks with text of a page, in page order.

    Broken markup is read as far as it goes, in time linear in the page: quotes count after an equals
    sign only, an end tag without a start is passed over, a tag that never ends is dropped with what
    follows (as browsers do), an unclosed script or comment hides the rest.
    """
    blocks: list[Block] = []
    # Of every open element: its name, the nearest block-level element at or above, the path, its number.
    names: list[str] = []
    nearest: list[int] = []
    paths: list[tuple[int, int, int]] = []
    numbers: list[int] = []
    open_: Counter[str] = Counter()
    last: dict[str, list[int]] = {}
    current: Block | None = None
    linked = False
    dropped = serial = at = 0
    n = len(page)

    def add(text: str) -> None:
        nonlocal current
        if dropped or not text:
            return
        if current is None:
            if text.isspace():
                return
            top = nearest[-1] if nearest else -1
            current = Block(paths[-1] if paths else (0, 0, 0), numbers[top - 1] if top > 0 else -1)
            blocks.append(current)
        text = html.unescape(text) if "&" in text else text
        current.parts.append(text)
        if linked:
            current.linked += len(text)

    def pop(index: int) -> None:
        nonlocal linked, dropped
        for name in names[index:]:
            open_[name] -= 1
            last[name].pop()
            linked = linked and name != "a"
            dropped -= name in DROPPED
        del names[index:], nearest[index:], paths[index:], numbers[index:]

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?"):
            if page.startswith("<!--", lt):
                a, b = page.find("-->", lt + 2), page.find("--!>", lt + 4)
                at = n if a < 0 and b < 0 else a + 3 if b < 0 or 0 <= a < b else b + 4
            elif page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        m = TAG.match(page, lt)
        if m is None:
            if after.isascii() and after.isalpha() or after == "/" and page[lt + 2 : lt + 3].isalpha():
                break  # no tag ends any more
            add("<")
            at = lt + 1
            continue
        at = m.end()
        closing, name, attributes = m.groups()
        name = name.lower()
        if name not in INLINE and name != "br":
            current = None
        if closing:
            if open_[name]:
                pop(last[name][-1])
            continue
        if name == "br":
            add(" ")
            continue
        if name == "body" and open_["head"]:  # whatever of the head is still open ends here
            pop(last["head"][-1])
        if name in CLOSES_P:
            if nearest and nearest[-1] >= 0 and names[nearest[-1]] == "p":
                pop(nearest[-1])
        elif name in ITEMS and open_[name]:
            if last[name][-1] > max((last[x][-1] for x in LISTS if open_[x]), default=-1):
                pop(last[name][-1])
        if name in RAW:
            end = _end_of(name).search(page, at)
            if name not in DROPPED:
                up = paths[-1] if paths else (0, 0, 0)
                bits = vocabulary.bits(name, attributes)
                paths.append((bits, up[0], up[1] | up[2]) if bits else up)
                add(page[at : end.start() if end else n])
                paths.pop()
                current = None
            at = end.end() if end else n
            continue
        if name in VOID or attributes.endswith("/") and name not in CLOSES_P:
            continue
        up = paths[-1] if paths else (0, 0, 0)
        bits = vocabulary.bits(name, attributes)
        last.setdefault(name, []).append(len(names))
        nearest.append(len(names) if name not in INLINE else nearest[-1] if nearest else -1)
        names.append(name)
        paths.append((bits, up[0], up[1] | up[2]) if bits else up)
        serial += 1
        numbers.append(serial)
        open_[name] += 1
        linked = linked or name == "a"
        dropped += name in DROPPED
    for b in blocks:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in blocks if b.text]


def measures(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), MEASURES), dtype=np.float32)
    boxes: Counter[int] = Counter()
    for b in blocks:
        boxes[b.box] += len(b.text)
    total = sum(boxes.values())
    for i, b in enumerate(blocks):
        t = b.text
        n = len(t)
        out[i] = (
            np.log1p(n) / 6,
            min(1.0, b.linked / n),
            min(1.0, 20 * sum(map(t.count, ".,;:!?")) / n),
            t[-1] in ".!?:\"'",
            i / len(blocks),
            min(1.0, len(blocks) / 40),
            boxes[b.box] / total,
            min(1.0, total / 4000),
        )
    return out


@dataclass
class Page:
    """What the labeller sees of a page: paths, word buckets with their offsets by block, measures."""

    paths: list[tuple[int, int, int]]
    words: np.ndarray
    offsets: np.ndarray
    measured: np.ndarray


def features(blocks: list[Block]) -> Page:
    """Every word of a block counts."""
    buckets, counts = [], []
    for start, end, data, offsets in chunks(pa.array([b.text for b in blocks], pa.large_string())):
        h, row = word_hashes(data, offsets)
        buckets.append((h % np.uint64(WORD_BUCKETS)).astype(np.int32))
        counts.append(np.bincount(row, minlength=end - start))
    counts_ = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return Page([b.path for b in blocks], np.concatenate(buckets) if buckets else np.zeros(0, np.int32), np.concatenate(([0], np.cumsum(counts_))), measures(blocks))


# --- the network ---------------------------------------------------------------------------------


def new_weights(seed: int, tokens: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    scaled = lambda *shape, by=1.0: (rng.normal(size=shape) * by).astype(np.float32)
    w = {f"path{k}": scaled(tokens + 1, EMBEDDED, by=0.2) for k in range(3)}  # the last row: no token
    w |= {"word": scaled(WORD_BUCKETS, EMBEDDED, by=0.05), "measure": scaled(MEASURES, EMBEDDED, by=0.5), "bias": scaled(EMBEDDED, by=0.0)}
    for d in ("f", "b"):
        w[f"x{d}"] = scaled(EMBEDDED, 4 * HIDDEN, by=EMBEDDED**-0.5)
        w[f"h{d}"] = scaled(HIDDEN, 4 * HIDDEN, by=HIDDEN**-0.5)
        w[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
    w["out"], w["out_bias"] = scaled(2 * HIDDEN, by=0.2), np.zeros(1, np.float32)
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def token_rows(sets: list[int], none: int) -> np.ndarray:
    """Rows of token numbers for bit sets, filled up by repeating the first; ``none`` for the empty set."""
    lists = [[i for i in range(s.bit_length()) if s >> i & 1] or [none] for s in sets]
    wide = max(map(len, lists))
    return np.array([x + x[:1] * (wide - len(x)) for x in lists])


def pooled(table: np.ndarray, sets: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The maxima of a table's rows over each bit set; (values, which set each is, token rows, places of the maxima)."""
    number: dict[int, int] = {}
    which = np.fromiter((number.setdefault(s, len(number)) for s in sets), np.int64, len(sets))
    rows = token_rows(list(number), len(table) - 1)
    each = table[rows]
    return each.max(axis=1)[which], which, rows, each.argmax(axis=1)


def word_means(table: np.ndarray, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Means of a table's rows by block, a bounded number of words at a time."""
    n = np.diff(offsets)
    out = np.zeros((len(n), table.shape[1]), dtype=np.float32)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (1 << 16), side="right")) - 1)
        a, b = offsets[lo], offsets[hi]
        if hi == lo + 1:
            out[lo] = np.bincount(words[a:b], minlength=len(table)).astype(np.float32) @ table
        else:
            full = np.flatnonzero(n[lo:hi])
            if len(full):
                out[lo + full] = np.add.reduceat(table[words[a:b]], offsets[lo:hi][full] - a, axis=0)
        lo = hi
    return out / np.maximum(n, 1)[:, None].astype(np.float32)


@dataclass
class Padded:
    """Pages as one (steps, pages) grid; ``place`` has each block's cell."""

    paths: list[tuple[int, int, int]]
    words: np.ndarray
    offsets: np.ndarray
    measured: np.ndarray
    place: np.ndarray
    steps: int
    pages: int
    mask: np.ndarray


def padded(pages: list[Page]) -> Padded:
    steps, n = max(len(p.paths) for p in pages), len(pages)
    place = np.concatenate([np.arange(len(p.paths)) * n + i for i, p in enumerate(pages)])
    mask = np.zeros(steps * n, dtype=np.float32)
    mask[place] = 1
    offsets = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p.offsets) for p in pages]))))
    return Padded([x for p in pages for x in p.paths], np.concatenate([p.words for p in pages]), offsets, np.concatenate([p.measured for p in pages]), place, steps, n, mask.reshape(steps, n, 1))


def run_direction(x: np.ndarray, mask: np.ndarray, w: dict, d: str, tape: list | None) -> np.ndarray:
    """Hidden states of one direction; cells outside a page keep the state."""
    steps, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out = np.zeros((steps, n, HIDDEN), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = x[t] @ w[f"x{d}"] + h @ w[f"h{d}"] + w[f"c{d}"]
        i, f, o = (sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        cn = f * c + i * g
        tc = np.tanh(cn)
        m = mask[t]
        if tape is not None:
            tape.append((t, h, c, i, f, o, g, tc, m))
        h, c = m * (o * tc) + (1 - m) * h, m * cn + (1 - m) * c
        out[t] = h
    return out


def embed(p: Padded, w: dict) -> np.ndarray:
    e = p.measured @ w["measure"] + w["bias"] + word_means(w["word"], p.words, p.offsets)
    for k in range(3):
        e += pooled(w[f"path{k}"], [x[k] for x in p.paths])[0]
    x = np.zeros((p.steps * p.pages, EMBEDDED), np.float32)
    x[p.place] = np.tanh(e)
    return x.reshape(p.steps, p.pages, EMBEDDED)


def label(pages: list[Page], w: dict) -> list[np.ndarray]:
    """Probability of every block of every page to be main text."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i].paths)), key=lambda i: len(pages[i].paths))
    lo = 0
    while lo < len(order):
        # Pages of a batch fill a grid as high as the longest: at most BATCH_PAGES of about equal length.
        longest = 2 * len(pages[order[lo]].paths) + 32
        part = [i for i in order[lo : lo + BATCH_PAGES] if len(pages[i].paths) <= longest]
        p = padded([pages[i] for i in part])
        x = embed(p, w)
        h = np.concatenate((run_direction(x, p.mask, w, "f", None), run_direction(x, p.mask, w, "b", None)), axis=2)
        y = sigmoid(h @ w["out"] + w["out_bias"])
        for j, i in enumerate(part):
            out[i] = y[: len(pages[i].paths), j]
        lo += len(part)
    return out


@lru_cache(maxsize=1)
def model() -> tuple[dict[str, np.ndarray], Vocabulary]:
    """The stored weights and the vocabulary of tag paths."""
    with np.load(WEIGHTS) as f:
        w = {k: f[k].astype(np.float32) for k in f.files if k != "tokens"}
        return w, Vocabulary(json.loads(f["tokens"].tobytes().decode()))


def main_texts(pages: list[str | None], w: dict[str, np.ndarray], vocabulary: Vocabulary) -> list[str]:
    """The main text of each page."""
    parsed = [parse_blocks(p, vocabulary) if p else [] for p in pages]
    scores = label([features(b) for b in parsed], w)
    return ["\n\n".join(b.text for b, s in zip(blocks, y, strict=True) if s >= THRESHOLD) for blocks, y in zip(parsed, scores, strict=True)]


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``html`` replaced by ``text``, its main text, and ``n_chars``.

    Character references are decoded, white space in a block becomes one space, blocks are joined
    by an empty line, nothing else is dropped or cut. Null or empty html, and pages without a main
    block, give an empty text; an empty table gives no rows. Rows are independent, repeats included;
    other columns stay (those named text or n_chars, in any case, are replaced).
    """
    own = [c for c in pages.columns if c.lower() not in (column.lower(), "text", "n_chars")]
    schema = pages.select(*own).schema.add("text", "string").add("n_chars", "long")
    bound_arrow_batches(pages.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, vocabulary = model()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = main_texts(part.column(len(own)).to_pylist(), w, vocabulary)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(own)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*own, "text", "n_chars"])

    return pages.select(*own, F.col(column).cast("string").alias(column)).mapInArrow(work, schema)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
