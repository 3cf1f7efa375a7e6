"""Best-fit packing: documents as token sequences of bounded length, in bounded space.

Every task packs the documents of its partition as they come. It keeps a fixed number of open
sequences, found through a bitset keyed by their free space: the fullest one that still holds a
piece takes it; if none does and the number of open ones is reached, the fullest closes first.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perron.session import bound_arrow_batches

LENGTH = 4096
OPEN = 1024
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a worker remembers, and rows that it works on at once.
CACHE_WORDS = 400_000
SLICE_BYTES = 4 << 20
#: How the vocabulary marks a word's last token, and new words that are encoded as one text.
WORD_END = "</w>"
GROUP_WORDS = 500
#: Letters below are the Latin ones without combining marks, the same in every version of Unicode.
LATIN_END = "\u0250"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(texts: pa.Array) -> pa.Array:
    """Texts (large strings without nulls) with A-Z in lower case, all other bytes as they are."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(_LOWER[data]))


class WordTokenizer:
    """Ids of texts, word by word.

    The vocabulary drops white space and never joins across it, so the ids of a text are those of
    its space-separated words in a row; a word that occurs again is not tokenized again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        fast = lambda t: getattr(t, "encode_batch_fast", t.encode_batch)
        self.model = Tokenizer.from_file(path)
        self.encode = fast(self.model)
        ascii_, latin = Tokenizer(self.model.model), Tokenizer(self.model.model)
        ascii_.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        latin.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.by_run = (fast(ascii_), fast(latin))
        self.ends_word = np.zeros(self.model.get_vocab_size(), dtype=bool)
        self.ends_word[[i for t, i in self.model.get_vocab().items() if t.endswith(WORD_END)]] = True
        self.forget()

    def forget(self) -> None:
        """Start anew with END_ID as the only known word, of code 0."""
        self.known: dict[str, int] = {}
        self.flat, self.used = np.full(1 << 20, END_ID, dtype=np.uint32), 1
        self.starts, self.lengths, self.count = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64), 1

    def learn(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> int:
        """Remember words, with all of their ids in a row; the first one's code."""
        for name, size, more in (("flat", self.used, len(ids)), ("starts", self.count, len(words)), ("lengths", self.count, len(words))):
            old = getattr(self, name)
            if size + more > len(old):
                grown = np.zeros(max(2 * len(old), size + more), old.dtype)
                grown[:size] = old[:size]
                setattr(self, name, grown)
        first = self.count
        self.known.update(zip(words, range(first, first + len(words)), strict=True))
        new = slice(first, first + len(words))
        self.lengths[new], self.starts[new] = lengths, self.used + np.cumsum(lengths) - lengths
        self.flat[self.used : self.used + len(ids)] = ids
        self.count, self.used = new.stop, self.used + len(ids)
        return first

    def tokenize(self, words: list[str]) -> np.ndarray:
        """Codes of new words. Lower-case words of Latin letters alone need no normalizing and are one token
        run each, which ends in a word-end token: many are encoded as one text, told apart by these, and
        plain ASCII ones are their own byte-level form. The others are encoded one by one."""
        codes = np.empty(len(words), dtype=np.int64)
        kind = np.fromiter((2 if not w.isalpha() else 0 if w.isascii() and w.islower() else 1 if max(w) < LATIN_END and w == w.lower() else 2 for w in words), np.int8, len(words))
        single = np.flatnonzero(kind == 2).tolist()
        for k, encode in enumerate(self.by_run):
            place = np.flatnonzero(kind == k)
            parts = [place[lo : lo + GROUP_WORDS].tolist() for lo in range(0, len(place), GROUP_WORDS)]
            texts = [[words[i] for i in part] for part in parts]
            for part, text, e in zip(parts, texts, encode([" ".join(t) for t in texts], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype=np.uint32)
                ends = np.flatnonzero(self.ends_word[ids])
                if len(ends) == len(part) and ends[-1] == len(ids) - 1:
                    first = self.learn(text, ids, np.diff(ends, prepend=-1))
                    codes[part] = np.arange(first, first + len(part))
                else:
                    single += part
        for lo in range(0, len(single), 10_000):
            part = single[lo : lo + 10_000]
            text = [words[i] for i in part]
            each = [e.ids for e in self.encode(text, add_special_tokens=False)]
            lengths = np.fromiter(map(len, each), np.int64, len(each))
            first = self.learn(text, np.fromiter(chain.from_iterable(each), np.uint32, int(lengths.sum())), lengths)
            codes[part] = np.arange(first, first + len(part))
        return codes

    def codes(self, words: list[str]) -> np.ndarray:
        """The codes of different words, under which their ids are found."""
        get = self.known.get
        found = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(found < 0).tolist()
        if new:
            if len(self.known) + len(new) > CACHE_WORDS:
                self.forget()
                return self.tokenize(words)
            found[new] = self.tokenize([words[i] for i in new])
        return found

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each document's followed by END_ID, and the documents' offsets in them."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # The vocabulary is lower-case and parts letters from punctuation: doing both first leaves fewer different words.
        # Its special tokens are found before that, so they must stay as they are.
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = lowered(texts)
        texts = pc.replace_substring_regex(texts, "([A-Za-z])([.,;:!?])", "\\1 \\2")
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        index = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = self.codes(words.dictionary.to_pylist())
        ends = lists.offsets.to_numpy()[1:] - lists.offsets.to_numpy()[0]
        index = np.insert(code[index], ends, 0)
        n = self.lengths[index]
        after = np.cumsum(n)
        total = int(after[-1]) if len(after) else 0
        narrow = np.int32 if max(total, self.used) < 1 << 30 else np.int64
        ids = self.flat[np.repeat((self.starts[index] - (after - n)).astype(narrow), n) + np.arange(total, dtype=narrow)]
        last = ends + np.arange(len(ends))  # where each document's END_ID is among the words
        return ids, np.concatenate(([0], after[last])) if len(ends) else np.zeros(1, np.int64)


@lru_cache(maxsize=2)
def tokenizer_of(path: str) -> WordTokenizer:
    """One tokenizer, with the words it remembers, for all tasks of a worker."""
    return WordTokenizer(path)


class OpenBins:
    """A bounded number of open sequences, by free space."""

    def __init__(self, length: int, most: int, first: int):
        self.length, self.most, self.next = length, most, first
        self.bits, self.count = 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.count -= 1
        return found

    def place(self, need: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of ``need`` tokens."""
        fitting = self.bits >> need
        if fitting:
            free = need + (fitting & -fitting).bit_length() - 1
            found = self._take(free)
        else:
            if self.count >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            found, free = self.next, self.length
            self.next += 1
        if free > need:
            self.by_free[free - need].append(found)
            self.bits |= 1 << (free - need)
            self.count += 1
        return found, self.length - free


def pack(docs: DataFrame, length: int = LENGTH, most_open: int = OPEN, vocabulary: str | None = None) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` and their places in sequences of at most ``length`` tokens.

    A document is its ids and END_ID; null and empty texts are END_ID alone. Only documents of over
    ``length`` tokens are cut. Rows are packed one by one, so repeated or null ids are documents of
    their own; other columns are ignored; an empty table gives no rows. Sequence ids are unique
    over the tasks (partition number times 2**33 and on).

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    bound_arrow_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins = OpenBins(length, most_open, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33)
        for batch in batches:
            tokenizer = tokenizer_of(path)
            rows = max(1, int(batch.num_rows * min(1, SLICE_BYTES / max(1, batch.column(1).nbytes))))
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                ids, offsets = tokenizer.documents(part.column(1))
                data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                sizes = np.diff(offsets)
                pieces = (sizes + length - 1) // length  # one at least, as END_ID is there
                row = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * length
                need = np.minimum(length, sizes[row] - start)
                begin = ((offsets[row] + start) * 4).tolist()
                crc = [zlib.crc32(data[a : a + 4 * n]) for a, n in zip(begin, need.tolist(), strict=True)]
                placed = np.array([bins.place(n) for n in need.tolist()], dtype=np.int64).reshape(-1, 2)
                columns = [part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), *[pa.array(c, pa.int64()) for c in (start, need, crc, placed[:, 0], placed[:, 1])]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        work, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
