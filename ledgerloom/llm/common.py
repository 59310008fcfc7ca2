"""Shared pieces of the training-data operators: tables, text buffers, hashes.

Texts reach Python as Arrow string arrays.  Their UTF-8 buffer is viewed as one
``uint8`` array, so that tokenising and hashing are array operations over many
documents at once and no Python object is made for a word or a byte.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.sources.workspace import Workspace, shuffle_partitions  # noqa: F401


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` bears, whatever its extra columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out

U64 = np.uint64

#: Bytes and rows of text handled at once inside a task; bound the temporaries.
CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 1 << 10


# --------------------------------------------------------------------------
# text buffers


@dataclass
class Texts:
    """UTF-8 bytes of some documents, one after the other; null is empty."""

    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than documents

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def texts_of(array: pa.Array | pa.ChunkedArray) -> Texts:
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    if len(array) == 0:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def chunks(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """A batch in runs of whole documents of about ``most`` bytes and at most ``rows`` rows."""
    whole = texts_of(batch.column(text))
    first, n = 0, len(whole)
    while first < n:
        last = int(np.searchsorted(whole.offsets, whole.offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), first + rows, n)
        lo, hi = whole.offsets[first], whole.offsets[last]
        yield batch.slice(first, last - first), Texts(whole.data[lo:hi], whole.offsets[first : last + 1] - lo)
        first = last


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch, Texts], Iterator[pa.RecordBatch]], schema: str, text: str = "text") -> DataFrame:
    """``fn`` over runs of documents; ``df`` holds the columns that it needs."""

    def run(batches):
        for batch in batches:
            for part, texts in chunks(batch, text):
                yield from fn(part, texts)

    return df.mapInArrow(run, schema)


_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True

#: Lower-cases A-Z in UTF-8 bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some documents: byte spans and, per document, where its words begin."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # one more than documents

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def words_of(texts: Texts) -> Words:
    """Separators are single bytes below 0x80, so words are found in the bytes."""
    word = ~_SEP[texts.data]
    begins = np.zeros(len(word) + 1, bool)
    begins[texts.offsets] = True  # a word never crosses a document
    before = np.empty_like(word)
    if len(word):
        before[0] = False
        before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | begins[:-1]))
    after = np.empty_like(word)
    if len(word):
        after[-1] = False
        after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | begins[1:])) + 1
    return Words(starts, ends, np.searchsorted(starts, texts.offsets))


# --------------------------------------------------------------------------
# hashes


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (in place on a copy)."""
    x = x.copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Powers:
    """Powers of an odd base mod 2**64 and of its inverse, kept once a process."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n * 9 // 8, 1 << 16)
            up, down = np.full(size, self.base, np.uint64), np.full(size, self.inverse, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


_POWERS = [_Powers(0x5851F42D4C957F2D), _Powers(0x2545F4914F6CDD1D)]


class Rolling:
    """64-bit hashes of arbitrary spans of a byte or word sequence.

    A span's hash is the difference of two prefix sums of value times power,
    divided by the power at its start (the odd base has an inverse mod 2**64),
    then mixed.  Two hashes of different ``lane`` are independent.
    """

    def __init__(self, seed: int, lane: int = 0):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
        self._powers = _POWERS[lane].upto

    def prefix(self, values: np.ndarray) -> np.ndarray:
        up, _ = self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=out[1:])
        return out

    def bytes_prefix(self, data: np.ndarray) -> np.ndarray:
        return self.prefix(self.table[data])

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, down = self._powers(len(prefix))
        return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Of every run of ``width`` values, document borders not regarded."""
        n = len(prefix) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        _, down = self._powers(len(prefix))
        return mix64((prefix[width:] - prefix[:n]) * down[:n])


def word_hashes(texts: Texts, words: Words, rolling: Rolling) -> np.ndarray:
    return rolling.spans(rolling.bytes_prefix(texts.data), words.starts, words.ends)


def windows_in_docs(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of ``width`` items that stay inside a document, and their documents."""
    counts = np.diff(first)
    room = np.maximum(counts - width + 1, 0)
    doc = np.repeat(np.arange(len(counts)), room)
    shift = first[:-1] - (np.cumsum(room) - room)
    return np.arange(len(doc)) + shift[doc], doc


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``concatenate([arange(s, s + n) ...])``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return base + np.arange(total)


def binary_array(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of bytes: ``data`` (contiguous) cut at ``bounds`` (in bytes)."""
    return pa.Array.from_buffers(
        pa.binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    )


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))
