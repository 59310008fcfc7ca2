"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items are cut into overlapping segments (``SEGMENT`` bytes, ``STRIDE``
apart; a shorter item is one), so that an excerpt of ``SEGMENT + STRIDE - 1``
bytes holds a whole segment wherever it begins.  A segment of m bytes with at most e
edits shares m - q + 1 - q * e of its q-grams with the text, all near one
diagonal.  Text places whose q-gram occurs in no segment are dropped first,
then places without enough such neighbours, and the rest are counted by
segment and diagonal band; bands are 2e wide and overlap by half, so no
occurrence falls between two.  Bands that reach the count are verified by a
banded alignment, all bands of a run of documents at once.

Texts are compared as UTF-8 bytes with A-Z lower-cased and white space made
equal; an edit is one inserted, deleted or changed byte.

The benchmark is the stated query set: it is read in blocks of about
``BLOCK_BYTES``, and each block is compared with all documents in their place, so
nothing is shuffled but hits.  The driver holds one block of items at a time and
sends the items; workers build the block's index once, and a block's hits are
written before the next block is read.

Null or short texts match nothing; items under ``q`` bytes are no evidence and
are left out.  Copies of a row report once, rows that share an id with other text
each; null ids of documents and items are reported as null.  A very long text is
held whole by its task, with some 40 bytes for each of its own.  Other columns are
ignored whatever their names; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import LOWER, Rolling, Texts, Workspace, map_texts, ranges

SEGMENT = 64
STRIDE = 8
Q = 10
EDITS = 0.06
#: An index holds about SEGMENT / STRIDE q-grams of 6 bytes for each byte of its items.
BLOCK_BYTES = 4 << 20

_FOLD = LOWER.copy()
_FOLD[[9, 10, 11, 12, 13]] = 0x20
_GRAMS = Rolling(601)


class Segments:
    """Segments of some benchmark items and the index of their q-grams."""

    def __init__(self, items: list[tuple[int, str]], segment: int, q: int, edits: float):
        self.q = q
        self.item, self.text, self.start = [], [], []
        for item, text in items:
            b = _FOLD[np.frombuffer((text or "").encode(), np.uint8)]
            if len(b) < q:
                continue
            starts = list(range(0, max(1, len(b) - segment + 1), STRIDE))
            if len(b) > segment and starts[-1] + segment < len(b):
                starts.append(len(b) - segment)
            for s in starts:
                self.item.append(item), self.text.append(b[s : s + segment]), self.start.append(s)
        self.m = np.array([len(t) for t in self.text], np.int64)
        self.e = np.minimum((self.m * edits).astype(np.int64), np.maximum(self.m - q, 0) // q)
        self.need = self.m - q + 1 - q * self.e
        grams = [_GRAMS.windows(_GRAMS.bytes_prefix(t), q) for t in self.text]
        h = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        seg = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        at = ranges(np.zeros(len(grams), np.int64), np.array([len(g) for g in grams], np.int64))
        order = np.argsort(h, kind="stable")
        self.seg, self.at = seg[order].astype(np.int32), at[order].astype(np.int16)
        self.keys, self.first = np.unique(h[order], return_index=True)
        self.first = np.append(self.first, len(h))
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.keys >> np.uint64(42)] = True

    def hits(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Text places and numbers of the q-grams that segments hold and that have enough company."""
        h = _GRAMS.windows(_GRAMS.bytes_prefix(_FOLD[texts.data]), self.q)
        place = np.flatnonzero(self.maybe[h >> np.uint64(42)])
        key = np.minimum(np.searchsorted(self.keys, h[place]), len(self.keys) - 1)
        ok = self.keys[key] == h[place]
        doc = np.searchsorted(texts.offsets, place, side="right") - 1
        ok &= place + self.q <= texts.offsets[doc + 1]
        place, key = place[ok], key[ok]
        if not len(place):
            return place, key
        reach = int((self.m + self.e).max())
        upto = np.searchsorted(place, place + reach)
        rich = np.flatnonzero(upto - np.arange(len(place)) >= self.need.min())
        edge = np.zeros(len(place) + 1, np.int64)
        np.add.at(edge, rich, 1)
        np.add.at(edge, upto[rich], -1)
        keep = np.cumsum(edge[:-1]) > 0
        return place[keep], key[keep]

    def candidates(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, segment, first diagonal of the band) of all bands with enough shared q-grams."""
        place, key = self.hits(texts)
        empty = np.zeros(0, np.int64)
        if not len(place):
            return empty, empty, empty
        n = self.first[key + 1] - self.first[key]
        where = ranges(self.first[key], n)
        seg, x = self.seg[where].astype(np.int64), np.repeat(place, n)
        doc = np.searchsorted(texts.offsets, x, side="right") - 1
        # one place counts once for a segment and band however often the gram recurs nearby
        diagonal = x - self.at[where] + SEGMENT  # over 0 everywhere
        step = np.maximum(self.e[seg], 1)
        band = diagonal // step
        seg2, band2, x2, doc2 = (np.concatenate([a, b]) for a, b in ((seg, seg), (band, band - 1), (x, x), (doc, doc)))
        order = np.lexsort((x2, doc2, band2, seg2))
        seg2, band2, x2, doc2 = seg2[order], band2[order], x2[order], doc2[order]
        new_band = np.ones(len(seg2), bool)
        new_band[1:] = (seg2[1:] != seg2[:-1]) | (band2[1:] != band2[:-1]) | (doc2[1:] != doc2[:-1])
        new_place = new_band.copy()
        new_place[1:] |= x2[1:] != x2[:-1]
        group = np.cumsum(new_band) - 1
        count = np.bincount(group[new_place])
        head = np.flatnonzero(new_band)
        good = head[count >= self.need[seg2[head]]]
        return doc2[good], seg2[good], band2[good] * np.maximum(self.e[seg2[good]], 1) - SEGMENT


def banded_edits(patterns: np.ndarray, lengths: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each pattern against any part of its window, and where that part ends.

    Row i of the table only holds the window's places i .. i + width, the band.
    """
    n, m = patterns.shape
    width = windows.shape[1] - m
    cost = np.zeros((n, width + 1), np.int64)  # any start in the band is free
    step = np.arange(width + 1)
    best, end = np.full(n, 1 << 30), np.zeros(n, np.int64)
    for i in range(m + 1):
        done = np.flatnonzero(lengths == i)
        if len(done):
            end[done] = cost[done].argmin(axis=1) + i
            best[done] = cost[done].min(axis=1)
        if i == m:
            break
        differ = windows[:, i : i + width + 1] != patterns[:, i : i + 1]
        new = cost + differ  # along the diagonal
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)  # a pattern byte without partner
        cost = np.minimum.accumulate(new - step, axis=1) + step  # window bytes without partner
    return best, end


def _verify(found, texts: Texts, segments: Segments) -> tuple[np.ndarray, ...]:
    doc, seg, diagonal = found
    m = int(segments.m.max())
    band = int(3 * segments.e.max()) + 2
    data = np.append(_FOLD[texts.data], np.uint8(0xFF))
    keep = [np.zeros(0, np.int64) for _ in range(4)]
    for lo in range(0, len(doc), 4096):
        d, s, g = doc[lo : lo + 4096], seg[lo : lo + 4096], diagonal[lo : lo + 4096]
        begin = g - segments.e[s]
        at = begin[:, None] + np.arange(m + band)
        at[(at < texts.offsets[d][:, None]) | (at >= texts.offsets[d + 1][:, None])] = len(data) - 1
        patterns = np.zeros((len(s), m), np.uint8)
        for i, k in enumerate(s):
            patterns[i, : segments.m[k]] = segments.text[k]
        edits, end = banded_edits(patterns, segments.m[s], data[at])
        ok = np.flatnonzero(edits <= segments.e[s])
        stop = begin[ok] + end[ok] - texts.offsets[d[ok]]
        keep = [np.concatenate([a, b]) for a, b in zip(keep, (d[ok], s[ok], edits[ok], stop), strict=True)]
    return tuple(keep)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", segment: int = SEGMENT, q: int = Q, edits: float = EDITS) -> DataFrame:
    """(key, item, n_segments, start, end, edits): one row a document and item met in it.

    ``start`` and ``end`` are bytes of the text from the first to the last
    matched segment; ``edits`` is the least of any segment.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "decontam")
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text"), F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("digest"))
    schema = "k long, digest long, item long, segment int, start long, end long, edits long"

    def block_hits(items):
        name = uuid.uuid4().hex

        def fn(part, texts):
            index = _index(name, items, segment, q, edits)
            found = index.candidates(texts) if index.text else ([],)
            if not len(found[0]):
                return
            d, s, cost, stop = _verify(found, texts, index)
            ids, digests = part.column("k").take(pa.array(d)), part.column("digest").take(pa.array(d))
            items_ = pa.array(index.item, pa.int64()).take(pa.array(s))
            yield pa.RecordBatch.from_arrays(
                [ids, digests, items_, pa.array(s.astype(np.int32)), pa.array(np.maximum(stop - index.m[s], 0)), pa.array(stop), pa.array(cost)],
                names=["k", "digest", "item", "segment", "start", "end", "edits"],
            )

        return map_texts(rows, fn, schema)

    parts = [work.save(block_hits(items), f"hits-{i}") for i, items in enumerate(_blocks(benchmark, item, item_text))]
    hits = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return (
        hits.groupBy("k", "digest", "item")
        .agg(F.countDistinct("segment").alias("n_segments"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("edits").alias("edits"))
        .select(F.col("k").alias(key), F.col("item").alias(item), "n_segments", "start", "end", "edits", "digest")
    )


_INDEX: dict[str, Segments] = {}


def _index(name: str, items: list, segment: int, q: int, edits: float) -> Segments:
    """The index of a block, built once by each worker, which keeps the last one."""
    if name not in _INDEX:
        _INDEX.clear()
        _INDEX[name] = Segments(items, segment, q, edits)
    return _INDEX[name]


def _blocks(benchmark: DataFrame, item: str, item_text: str):
    """Runs of distinct benchmark items of bounded size, fetched one after the other."""
    rows = benchmark.select(F.col(item).alias("i"), F.col(item_text).alias("t")).where("t is not null").distinct().orderBy("i", "t")
    block, size = [], 0
    for r in rows.toLocalIterator():
        block.append((r["i"], r["t"]))
        size += len(r["t"])
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block
