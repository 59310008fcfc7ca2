"""Substring dedup by fixed-block anchors.

A window of ``window`` words that two documents share contains a whole block of
``block = (window + 1) // 2`` words that starts at a multiple of ``block`` in
either of them.  So only these non-overlapping blocks are indexed (kind 0) and
every rolling run of ``block`` words probes the index (kind 1).  A hit in a
block of a smaller id is extended: the windows that contain it are candidates
on the probing side, and those around the hit block are references on the other
(kind 2 asks the index rows which blocks were hit).  Candidates and references
meet by their 128-bit window hash; a window is repeated if its least reference
has a smaller id.  Repeated windows are merged into maximal runs and removed.

Volume: the first exchange carries five bytes a word, later ones only repeated
places; a hash's references shrink to one least id before and after the
exchange, probes are streamed, so a passage shared by a third of all documents
neither multiplies rows nor fills a task.  Texts are joined to their own
places by id.

Null text: no words.  Null id: before every other.  Rows with equal ids never
remove each other's windows; each is judged by its own text.  Other columns are
ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Rolling, Workspace, map_texts, windows_in_docs, word_hashes, words_of
from ledgerloom.llm.postings import NOTHING, SCHEMA, Places, buckets_of, by_kind, dealt, key_back, keyed, meet, post

WINDOW = 13
TAG = 5

_BYTES, _SEQ = Rolling(301), Rolling(302)
_BYTES2, _SEQ2 = Rolling(303, 1), Rolling(304, 1)


def _columns(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return part.column("id").to_numpy(), part.column("digest").to_numpy().astype(np.uint32)


def _tags(h: np.ndarray, width: int) -> np.ndarray:
    return h.view(np.uint8).reshape(-1, 8)[:, 8 - width :]


def anchor_postings(rows: DataFrame, window: int, buckets: int) -> DataFrame:
    block = (window + 1) // 2

    def fn(part, texts):
        ids, digests = _columns(part)
        words = words_of(texts)
        starts, doc = windows_in_docs(words.first, block)
        # documents shorter than a window can neither lose nor give one
        long = words.counts()[doc] >= window
        starts, doc = starts[long], doc[long]
        if not len(starts):
            return
        h = _SEQ.spans(_SEQ.prefix(word_hashes(texts, words, _BYTES)), starts, starts + block)
        pos = starts - words.first[doc]
        at = (h % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int32)
        tags = _tags(h, TAG)
        fixed = np.flatnonzero(pos % block == 0)
        for kind, some in ((0, fixed), (1, np.arange(len(h))), (2, fixed)):
            yield post(kind, at[some], tags[some], doc[some], pos[some], ids, digests)

    return map_texts(rows, fn, SCHEMA)


def _least(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the least id of each."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new], ids[new]


class LeastIds:
    """Distinct keys of a stream with the least id of each."""

    def __init__(self):
        self.parts, self.size, self.keys, self.ids = [], 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((keys, ids))
        self.size += len(keys)
        if self.size > max(1 << 20, len(self.keys)):
            self.settle()

    def settle(self) -> None:
        if self.parts:
            keys, ids = (np.concatenate(x) for x in zip((self.keys, self.ids), *self.parts, strict=True))
            self.keys, self.ids = _least(keys, ids)
            self.parts, self.size = [], 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``keys``, place in the index) of those known."""
        self.settle()
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        j = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[j] == keys)
        return hit, j[hit]


def _tag_keys(tags: np.ndarray) -> np.ndarray:
    out = np.zeros((len(tags), 8), np.uint8)
    out[:, : tags.shape[1]] = tags
    return out.view(np.uint64).ravel()


def probe_anchors(postings: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        index, most, places = LeastIds(), None, Places(buckets)
        for kind, p in by_kind(batches, TAG):
            keys, ids = _tag_keys(p.tags), p.id()
            if kind == 0:
                index.add(keys, ids)
                continue
            hit, j = index.find(keys)
            if most is None:
                most = np.full(len(index.keys), np.iinfo(np.int64).min)
            if kind == 1:
                np.maximum.at(most, j, ids[hit])
                keep = hit[index.ids[j] < ids[hit]]
            else:
                keep = hit[most[j] > ids[hit]]
            yield from places.add(kind, ids[keep], p.digest()[keep], p.pos[keep])
        yield from places.flush()

    return dealt(postings, buckets).mapInArrow(run, SCHEMA)


def _around(row: np.ndarray, pos: np.ndarray, first: np.ndarray, window: int, block: int) -> np.ndarray:
    """Starts (counted over the run of documents) of the windows that contain the hit blocks."""
    mark = np.zeros(int(first[-1]) + 1, bool)
    for back in range(window - block + 1):
        at = pos - back
        good = (at >= 0) & (at <= first[row + 1] - first[row] - window)
        mark[(first[row] + at)[good]] = True
    return np.flatnonzero(mark)


def window_postings(rows: DataFrame, hits: DataFrame, window: int, buckets: int) -> DataFrame:
    block = (window + 1) // 2

    def fn(part, texts, found):
        ids, digests = _columns(part)
        words = words_of(texts)
        one = _SEQ.prefix(word_hashes(texts, words, _BYTES))
        two = _SEQ2.prefix(word_hashes(texts, words, _BYTES2))
        for kind, source in ((0, 2), (1, 1)):
            row, pos = found.get(source, NOTHING)
            starts = _around(row, pos, words.first, window, block)
            if not len(starts):
                continue
            doc = np.searchsorted(words.first, starts, side="right") - 1
            h, g = (r.spans(p, starts, starts + window) for r, p in ((_SEQ, one), (_SEQ2, two)))
            if kind == 0:  # only the least id of a window matters
                order = np.lexsort((ids[doc], g, h))
                hs, gs = h[order], g[order]
                new = np.ones(len(order), bool)
                new[1:] = (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1])
                keep = np.sort(order[new])
                starts, doc, h, g = starts[keep], doc[keep], h[keep], g[keep]
            tags = np.concatenate([_tags(h, 8), _tags(g, 8)], axis=1)
            yield post(kind, (h % np.uint64(buckets)).astype(np.int32), tags, doc, starts - words.first[doc], ids, digests)

    return meet(rows, hits, buckets, fn, SCHEMA, inner=True)


def match_windows(postings: DataFrame, buckets: int) -> DataFrame:
    """Places of windows whose least reference has a smaller id."""

    def run(batches):
        # 128-bit keys: searched by their first half, checked by the second
        seen_h, seen_g, seen_id = [], [], []
        table, places = None, Places(buckets)
        for kind, p in by_kind(batches, 16):
            both = p.tags.copy().view(np.uint64)
            h, g, ids = both[:, 0].copy(), both[:, 1].copy(), p.id()
            if kind == 0:
                seen_h.append(h), seen_g.append(g), seen_id.append(ids)
                if sum(map(len, seen_h)) > 1 << 21:
                    seen_h, seen_g, seen_id = ([x] for x in _least2(*map(np.concatenate, (seen_h, seen_g, seen_id))))
                continue
            if table is None:
                table = _least2(*map(np.concatenate, (seen_h, seen_g, seen_id))) if seen_h else ()
            if not table or not len(table[0]):
                continue
            j = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
            keep = np.flatnonzero((table[0][j] == h) & (table[1][j] == g) & (table[2][j] < ids))
            yield from places.add(1, ids[keep], p.digest()[keep], p.pos[keep])
        yield from places.flush()

    return dealt(postings, buckets).mapInArrow(run, SCHEMA)


def _least2(h: np.ndarray, g: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, g, h))
    h, g, ids = h[order], g[order], ids[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    return h[new], g[new], ids[new]


def remove_repeats(docs: DataFrame, window: int = WINDOW, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, spans, kept) for every row.

    ``spans`` are the maximal removed runs as [start, end) word numbers and
    ``kept`` the other words joined by one space.
    """
    spark = docs.sparkSession
    rows, buckets = keyed(docs, key, text), buckets_of(spark)
    work = Workspace(spark, "substring")
    hits = work.save(probe_anchors(anchor_postings(rows, window, buckets), buckets), "hits")
    repeated = work.save(match_windows(window_postings(rows, hits, window, buckets), buckets), "windows")
    work.drop("hits")

    def fn(part, texts, found):
        words = words_of(texts)
        row, pos = found.get(1, NOTHING)
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, words.first[row] + pos, 1)
        np.add.at(edge, np.minimum(words.first[row] + pos + window, len(words)), -1)
        yield _rendered(part, texts, words, np.cumsum(edge[:-1]) > 0)

    final = meet(rows, repeated, buckets, fn, "id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string")
    return final.select(key_back(F.col("id")).alias(key), "n_words", "n_removed", "spans", "kept")


def _rendered(part, texts, words, gone) -> pa.RecordBatch:
    data = texts.data.copy()
    keep = np.zeros(len(data) + 1, np.int8)
    # a kept word's bytes and the separator after it, written as a space
    at = words.starts[~gone]
    end_of_doc = texts.offsets[1:][words.doc()[~gone]]
    upto = np.minimum(words.ends[~gone] + 1, end_of_doc)
    sep = words.ends[~gone][words.ends[~gone] < end_of_doc]
    data[sep] = 0x20
    keep[at] += 1
    np.add.at(keep, upto, -1)
    mask = np.cumsum(keep[:-1], dtype=np.int8) > 0
    out = data[mask]
    bounds = np.concatenate([[0], np.cumsum(mask)])[texts.offsets]
    # the separator after a document's last kept word goes
    last = bounds[1:] - 1
    trail = (np.diff(bounds) > 0) & (out[np.maximum(last, 0)] == 0x20) if len(out) else np.zeros(len(texts), bool)
    drop = np.ones(len(out), bool)
    drop[last[trail]] = False
    out = out[drop]
    bounds = bounds - np.concatenate([[0], np.cumsum(trail)])
    n = len(texts)
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    # runs are cut at document borders
    first = words.first
    begin = np.zeros(len(gone), bool)
    begin[np.flatnonzero(edge[:-1] == 1)] = True
    inner = first[:-1][(first[:-1] < len(gone))]
    begin[inner] |= gone[inner]
    begins = np.flatnonzero(begin)
    stop = np.zeros(len(gone) + 1, bool)
    stop[np.flatnonzero(edge == -1)] = True
    border = first[1:][first[1:] > 0]
    stop[border] |= gone[border - 1]
    stops = np.flatnonzero(stop)
    doc = np.searchsorted(first, begins, side="right") - 1
    per = np.bincount(doc, minlength=n)
    spans = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array((begins - first[doc]).astype(np.int64)), pa.array((stops - first[doc]).astype(np.int64))], names=["start", "end"]),
    )
    removed = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(first[:-1], len(gone))) if n else np.zeros(0, np.int64)
    removed = np.where(words.counts() > 0, removed, 0)
    kept = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out))])
    return pa.RecordBatch.from_arrays([part.column("id"), pa.array(words.counts()), pa.array(removed), spans, kept], names=["id", "n_words", "n_removed", "spans", "kept"])
