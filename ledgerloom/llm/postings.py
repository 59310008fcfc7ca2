"""Compact postings: hashed items with their places, one row a bucket and run of documents.

A row holds the postings of one bucket from one run of documents, ordered by
document and position: ids and digests once a document, tags of a fixed width,
and positions as byte-coded gaps.  A posting then costs little more than its
tag, however many there are, and a bucket's rows can be read as a stream.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import binary_array, chunks, mix64, ranges, shuffle_partitions

SCHEMA = "bucket int, kind int, ids binary, digests binary, counts binary, tags binary, gaps binary"

#: Stands for a null id: before every other.
NULL_ID = -(1 << 63)


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, digest, text): rows that share id and digest are copies of one row."""
    return docs.select(F.coalesce(F.col(key), F.lit(NULL_ID)).alias("id"), F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("digest"), F.col(text).alias("text"))


def key_back(c: Column) -> Column:
    return F.when(c != NULL_ID, c)


def encode_gaps(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gaps as bytes, 255 standing for 255 and more to come; and the bytes of each."""
    more = gaps // 255
    size = more + 1
    out = np.full(int(size.sum()), 255, np.uint8)
    out[np.cumsum(size) - 1] = gaps % 255
    return out, size


def decode_gaps(data: np.ndarray) -> np.ndarray:
    total = np.cumsum(data, dtype=np.int64)[data < 255]
    return np.diff(total, prepend=0)


def post(kind: int, buckets: np.ndarray, tags: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, digests: np.ndarray) -> pa.RecordBatch:
    """``tags``: one row of bytes each; postings ordered by document, then position."""
    order = np.argsort(buckets, kind="stable")
    b, doc, pos, tags = buckets[order], doc[order], pos[order], np.ascontiguousarray(tags[order])
    n, width = tags.shape
    new_bucket = np.ones(n, bool)
    new_bucket[1:] = b[1:] != b[:-1]
    new_run = new_bucket.copy()
    new_run[1:] |= doc[1:] != doc[:-1]
    runs, rows = np.flatnonzero(new_run), np.flatnonzero(new_bucket)
    gaps = np.diff(pos, prepend=0)
    gaps[runs] = pos[runs]
    coded, size = encode_gaps(gaps)
    bound = np.append(rows, n)
    run_bound = np.searchsorted(runs, bound)
    byte_bound = np.concatenate([[0], np.cumsum(size)])[bound]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(b[rows].astype(np.int32)), pa.array(np.full(len(rows), kind, np.int32)),
            binary_array(ids[doc[runs]].astype(np.int64), run_bound * 8), binary_array(digests[doc[runs]].astype(np.uint32), run_bound * 4),
            binary_array(np.diff(np.append(runs, n)).astype(np.uint32), run_bound * 4), binary_array(tags, bound * width), binary_array(coded, byte_bound),
        ],
        names=["bucket", "kind", "ids", "digests", "counts", "tags", "gaps"],
    )


def _bytes(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if data is None or not len(column):
        return np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]


@dataclass
class Postings:
    """Decoded rows: runs of postings of one document."""

    ids: np.ndarray
    digests: np.ndarray
    counts: np.ndarray
    tags: np.ndarray  # one row of bytes a posting
    pos: np.ndarray

    def id(self) -> np.ndarray:
        return np.repeat(self.ids, self.counts)

    def digest(self) -> np.ndarray:
        return np.repeat(self.digests, self.counts)


class Places:
    """Collects (id, digest, kind, position) and packs them for the partitions of their documents.

    A packed row holds what one flush found for one partition of documents, so
    the number of rows does not grow with documents times partitions.
    """

    MOST = 1 << 22

    def __init__(self, shards: int):
        self.shards, self.parts, self.size = shards, {}, 0

    def add(self, kind: int, ids: np.ndarray, digests: np.ndarray, pos: np.ndarray):
        self.parts.setdefault(kind, []).append((ids, digests, pos))
        self.size += len(ids)
        if self.size >= self.MOST:
            yield from self.flush()

    def flush(self):
        for kind, parts in sorted(self.parts.items()):
            ids, digests, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((pos, digests, ids))
            ids, digests, pos = ids[order], digests[order], pos[order]
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != ids[:-1]) | (digests[1:] != digests[:-1])
            run = np.flatnonzero(new)
            if len(run):
                yield post(kind, shard_of_ids(ids, self.shards), np.zeros((len(ids), 0), np.uint8), np.cumsum(new) - 1, pos, ids[run], digests[run])
        self.parts, self.size = {}, 0


_PRIME, _FACTOR = (1 << 31) - 1, 48271


def shard_of_ids(ids: np.ndarray, shards: int) -> np.ndarray:
    return (ids % _PRIME * _FACTOR % _PRIME % shards).astype(np.int32)


def shard_of(c: Column, shards: int) -> Column:
    """The same in a plan."""
    return (F.pmod(c, F.lit(_PRIME).cast("long")) * _FACTOR % _PRIME % shards).cast("int")


def decode(rows: pa.RecordBatch, width: int) -> Postings:
    c = {n: _bytes(rows.column(n)) for n in ("ids", "digests", "counts", "tags", "gaps")}
    counts = c["counts"].copy().view(np.uint32).astype(np.int64)
    gaps = decode_gaps(c["gaps"])
    total = np.cumsum(gaps)
    first = np.cumsum(counts) - counts
    pos = total - np.repeat(total[first] - gaps[first], counts) if len(counts) else total
    return Postings(c["ids"].copy().view(np.int64), c["digests"].copy().view(np.uint32), counts, c["tags"].reshape(-1, width) if width else np.zeros((len(pos), 0), np.uint8), pos)


def by_kind(batches, width: int | dict[int, int]):
    """(kind, postings) of a partition whose rows are sorted by kind; a dict gives each kind's width of tags."""
    for b in batches:
        kinds = b.column("kind").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1), len(kinds)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                yield int(kinds[lo]), decode(b.slice(lo, hi - lo), width[int(kinds[lo])] if isinstance(width, dict) else width)


def buckets_of(spark) -> int:
    return shuffle_partitions(spark)


def dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """One partition a bucket, rows of lower kinds first."""
    return rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("kind")


DOCUMENT = 9


def meet(rows: DataFrame, places: DataFrame, shards: int, fn, schema: str, *, inner: bool = False) -> DataFrame:
    """Documents (id, digest, text) with the places found for them.

    ``fn(part, texts, found)`` gets runs of documents; ``found[kind]`` is (row,
    position), rows counted over the run.  Texts move once, to the partition of
    their id, where the packed places of that partition are read first.  With
    ``inner``, documents without places are left out.
    """
    none = {c: F.lit(None).cast("binary").alias(c) for c in ("ids", "digests", "counts", "tags", "gaps")}
    texts = rows.select(shard_of(F.col("id"), shards).alias("bucket"), F.lit(DOCUMENT).alias("kind"), *none.values(), "id", "digest", "text")
    both = places.select("*", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("digest"), F.lit(None).cast("string").alias("text")).unionByName(texts)

    def run(batches):
        parts, table = {}, None
        for b in batches:
            kinds = b.column("kind").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1), len(kinds)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if kinds[lo] != DOCUMENT:
                    p = decode(b.slice(lo, hi - lo), 0)
                    parts.setdefault(int(kinds[lo]), []).append((_row_key(p.ids, p.digests), p.counts, p.pos))
                    continue
                if table is None:
                    table = {kind: _sorted_runs(x) for kind, x in parts.items()}
                    parts = {}
                docs = b.slice(lo, hi - lo)
                if inner:
                    keys = _row_key(*_ids(docs))
                    known = np.zeros(len(keys), bool)
                    for key, *_ in table.values():
                        known |= np.isin(keys, key)
                    docs = docs.filter(pa.array(known))
                for part, texts in chunks(docs):
                    keys = _row_key(*_ids(part))
                    found = {kind: _look_up(keys, *x) for kind, x in table.items()}
                    yield from fn(part, texts, found)

    return dealt(both, shards).mapInArrow(run, schema)


def _ids(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return part.column("id").to_numpy(), part.column("digest").to_numpy().astype(np.uint32)


def _row_key(ids: np.ndarray, digests: np.ndarray) -> np.ndarray:
    return mix64(ids.astype(np.int64).view(np.uint64)) ^ (digests.astype(np.uint64) << np.uint64(17))


def _sorted_runs(parts):
    """(distinct document keys, first run of each, where runs begin, their lengths, positions)"""
    keys, counts, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    begin = np.cumsum(counts) - counts
    order = np.argsort(keys, kind="stable")
    keys, counts, begin = keys[order], counts[order], begin[order]
    return keys, begin, counts, pos


def _look_up(wanted: np.ndarray, keys, begin, counts, pos) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = np.searchsorted(keys, wanted, side="left"), np.searchsorted(keys, wanted, side="right")
    runs = ranges(lo, hi - lo)
    row = np.repeat(np.repeat(np.arange(len(wanted)), hi - lo), counts[runs])
    return row, pos[ranges(begin[runs], counts[runs])]


NOTHING = (np.zeros(0, np.int64), np.zeros(0, np.int64))
