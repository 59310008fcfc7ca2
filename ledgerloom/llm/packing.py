"""Packing of token sequences by bounded-space online best-fit.

Texts are tokenised where they are read; a document's ids end with ``end_id``.
Longer ones are cut into pieces of ``capacity`` tokens, the first piece taking
the remainder.  Only piece lengths move: they are dealt by hash into groups of
about ``GROUP`` pieces, and each group is packed in one stream with a fixed
number of open sequences.  A bitset holds the free spaces that occur; a piece
goes where the least sufficient space is left, and if it fits nowhere and all
places are taken, the fullest sequence closes.

Null or empty text: the end id alone.  Repeated rows are packed each; null ids
too; rows that tie in the order of a group are alike.  A very long text is cut in
pieces like any other; its task holds all of its ids, some 40 bytes a token.  An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Workspace

CAPACITY = 1024
END_ID = 2
OPEN = 64
GROUP = 20_000
VOCABULARY = "byte_bpe_50k"

_loaded: dict = {}


class Encoder:
    """Ids of a byte-level BPE vocabulary file, by ``tokenizers``.

    Texts of Latin letters only (all code points below U+0250) take the same
    vocabulary's rank table, which gives the same ids several times faster.
    Its pattern looks ahead after white space and recurs once a character, so
    texts with a long run of white space take ``tokenizers`` as well.
    """

    SPECIAL = "<|endoftext|>"
    LONG_GAP = re.compile(r"\s{1000}")

    def __init__(self, name: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if (text.isascii() or max(text) < "ɐ") and self.SPECIAL not in text and not self.LONG_GAP.search(text):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


def encoder(name: str = VOCABULARY) -> Encoder:
    if name not in _loaded:
        _loaded[name] = Encoder(name)
    return _loaded[name]


def cuts(n: int, capacity: int) -> list[int]:
    """Where the pieces of n tokens begin, and n."""
    return [0, *range(n % capacity or capacity, n, capacity), n]


def tokenize(docs: DataFrame, *, key: str, text: str, capacity: int, end_id: int, vocabulary: str, with_ids: bool) -> DataFrame:
    def run(batches):
        enc = encoder(vocabulary)
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.array([*enc.ids(t or ""), end_id], "<u4")
                at = cuts(len(ids), capacity)
                for i, (lo, hi) in enumerate(zip(at, at[1:], strict=False)):
                    raw = ids[lo:hi].tobytes()
                    rows.append((k, i, lo, hi - lo, zlib.crc32(raw), raw if with_ids else None))
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(c, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                    names=["k", "piece", "start", "length", "ids_crc32", "ids"],
                )

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, "k long, piece int, start long, length long, ids_crc32 long, ids binary")


class BestFit:
    """Online best-fit with at most ``most`` open sequences."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.spaces = 0  # bit s: a sequence with s tokens free is open
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.next = 0

    def _take(self, space: int) -> int:
        bins = self.at[space]
        sequence = bins.pop()
        if not bins:
            self.spaces &= ~(1 << space)
        self.open -= 1
        return sequence

    def put(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece."""
        fitting = self.spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            sequence = self._take(space)
        else:
            sequence, space = self.next, self.capacity
            self.next += 1
        rest = space - length
        if rest:
            if self.open == self.most:
                fullest = (self.spaces & -self.spaces).bit_length() - 1
                if fullest >= rest:  # the piece's own sequence is the fullest: it closes
                    return sequence, self.capacity - space
                self._take(fullest)
            self.at[rest].append(sequence)
            self.spaces |= 1 << rest
            self.open += 1
        return sequence, self.capacity - space


def pack(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY,
    open_sequences: int = OPEN, group: int = GROUP, with_ids: bool = False,
) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset), and ``ids`` (little-endian 32-bit) if asked."""
    work = Workspace(docs.sparkSession, "packing")
    pieces = work.save(tokenize(docs, key=key, text=text, capacity=capacity, end_id=end_id, vocabulary=vocabulary, with_ids=with_ids), "pieces")
    groups = max(1, round(pieces.count() / group))
    order = F.xxhash64("k", "piece", "ids_crc32")
    columns = ["k", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    dealt = (
        pieces.select(*columns, order.alias("o")).withColumn("g", F.pmod("o", F.lit(groups)).cast("int"))
        .repartitionById(groups, F.col("g")).sortWithinPartitions("g", "o", "k", "piece")
    )

    def run(batches):
        group_no, fit = None, None
        for b in batches:
            place = []
            for g, n in zip(b.column("g").to_pylist(), b.column("length").to_pylist(), strict=True):
                if g != group_no:
                    group_no, fit = g, BestFit(capacity, open_sequences)
                s, o = fit.put(n)
                place.append(((g << 32) + s, o))
            s, o = zip(*place, strict=True) if place else ((), ())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(s, pa.int64()), pa.array(o, pa.int64())], names=[*columns, "sequence_id", "offset"])

    schema = "k long, piece int, start long, length long, ids_crc32 long, " + ("ids binary, " if with_ids else "") + "sequence_id long, offset long"
    return dealt.mapInArrow(run, schema).withColumnRenamed("k", key)
