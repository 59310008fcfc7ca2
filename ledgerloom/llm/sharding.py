"""Sharding by a Feistel permutation over global row numbers.

Rows get dense numbers 0..n-1 in a total order (id, then digest, then size), a
keyed Feistel network with cycle walking permutes the numbers, and a row's
place follows from its permuted number alone: ``shard = p % shards``,
``slot = p // shards``.  Shard sizes in rows thus differ by one at most, slots
have no gaps, and the place of any row number can be computed without the
table (``place``), backwards too (``row_at``).

Only ids, sizes and digests are shuffled.  Numbers come from a range partition
with one count per partition, never from one task holding all rows.

Null text: size 8, digest of the empty text.  Rows that are equal in id and
text are interchangeable and get different slots.  Null ids come first.  An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Workspace, mix64, shuffle_partitions

ROUNDS = 6


class Feistel:
    """A keyed permutation of 0..n-1."""

    def __init__(self, n: int, seed: int = 2024, rounds: int = ROUNDS):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = mix64(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

    def _once(self, x: np.ndarray, keys) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in keys:
            left, right = right, left ^ (mix64(right ^ k) & self.mask)
        return (right << np.uint64(self.half)) | left

    def _walk(self, x: np.ndarray, keys) -> np.ndarray:
        """The domain has under 4n numbers, so a few steps bring every number back below n."""
        out = self._once(np.asarray(x, np.uint64), keys)
        while len(away := np.flatnonzero(out >= np.uint64(self.n))):
            out[away] = self._once(out[away], keys)
        return out.astype(np.int64)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys)

    def backward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys[::-1])


def place(row: int, n: int, shards: int, seed: int = 2024) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = int(Feistel(n, seed).forward(np.array([row]))[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 2024) -> int:
    """Row number at a place."""
    return int(Feistel(n, seed).backward(np.array([slot * shards + shard]))[0])


def number_rows(df: DataFrame, order: list[str], work: Workspace, name: str = "numbered") -> tuple[DataFrame, int]:
    """``df`` with dense ``row_no`` in the given total order, and the row count.

    The partition number and the place in it are written with the rows, so the
    numbering stays fixed however often later tasks run.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    kept = work.save(ranged.withColumn("_mid", F.monotonically_increasing_id()), name)
    part = F.shiftright("_mid", 33)
    counts = kept.groupBy(part.alias("p")).count().orderBy("p").collect()  # one row a partition
    firsts = [0, *accumulate(r["count"] for r in counts)]
    starts = spark.createDataFrame([(r["p"], first) for r, first in zip(counts, firsts, strict=False)], "_part long, _first long")
    numbered = kept.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("row_no", F.col("_first") + F.col("_mid").bitwiseAND((1 << 33) - 1))
    return numbered.drop("_mid", "_part", "_first"), firsts[-1]


def shard_rows(docs: DataFrame, shards: int, *, key: str = "doc_id", text: str = "text", seed: int = 2024) -> DataFrame:
    """(key, size, text_crc32, row_no, shard, slot) for every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias(key), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    work = Workspace(docs.sparkSession, "shards")
    numbered, n = number_rows(rows, [key, "text_crc32", "size"], work)

    @F.pandas_udf("long")
    def permuted(row: pd.Series) -> pd.Series:
        return pd.Series(Feistel(n, seed).forward(row.to_numpy()))

    return numbered.withColumn("_p", permuted("row_no")).select(
        key, "size", "text_crc32", "row_no", (F.col("_p") % shards).cast("int").alias("shard"), F.floor(F.col("_p") / shards).cast("long").alias("slot")
    )
