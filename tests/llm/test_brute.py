"""Registered queries against plain versions that follow the definitions word by word."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import decontam, packing, queries, simhash
from ledgerloom.llm.common import texts_of


def _write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(path))


def _bits(text):
    return np.unpackbits(simhash.fingerprints(texts_of(pa.array([text])))[0]).astype(int)


def _print(text):
    """Every run of five words votes with the signs of its own hash: the fingerprint of that run alone."""
    words = (text or "").split()
    terms = [words[i : i + 5] for i in range(len(words) - 4)] or ([words] if words else [])
    votes = sum((2 * _bits(" ".join(t)) - 1 for t in terms), np.zeros(simhash.BITS, int))
    return np.packbits(votes > 0).tobytes().hex()


def _distance(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def test_simhash_query(spark, tmp_path):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 6))) for _ in range(n))
    base = prose(80)
    texts = [base, base, base + " tail of three", None, "", "two words", "x", prose(12), "é€ " + prose(30)]
    rows = [(20 * i if i % 2 else 20 * i + 7, t) for i, t in enumerate(texts)]
    _write(spark, tmp_path / "documents.parquet", rows, "doc_id long, text string")
    got = {r.doc_id: r for r in queries.op1_simhash(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    rows.sort()
    prints = {i: _print(t) for i, t in rows}
    for (i, t), (j, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, following, r = t or "", following or "", got[i]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut] if cut else t
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (prints[i], _print(edited))
        assert r.near_edited == 1 - _distance(r.fingerprint, r.edited_fingerprint) / simhash.BITS
        assert r.near_next == 1 - _distance(prints[i], prints[j]) / simhash.BITS
        if i % 20 == 0:
            near = [k for k in prints if k != i and _distance(prints[i], prints[k]) <= simhash.RADIUS]
            assert r.n_in_radius == len(near) and {n.doc_id for n in r.near} <= {*near, i}
        else:
            assert r.n_in_radius is None


def _fold(text):
    return bytes(decontam._FOLD[np.frombuffer((text or "").encode(), np.uint8)])


def _least_edits(pattern, text):
    """Least edits of the pattern against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, c in enumerate(text):
            new.append(min(row[j] + (p != c), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination_query(spark, tmp_path):
    rng = random.Random(5)
    prose = lambda n: "".join(rng.choice("abcdefghij  ") for _ in range(n))
    items = [(1, prose(90)), (2, prose(64)), (3, prose(30)), (4, "short"), (5, None)]

    def changed(text, edits):
        text = list(text)
        for _ in range(edits):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[], ["z"], [text[at], "z"]])
        return "".join(text)

    docs = [(i, prose(60) + changed(items[i % 3][1], i // 3).upper() + prose(50)) for i in range(18)]
    docs += [(100, prose(200)), (101, None), (102, items[0][1][:70]), (103, items[0][1][10:60]), (103, items[2][1])]
    _write(spark, tmp_path / "documents.parquet", docs, "doc_id long, text string")
    _write(spark, tmp_path / "benchmark.parquet", items, "item_id long, text string")
    want = {}
    for item, text in items:
        b = _fold(text)
        if len(b) < decontam.Q:
            continue
        starts = {*range(0, max(1, len(b) - decontam.SEGMENT + 1), decontam.STRIDE), max(0, len(b) - decontam.SEGMENT)}
        for i, t in docs:
            for s in starts:
                segment = b[s : s + decontam.SEGMENT]
                most = min(int(len(segment) * decontam.EDITS), (len(segment) - decontam.Q) // decontam.Q)
                edits = _least_edits(segment, _fold(t)) if t else 99
                if edits <= most:
                    want[i, item] = min(want.get((i, item), 99), edits)
    got = {(r.doc_id, r.item_id): r.edits for r in queries.op6_decontam(spark, str(tmp_path)).collect()}
    assert got == want and len(want) >= 10


class PlainFit:
    """Open bins as a list: the least sufficient space, else a new bin; at the limit the fullest bin closes."""

    def __init__(self, capacity, most):
        self.capacity, self.most, self.open, self.sizes = capacity, most, [], []

    def put(self, n):
        fitting = [b for b in self.open if self.capacity - self.sizes[b] >= n]
        if fitting:
            least = min(self.capacity - self.sizes[b] for b in fitting)
            b = [b for b in fitting if self.capacity - self.sizes[b] == least][-1]
            self.open.remove(b)
        else:
            b = len(self.sizes)
            self.sizes.append(0)
        at, self.sizes[b] = self.sizes[b], self.sizes[b] + n
        if self.sizes[b] < self.capacity:
            if len(self.open) == self.most:
                fullest = max(self.sizes[x] for x in self.open)
                if self.sizes[b] >= fullest:
                    return b, at
                self.open.remove([x for x in self.open if self.sizes[x] == fullest][-1])
            self.open.append(b)
        return b, at


@pytest.mark.parametrize("capacity,most", [(16, 1), (16, 3), (64, 8), (1024, 64)])
def test_best_fit(capacity, most):
    """Every piece gets the place the plain version gives it; of bins with equal space the last one touched."""
    rng = random.Random(capacity)
    fit, plain = packing.BestFit(capacity, most), PlainFit(capacity, most)
    for _ in range(3000):
        n = rng.randint(1, capacity)
        assert fit.put(n) == plain.put(n)
    assert fit.open == len(plain.open) <= most
