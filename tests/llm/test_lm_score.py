"""The bidirectional window network against plain counts and formulas, and what its scores are worth."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import lm_score, queries
from ledgerloom.llm.common import texts_of

SF = "/root/testdata/sf0.01"
SIDE = lm_score.SIDE


def plain_windows(text):
    """(left bytes, right bytes, token) of every byte, one after the other."""
    b = [lm_score.EDGE] * SIDE + list((text or "").encode()) + [lm_score.EDGE] * SIDE
    return [(*b[i - SIDE : i], *b[i + 1 : i + SIDE + 1], b[i]) for i in range(SIDE, len(b) - SIDE)]


def packed(window):
    return sum(v << 8 * (len(window) - 1 - i) for i, v in enumerate(window))


def plain_log_probability(net, window):
    """By the definition, one window: softmax of the group, then of the byte in it."""
    e, hidden, wg, bg, wt, bt = net.parts
    if window[-1] not in net.alphabet:
        return lm_score.UNSEEN
    place = list(net.alphabet).index(window[-1])
    inputs = net._inputs(np.array([[v] for v in window[:-1]], np.uint8))
    x = sum(e[i][index[0]].astype(float) for i, index in enumerate(inputs)) + hidden
    h = x / (1 + abs(x))
    out = 0.0
    for w, b, at in ((wg, bg, place // net.size), (wt[place // net.size], bt[place // net.size], place % net.size)):
        z = h @ w.astype(float) + b
        out += z[at] - math.log(sum(math.exp(v) for v in z))
    return out


TEXTS = ["the cat sat on the mat and the dog sat on the log ", "", None, "é€x", "a", "the cat"]


def test_windows(monkeypatch):
    want = [(d, packed(w)) for d, t in enumerate(TEXTS) for w in plain_windows(t)]
    for size in (lm_score.SLICE, 7):
        monkeypatch.setattr(lm_score, "SLICE", size)
        got = [(int(d), int(c)) for doc, code in lm_score.windows(texts_of(pa.array(TEXTS))) for d, c in zip(doc, code, strict=True)]
        assert got == want


def test_grouped_windows():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 300, 5000).astype(np.uint64) << np.uint64(40)
    distinct, inverse = lm_score.grouped(codes)
    assert np.array_equal(distinct[inverse], codes) and set(distinct.tolist()) == set(codes.tolist())


def test_counts_of_the_corpus(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS * 2], "text string").repartition(3)
    got = Counter()
    for r in lm_score.window_counts(docs, 3).collect():
        for c, n in zip(np.frombuffer(r.codes, np.uint64), np.frombuffer(r.counts, np.int64), strict=True):
            got[int(c)] += int(n)
    assert got == Counter(packed(w) for t in TEXTS * 2 for w in plain_windows(t))


def test_query_by_the_definition(spark, tmp_path):
    """The registered query on odd rows: every score is the sum over all bytes of the plain log-probability."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, "the mat")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    net = lm_score.fit(docs)
    out = queries.op10_lm_score(spark, str(tmp_path)).collect()
    assert len(out) == len(TEXTS) + 2
    texts = dict(enumerate(TEXTS)) | {None: "the mat"}
    for r in out:
        windows = plain_windows(texts[r.doc_id])
        assert r.n_tokens == len(windows)
        assert r.pll == pytest.approx(sum(plain_log_probability(net, w) for w in windows), rel=1e-3, abs=1e-3)
        assert (r.mean_pll is None) == (not windows)
    other = spark.createDataFrame([(1, "\x01\x02")], "doc_id long, text string")
    assert lm_score.score(other, net).first().pll == 2 * lm_score.UNSEEN


def test_training_takes_every_window(monkeypatch):
    rng = np.random.default_rng(4)
    codes = np.unique(rng.integers(0, 1 << 30, 9000).astype(np.uint64))
    counts = np.ones(len(codes), np.int64)
    counts[:3] = 1_000_000, 50_000, 7
    seen = []
    monkeypatch.setattr(lm_score, "split", lambda c, whole=lm_score.split: (seen.append(c), whole(c))[1])
    lm_score.Network(np.arange(256)).train(codes, counts, 1, 0.02, 5)
    assert np.array_equal(np.unique(np.concatenate(seen)), codes)
    entry, weight = lm_score.entries(counts)
    share = np.bincount(entry, weights=weight)
    assert np.allclose(share / share.sum(), counts / counts.sum(), rtol=1e-4)


def test_gradient(monkeypatch):
    """One step of plain descent lowers the loss as its gradient says."""
    rng = np.random.default_rng(3)
    codes = np.array([packed(w) for w in plain_windows(TEXTS[0] * 3)], np.uint64)
    counts = rng.integers(1, 4, len(codes))
    net = lm_score.Network(np.unique(codes.astype(np.uint8)))
    before = (net.log_probability(codes) * counts).sum() / counts.sum()
    net.train(codes, counts, 60, 0.05, 1)
    assert (net.log_probability(codes) * counts).sum() / counts.sum() > before + 1


def test_scores_are_worth_something(spark):
    """Held-out text comes near the empirical entropy given four neighbours; scrambled and junk text score below prose."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 400")
    net = lm_score.fit(docs.where("doc_id % 10 <> 0"))
    held = docs.where("doc_id % 10 = 0 and source <> 'junk'").select("doc_id", "text").collect()
    tokens, contexts = Counter(), Counter()
    for r in held:
        for w in plain_windows(r.text):
            near = w[1:5]
            tokens[near, w[-1]] += 1
            contexts[near] += 1
    four = -sum(n * math.log(n / contexts[c]) for (c, _), n in tokens.items()) / sum(tokens.values())
    rng = random.Random(2)

    def scrambled(text):
        words = text.split()
        return " ".join("".join(rng.sample(w, len(w))) for w in rng.sample(words, len(words)))

    def kinds(r):
        yield "prose", r.text
        yield "scrambled", scrambled(r.text)
        yield "digits", "".join(rng.choice("0123456789 ") for _ in range(400))
        yield "foreign", "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(150))

    rows = [(r.doc_id, k, t) for r in held for k, t in kinds(r)]
    frame = spark.createDataFrame(rows, "doc_id long, kind string, text string").withColumn("row", F.monotonically_increasing_id())
    out = lm_score.score(frame, net, key="row").withColumnRenamed("row", "r")
    by = {(r.doc_id, r.kind): r.mean_pll for r in frame.join(out, F.col("row") == F.col("r")).collect()}
    prose = {d: v for (d, k), v in by.items() if k == "prose"}
    for kind in ("scrambled", "digits", "foreign"):
        assert sum(by[d, kind] < v for d, v in prose.items()) >= 0.95 * len(prose), kind
    total = lm_score.score(docs.where("doc_id % 10 = 0 and source <> 'junk'"), net).agg(F.sum("pll"), F.sum("n_tokens")).first()
    assert -total[0] / total[1] < four + 0.4
