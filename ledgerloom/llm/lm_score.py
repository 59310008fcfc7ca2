"""Language-model scores by masked pseudo-likelihood.

Tokens are the UTF-8 bytes as they are.  A network with one hidden layer predicts
every token from the ``SIDE`` bytes on either side, never from itself; a document's
score is the sum of the log-probabilities of its tokens.  Its inputs are embeddings
of three hashed runs of bytes: the left side, the right side, and the two nearest.
The softmax is over the bytes that the corpus holds; another byte, met only in
texts that were not trained on, has the log-probability ``UNSEEN``.

Training sees all documents: each task reports its distinct windows with counts,
the counts are summed by window, and replicas of the network (one a bucket of
windows, as many as shuffle partitions; numpy and Adam) start from the same weights
every round, take whole passes over their windows weighted by count, and are
averaged by the weight of their windows.  So steps grow with the distinct windows
and no task with the number of tasks.  Weights are summed in blocks before they
reach the driver, which only ever holds one network.  Scoring evaluates each run's
distinct windows once.

Null or empty text: no tokens and score 0, mean null.  Null ids stay null.  Repeated
rows are scored each, alike, and count in training.  Without any token the untrained
network is used.  A very long text is read in slices: beside its bytes a task holds
the windows of one slice.  Other columns are ignored whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Texts, Workspace, batch, binary_array, chunks, mix64, shuffle_partitions
from ledgerloom.llm.postings import _bytes

SIDE = 3
HIDDEN = 24
#: Rows of an embedding table.
RUNS = 1 << 12
UNSEEN = -20.0
ROUNDS = 2
#: Least mini-batches of all replicas together in a round: small tables take several passes.
STEPS = 400
BATCH = 8192
RATE = 0.03
#: Windows made at once, and distinct ones kept by a task before it reports them.
SLICE, TABLE = 1 << 22, 1 << 22
#: Weights summed in one row.
BLOCK = 1 << 13

#: Stands for what is outside of a document; never a byte of UTF-8.
EDGE = 0xFF
PLACES = 2 * SIDE
ROWS = 1 << 16


def windows(texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, window) of every token, slice by slice; a window is one number, its bytes in order, the token last."""
    n = len(texts)
    pad = np.full(len(texts.data) + SIDE * (n + 1), EDGE, np.uint8)
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(texts.offsets))
    at = np.arange(len(texts.data)) + SIDE * (doc + 1)
    pad[at] = texts.data
    for lo in range(0, len(at), SLICE):
        here = at[lo : lo + SLICE]
        first, last = here[0], here[-1] + 1
        code = np.zeros(last - first, np.uint64)
        for o in [*range(-SIDE, 0), *range(1, SIDE + 1), 0]:
            code <<= np.uint64(8)
            code |= pad[first + o : last + o]
        yield doc[lo : lo + SLICE], code[here - first]


def split(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours by place, token) of windows."""
    b = codes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 7 - PLACES :]
    return np.ascontiguousarray(b[:, :PLACES].T), b[:, PLACES]


def _run(places: np.ndarray) -> np.ndarray:
    h = np.zeros(places.shape[1], np.uint32)
    for p in places:
        h = (h + p) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h % np.uint32(RUNS)).astype(np.uint16)


def _logits(h: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of which no exponential overflows; entries of ``h`` are below 1."""
    z = h @ w
    z += b
    if (np.abs(w).sum(axis=0) + np.abs(b)).max() > 80:
        z -= z.max(axis=1, keepdims=True)
    return z


class Network:
    """Embeddings of runs, summed; x / (1 + |x|); softmax over groups of the alphabet, then inside the group."""

    def __init__(self, alphabet: np.ndarray, flat: np.ndarray | None = None, seed: int = 11):
        self.alphabet = np.asarray(alphabet, np.uint8)
        self.size = size = max(1, int(np.ceil(len(self.alphabet) ** 0.5)))
        self.place = np.full(256, -1)
        self.place[self.alphabet] = np.arange(len(self.alphabet))
        self.shapes = [(3, RUNS, HIDDEN), (HIDDEN,), (HIDDEN, size), (size,), (size, HIDDEN, size), (size, size)]
        if flat is None:
            rng = np.random.default_rng(seed)
            parts = [rng.standard_normal(s) * k for s, k in zip(self.shapes, (0.2, 0, 0.3, 0, 0.3, 0), strict=True)]
            parts[5].ravel()[len(self.alphabet) :] = -30  # no byte there
            flat = np.concatenate([p.ravel() for p in parts])
        self.flat = np.asarray(flat, np.float32).copy()
        self.parts = self._cut(self.flat)

    def __reduce__(self):
        return Network, (self.alphabet, self.flat)

    def _cut(self, flat: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for s in self.shapes:
            size = int(np.prod(s))
            out.append(flat[at : at + size].reshape(s))
            at += size
        return out

    @staticmethod
    def _inputs(context: np.ndarray) -> list[np.ndarray]:
        return [_run(context[:SIDE]), _run(context[SIDE:]), _run(context[SIDE - 1 : SIDE + 1])]

    def _hidden(self, inputs: list[np.ndarray]) -> np.ndarray:
        h = self.parts[0][0].take(inputs[0], axis=0)
        for i, index in enumerate(inputs[1:], 1):
            h += self.parts[0][i].take(index, axis=0)
        h += self.parts[1]
        scale = np.abs(h)
        scale += 1
        h /= scale
        return h

    def _grouped(self, codes: np.ndarray):
        """Order by the token's group; inputs, place in the group and the groups' bounds in that order."""
        context, token = split(codes)
        group, inside = np.divmod(self.place[token], self.size)
        order = np.argsort(group.astype(np.uint8), kind="stable")
        group, inside = group[order], inside[order]
        return order, self._inputs(context[:, order]), group, inside, np.searchsorted(group, np.arange(self.size + 1))

    def log_probability(self, codes: np.ndarray, step: int = 1 << 13) -> np.ndarray:
        out = np.full(len(codes), UNSEEN)
        known = np.flatnonzero(self.place[(codes & np.uint64(255)).astype(np.intp)] >= 0)
        _, _, wg, bg, wt, bt = self.parts
        ones = np.ones(self.size, np.float32)
        for i in range(0, len(known), step):
            some = known[i : i + step]
            order, inputs, group, inside, bounds = self._grouped(codes[some])
            h = self._hidden(inputs)
            z = _logits(h, wg, bg)
            lp = z[np.arange(len(some)), group]
            lp -= np.log(np.exp(z, out=z) @ ones)
            for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
                if hi > lo:
                    z = _logits(h[lo:hi], wt[k], bt[k])
                    lp[lo:hi] += z[np.arange(hi - lo), inside[lo:hi]]
                    lp[lo:hi] -= np.log(np.exp(z, out=z) @ ones)
            out[some[order]] = lp
        return out

    def train(self, codes: np.ndarray, counts: np.ndarray, steps: int, rate: float, seed: int) -> None:
        """Adam on whole passes over the windows, one pass and ``steps`` mini-batches at least; the rate falls to a tenth."""
        rng = np.random.default_rng(seed)
        entry, weight = entries(counts)
        batches = -(-len(entry) // BATCH)
        passes = max(1, -(-steps // batches))
        grad, mean, var = (np.zeros_like(self.flat) for _ in range(3))
        t = 0
        g_run, g_hidden, g_wg, g_bg, g_wt, g_bt = self._cut(grad)
        _, _, wg, bg, wt, bt = self.parts
        for _ in range(passes):
            for some in np.array_split(rng.permutation(len(entry)), batches):
                t += 1
                order, inputs, group, inside, bounds = self._grouped(codes[entry[some]])
                share = (weight[some][order] / len(some))[:, None]
                h = self._hidden(inputs)

                def off(p, at, share):
                    """Gradient at the logits."""
                    np.exp(p, out=p)
                    p /= p.sum(axis=1, keepdims=True)
                    p[np.arange(len(p)), at] -= 1
                    p *= share
                    return p

                grad[:] = 0
                p = off(_logits(h, wg, bg), group, share)
                g_wg[:], g_bg[:] = h.T @ p, p.sum(axis=0)
                dh = p @ wg.T
                for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    if hi > lo:
                        p = off(_logits(h[lo:hi], wt[k], bt[k]), inside[lo:hi], share[lo:hi])
                        g_wt[k], g_bt[k] = h[lo:hi].T @ p, p.sum(axis=0)
                        dh[lo:hi] += p @ wt[k].T
                dh *= np.square(1 - np.abs(h))
                g_hidden[:] = dh.sum(axis=0)
                for i, index in enumerate(inputs):
                    by = np.argsort(index, kind="stable")
                    index = index[by]
                    first = np.flatnonzero(np.diff(index, prepend=index[:1] + np.uint16(1)))
                    g_run[i][index[first]] = np.add.reduceat(dh[by], first)
                mean += 0.1 * (grad - mean)
                var += 0.01 * (grad * grad - var)
                now = rate * (1 - 0.9 * t / (passes * batches))
                self.flat -= now / (1 - 0.9**t) * mean / (np.sqrt(var / (1 - 0.99**t)) + 1e-8)


def entries(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, weight) of one pass: every window, by its count, mean weight 1.

    A window above the mean count is dealt out as several equal entries, so no
    entry outweighs a batch; there are at most twice as many entries as windows.
    """
    shares = np.ceil(counts / counts.mean()).astype(np.int64)
    entry = np.repeat(np.arange(len(counts)), shares)
    weight = (counts / shares)[entry]
    return entry, (weight / weight.mean()).astype(np.float32)


def grouped(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows, some twice at most by chance, and the place of each window among them.

    One sort of numbers: the upper bits a hash of the window, the lower its place.
    """
    bits = np.uint64(max(1, len(codes).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    key = (codes * np.uint64(0x9E3779B97F4A7C15)) & ~mask
    key |= np.arange(len(codes), dtype=np.uint64)
    key.sort()
    key &= mask
    order = key.view(np.int64)
    codes = codes[order]
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    inverse = np.empty(len(codes), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    return codes[new], inverse


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1]]))
    return codes[first], np.diff(np.append(first, len(codes)))


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Summed counts of several sorted tables."""
    if len(parts) == 1:
        return parts[0]
    codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts[order], first) if len(first) else counts


class _Table:
    """Distinct windows with counts; merged when what came since outweighs the table."""

    def __init__(self):
        self.parts, self.new = [], 0

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((codes, counts.astype(np.int64)))
        self.new += len(codes)
        if self.new > max(1 << 21, len(self.parts[0][0])):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            self.parts = [_merged(self.parts)]
        self.new = 0
        return self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def __len__(self) -> int:
        return sum(len(c) for c, _ in self.parts)


def window_counts(rows: DataFrame, replicas: int) -> DataFrame:
    """(replica, codes, counts, m0 .. m3): all distinct windows of the corpus, packed, each with its count; bits of the tokens met."""

    def packed(table: _Table):
        codes, counts = table.merge()
        at = mix64(codes) % np.uint64(replicas)
        order = np.argsort(at, kind="stable")
        codes, counts, at = codes[order], counts[order], at[order]
        first = np.append(np.flatnonzero(np.diff(at, prepend=np.uint64(replicas))), len(at))
        if len(codes):
            yield batch(replica=pa.array(at[first[:-1]].astype(np.int32)), codes=binary_array(codes, first * 8), counts=binary_array(counts, first * 8))

    def read(batches):
        table = _Table()
        for b in batches:
            for _, texts in chunks(b, most=SLICE, rows=ROWS):
                for _, codes in windows(texts):
                    table.add(*_distinct(codes))
                if len(table) > TABLE:
                    table.merge()
                if len(table) > TABLE:
                    yield from packed(table)
                    table = _Table()
        yield from packed(table)

    def summed(batches):
        have: dict[int, _Table] = {}
        for b in batches:
            for i, r in enumerate(b.column("replica").to_pylist()):
                have.setdefault(r, _Table()).add(_bytes(b.column("codes").slice(i, 1)).copy().view(np.uint64), _bytes(b.column("counts").slice(i, 1)).copy().view(np.int64))
        for r, table in sorted(have.items()):
            codes, counts = table.merge()
            step = 1 << 17
            for i in range(0, len(codes), step):
                c = codes[i : i + step]
                tokens = np.bincount((c & np.uint64(255)).astype(np.intp), minlength=256) > 0
                yield batch(
                    replica=pa.array([r], pa.int32()), codes=pa.array([c.tobytes()], pa.binary()), counts=pa.array([counts[i : i + step].tobytes()], pa.binary()),
                    **{f"m{k}": pa.array(np.packbits(tokens[64 * k : 64 * k + 64], bitorder="little").view(np.int64)) for k in range(4)},
                )

    schema = "replica int, codes binary, counts binary"
    masks = ", ".join(f"m{k} long" for k in range(4))
    return rows.mapInArrow(read, schema).repartitionById(replicas, F.col("replica")).mapInArrow(summed, f"{schema}, {masks}")


def _trained(counts: DataFrame, start: Network, replicas: int, steps: int, rate: float, seed: int) -> DataFrame:
    """(block, w): the mean of the replicas' weights, weighted by their windows, in blocks."""

    def run(batches):
        codes, counts, replica = [], [], 0
        for b in batches:
            for i, replica in enumerate(b.column("replica").to_pylist()):
                codes.append(np.frombuffer(b.column("codes")[i].as_py(), np.uint64))
                counts.append(np.frombuffer(b.column("counts")[i].as_py(), np.int64))
        if codes:
            codes, counts = np.concatenate(codes), np.concatenate(counts)
            net = Network(start.alphabet, start.flat)
            net.train(codes, counts, -(-steps // replicas), rate, seed + replica)
            cut = range(0, len(net.flat), BLOCK)
            yield batch(
                block=pa.array(range(len(cut)), pa.int32()), replica=pa.array([replica] * len(cut), pa.int32()),
                w=pa.array([net.flat[i : i + BLOCK].tobytes() for i in cut], pa.binary()), n=pa.array([float(counts.sum())] * len(cut)),
            )

    def mean(batches):
        sums: dict[int, list] = {}
        for b in batches:
            for block, w, n in zip(*(b.column(c).to_pylist() for c in ("block", "w", "n")), strict=True):
                s = sums.setdefault(block, [0.0, 0.0])
                s[0], s[1] = s[0] + n * np.frombuffer(w, np.float32).astype(np.float64), s[1] + n
        for block, (w, n) in sums.items():
            yield batch(block=pa.array([block], pa.int32()), w=pa.array([(w / n).astype(np.float32).tobytes()], pa.binary()))

    dealt = counts.select("replica", "codes", "counts").repartitionById(replicas, F.col("replica")).sortWithinPartitions("replica", "codes")
    own = dealt.mapInArrow(run, "block int, replica int, w binary, n double")
    return own.repartitionById(-(-len(start.flat) // BLOCK), F.col("block")).sortWithinPartitions("block", "replica").mapInArrow(mean, "block int, w binary")


def fit(docs: DataFrame, *, text: str = "text", replicas: int | None = None, rounds: int = ROUNDS, steps: int = STEPS) -> Network:
    """A network trained on all documents."""
    spark = docs.sparkSession
    replicas = replicas or shuffle_partitions(spark)
    work = Workspace(spark, "lm")
    counts = work.save(window_counts(docs.select(F.col(text).alias("text")), replicas), "windows")
    masks = counts.agg(*(F.bit_or(f"m{k}").alias(f"m{k}") for k in range(4))).first()
    met = np.unpackbits(np.array([m or 0 for m in masks], np.int64).view(np.uint8), bitorder="little")
    net = Network(np.flatnonzero(met))
    for r in range(rounds):
        blocks = _trained(counts, net, replicas, steps, RATE * 0.5**r, 1000 * r).collect()  # one network
        if blocks:
            net = Network(net.alphabet, np.concatenate([np.frombuffer(b["w"], np.float32) for b in sorted(blocks, key=lambda b: b["block"])]))
    work.drop()
    return net


def score(docs: DataFrame, net: Network, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, pll, mean_pll, perplexity) for every row."""

    def run(batches):
        for b in batches:
            for part, texts in chunks(b, most=SLICE, rows=ROWS):
                n, total = np.diff(texts.offsets), np.zeros(len(texts))
                for doc, codes in windows(texts):
                    distinct, inverse = grouped(codes)
                    total += np.bincount(doc, weights=net.log_probability(distinct)[inverse], minlength=len(texts))
                mean = total / np.maximum(n, 1)
                none = n == 0
                yield batch(k=part.column("k"), n_tokens=pa.array(n), pll=pa.array(total), mean_pll=pa.array(mean, mask=none), perplexity=pa.array(np.exp(-mean), mask=none))

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "k long, n_tokens long, pll double, mean_pll double, perplexity double").withColumnRenamed("k", key)
