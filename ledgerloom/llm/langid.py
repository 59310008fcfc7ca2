"""Language identification in two steps: family, then language within the family.

Texts become hashed counts of byte runs of 1 to 3 (A-Z lower-cased), square
roots, scaled to length one.  One linear support vector machine a family, one
against the rest, picks the family; inside it, machines for every pair of
languages vote.  All are trained in numpy on a bounded sample of labelled rows
(at most ``per_language`` distinct rows a language and ``MOST_ROWS`` in all, chosen
by a hash of id and text); their features, not their texts, reach the driver.
Prediction reads whole texts and nothing else.  Machines' margins are turned to
probabilities on the training sample, and the score is the family's times the
winner's least pairwise probability.

Null text and text without a letter: ``und`` with score 0; so is everything if
no labelled row exists.  Null ids are in no held-out part.  Each repeated row is
predicted and trains once; equal votes go to the surer machine, then to the lesser
code.  A very long text is counted slice by slice.  Other columns are ignored
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import LOWER, Texts, batch, binary_array, chunks, map_texts, texts_of

DIM_BITS = 12
#: Bounds of the training sample: 16 KB a row on the driver.
PER_LANGUAGE, MOST_ROWS = 600, 4800
#: Rows and bytes whose features are made at once.
ROWS, SLICE = 256, 1 << 21
UND = "und"

#: Families of ISO 639-1 codes; others are families of their own.
FAMILIES = {
    "germanic": "af da de en is nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "turkic": "az kk ky tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
    "uralic": "et fi hu",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], lang)


def features(texts: Texts) -> np.ndarray:
    """One row a document; runs across a border are not counted."""
    out = np.empty((len(texts), 1 << DIM_BITS), np.float32)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(texts.offsets, texts.offsets[lo] + SLICE, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + ROWS, len(texts))
        begin, end = int(texts.offsets[lo]), int(texts.offsets[hi])
        if end - begin <= SLICE:
            counts = _counts(Texts(texts.data[begin:end], texts.offsets[lo : hi + 1] - begin))
        else:  # one very long text
            counts = np.zeros((1, out.shape[1]))
            for a in range(begin, end, SLICE):
                counts += _counts(Texts(texts.data[a : min(a + SLICE + 2, end)], np.array([0, min(a + SLICE + 2, end) - a])), most=SLICE)
        out[lo:hi] = np.sqrt(counts)
        lo = hi
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _counts(texts: Texts, most: int | None = None) -> np.ndarray:
    """Hashed counts of the runs that begin in the first ``most`` bytes."""
    n, dim = len(texts), 1 << DIM_BITS
    data = LOWER[texts.data].astype(np.uint32)
    doc = np.repeat(np.arange(n, dtype=np.int64) << DIM_BITS, np.diff(texts.offsets))
    left = np.repeat(texts.offsets[1:], np.diff(texts.offsets)) - np.arange(len(data))
    out = np.zeros(n * dim)
    code = np.zeros(len(data), np.uint32)
    for size in (1, 2, 3):
        code = code[: len(data) - size + 1] * np.uint32(0x01000193) + data[size - 1 :] + np.uint32(size)
        if not len(code):
            break
        slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIM_BITS)
        inside = left[: len(code)] >= size
        if most is not None:
            inside[most:] = False
        out += np.bincount((doc[: len(code)] + slot)[inside], minlength=n * dim)
    return out.reshape(n, dim)


def _svm(x: np.ndarray, y: np.ndarray, epochs: int = 12, strength: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Weights of a linear machine for labels +1 and -1 (mini-batch Pegasos), bias last."""
    rng = np.random.default_rng(seed)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    # either class weighs half
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    w, mean, step = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
            step += 1
            rate = 1 / (strength * (step + 100))
            bad = part[y[part] * (x[part] @ w) < 1]
            w *= 1 - rate * strength
            w += rate / max(1, len(part)) * ((y[bad] * weight[bad]) @ x[bad])
        if epoch >= epochs // 2:
            mean += w
    return (mean / (epochs - epochs // 2)).astype(np.float32)


def _slope(margin: np.ndarray, y: np.ndarray) -> float:
    """Of a sigmoid over the margin, by Newton steps on the training rows, the classes smoothed."""
    a, t = 1.0, np.where(y > 0, 0.98, 0.02)
    margin = margin / (np.abs(margin).mean() + 1e-9)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * margin, -30, 30)))
        a -= ((p - t) @ margin) / ((p * (1 - p)) @ margin**2 + 1e-6)
        a = float(np.clip(a, 0.1, 50))
    return a


@dataclass
class Machine:
    weights: np.ndarray
    scale: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = x @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(self.scale * margin, -30, 30)))


def _machine(x: np.ndarray, y: np.ndarray) -> Machine:
    w = _svm(x, y)
    margin = x @ w[:-1] + w[-1]
    return Machine(w, _slope(margin, y) / (float(np.abs(margin).mean()) + 1e-9))


@dataclass
class Model:
    langs: list[str]
    families: list[str]
    by_family: dict[str, Machine]
    by_pair: dict[tuple[str, str], Machine]

    @classmethod
    def fit(cls, texts: list[str], langs: list[str]) -> Model:
        return cls.fit_features(features(texts_of(pa.array(texts, pa.large_string()))), langs)

    @classmethod
    def fit_features(cls, x: np.ndarray, langs: list[str]) -> Model:
        known = sorted(set(langs))
        families = sorted({family_of(c) for c in known})
        if not known:
            return cls([], [], {}, {})
        lang = np.array(langs)
        fam = np.array([family_of(c) for c in langs])
        by_family = {f: _machine(x, np.where(fam == f, 1.0, -1.0)) for f in families} if len(families) > 1 else {}
        by_pair = {}
        for a, b in combinations(known, 2):
            if family_of(a) == family_of(b):
                some = (lang == a) | (lang == b)
                by_pair[a, b] = _machine(x[some], np.where(lang[some] == a, 1.0, -1.0))
        return cls(known, families, by_family, by_pair)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row."""
        n = len(x)
        if self.by_family:
            p = np.stack([self.by_family[f].probability(x) for f in self.families], axis=1)
            p = p / p.sum(axis=1, keepdims=True)
        else:
            p = np.ones((n, 1))
        best = p.argmax(axis=1)
        lang, score = np.empty(n, object), np.empty(n)
        for i, f in enumerate(self.families):
            rows = np.flatnonzero(best == i)
            inside = [c for c in self.langs if family_of(c) == f]
            votes, least = np.zeros((len(rows), len(inside))), np.ones((len(rows), len(inside)))
            for (a, ja), (b, jb) in combinations(zip(inside, range(len(inside)), strict=True), 2):
                q = self.by_pair[a, b].probability(x[rows])
                votes[:, ja] += q >= 0.5
                votes[:, jb] += q < 0.5
                least[:, ja] = np.minimum(least[:, ja], q)
                least[:, jb] = np.minimum(least[:, jb], 1 - q)
            pick = (votes + least / 2).argmax(axis=1)  # among equal votes the surest
            lang[rows] = np.array(inside, object)[pick]
            score[rows] = p[rows, i] * least[np.arange(len(rows)), pick]
        return lang, score


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learns from rows that are not held out; see ``sample`` for the bounds."""
    rows = docs.where(F.col(lang).isNotNull() & (F.col(lang) != UND) & F.col(text).isNotNull() & ~held_out(F.col(key)))
    rows = rows.select(F.col(key).alias("k"), F.col(text).alias("text"), F.col(lang).alias("l"))
    got = sample(rows, per_language).collect()
    got.sort(key=lambda r: (r["l"], r["h"]))
    x = np.zeros((len(got), 1 << DIM_BITS), np.float32)
    for row, r in zip(x, got, strict=True):
        row[np.frombuffer(r["slots"], np.uint16)] = np.frombuffer(r["weights"], np.float32)
    return Model.fit_features(x, [r["l"] for r in got])


def sample(rows: DataFrame, per_language: int) -> DataFrame:
    """(l, h, slots, weights): sparse features of the distinct rows of least hash in each language.

    Only rows below about three times the wanted share of a language's distinct
    hashes are ranked, so no language is gathered in one task.
    """
    h = F.xxhash64("k", "text")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.approx_count_distinct(h).alias("n")).collect()}
    wanted = max(1, min(per_language, MOST_ROWS // max(1, len(counts))))
    part = F.lit(0.0)
    for code, n in counts.items():
        part = F.when(F.col("l") == code, F.lit((3 * wanted + 100) / n)).otherwise(part)
    place = F.pmod(h, F.lit(1 << 30)) / float(1 << 30)
    # copies of a row have its hash and are one
    few = rows.where(place < part).select("l", place.alias("h"), "text").groupBy("l", "h").agg(F.min("text").alias("text"))
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("r") <= wanted).select("l", "h", "text")

    def fn(part, texts):
        x = features(texts)
        at = np.nonzero(x)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(at[0], minlength=len(x)))])
        yield batch(l=part.column("l"), h=part.column("h"), slots=binary_array(at[1].astype(np.uint16), bounds * 2), weights=binary_array(x[at], bounds * 4))

    return map_texts(few, fn, "l string, h double, slots binary, weights binary")


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def judge(model: Model, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text; ``und`` with score 0 without a letter."""
    seen = np.concatenate([[0], np.cumsum(_LETTER[texts.data])])[texts.offsets]
    letters = np.diff(seen) > 0
    for i in np.flatnonzero(~letters & (np.diff(texts.offsets) > 0)):
        letters[i] = any(c.isalpha() for c in texts.bytes_of(i).decode())
    lang, score = np.full(len(texts), UND, object), np.zeros(len(texts))
    if model.langs and letters.any():
        found, sure = model.predict(features(texts))
        lang[letters], score[letters] = found[letters], sure[letters]
    return lang, np.clip(score, 0, 1)


def predict(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for every row."""

    def fn(part, texts):
        lang, score = judge(model, texts)
        yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(lang, pa.string()), pa.array(score)], names=["k", "lang_pred", "score"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    return map_texts(rows, fn, "k long, lang_pred string, score double").withColumnRenamed("k", key)


def keep(docs: DataFrame, model: Model, least_score: float, *, text: str = "text") -> DataFrame:
    """Rows with a letter whose score reaches the least; all columns stay, nothing is shuffled."""
    if not model.langs:
        return docs.where(F.lit(False))

    def run(batches):
        for b in batches:
            for part, texts in chunks(b, text):
                _, score = judge(model, texts)
                yield part.filter(pa.array(score >= least_score))

    return docs.mapInArrow(run, docs.schema)
