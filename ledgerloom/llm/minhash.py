"""MinHash near-dedup with circulant permutations and exact verification.

Signatures follow circulant MinHash: one permutation scatters the hashed
shingles over a circle of 2**32 places, a second one ranks the places, and
coordinate k ranks them after a rotation by k.  Two permutations thus give all
``bands * rows`` coordinates.

1. Documents with equal shingle sets are one class, represented by its least id.
2. Representatives meet in band buckets.  Each bucket proposes only pairs with
   its least member; pairs are kept if their sizes and sketches allow the
   threshold, and confirmed on the full shingle sets.
3. Confirmed links join into components.  Buckets that still hold several
   components compare their members across them, in blocks of bounded size and
   on the full sets: no candidate of a bucket is left out, yet only links leave
   a block and a bucket of copies never makes all its pairs.  Members of a
   bucket's largest component meet only the others, so a hot bucket that is
   nearly one component costs its size times the blocks of the rest.

With 25 bands of 5 rows a pair at similarity 0.8 fails to meet with probability
5e-5, one at 0.85 with 4e-7.

Null or empty text and texts without words have no shingles and link with
nothing.  Null id: before every other.  Texts whose classes share their least
id (repeated ids) count as linked.  Other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import LOWER, Rolling, Texts, Workspace, binary_array, chunks, map_texts, mix64, texts_of, windows_in_docs, word_hashes, words_of
from ledgerloom.llm.postings import NULL_ID, key_back, keyed
from ledgerloom.operators.graph import connected_components

SHINGLE_WORDS = 5
PERCENT = 80
BANDS, ROWS = 25, 5
#: Candidates whose sketches agree on less than this are dropped: 4 standard errors below 0.8.
SKETCH_SLACK = 0.15
#: Shingles of a bucket's members compared in one block.
BLOCK_SHINGLES = 1 << 19
#: Pairs of one centre that a task gets.
CENTER_PAIRS = 1 << 12

_BYTES, _SEQ = Rolling(401), Rolling(402)
NONE = np.zeros(0, np.int64)


def _shingles(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and documents of all shingles; a text shorter than a shingle is one."""
    texts = Texts(LOWER[texts.data], texts.offsets)
    words = words_of(texts)
    counts = words.counts()
    prefix = _SEQ.prefix(word_hashes(texts, words, _BYTES))
    starts, doc = windows_in_docs(words.first, size)
    short = np.flatnonzero((counts > 0) & (counts < size))
    h = np.concatenate([_SEQ.spans(prefix, starts, starts + size), _SEQ.spans(prefix, words.first[short], words.first[short + 1])])
    return h, np.concatenate([doc, short])


def shingle_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents, by document, and where each document begins.

    Document number and hash are sorted as one 64-bit number, so a hash loses as
    many low bits as the run's document numbers take (about 10); the bits of
    ``COMMON_BITS`` are kept in every run.
    """
    h, doc = _shingles(texts, size)
    bits = max(1, len(texts).bit_length())
    both = (doc.astype(np.uint64) << np.uint64(64 - bits)) | (h >> np.uint64(bits))
    both.sort()
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    both = both[new]
    first = np.searchsorted(both >> np.uint64(64 - bits), np.arange(len(texts) + 1, dtype=np.uint64))
    return both << np.uint64(bits), first


def full_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with all 64 bits of the hashes."""
    h, doc = _shingles(texts, size)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def _second(x: np.ndarray, out: np.ndarray, tmp: np.ndarray) -> None:
    """The second permutation, of 32-bit places, in place."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(x, np.uint32(shift), out=tmp)
        np.bitwise_xor(x, tmp, out=out)
        np.multiply(out, np.uint32(factor), out=out)
        x = out
    np.right_shift(out, np.uint32(16), out=tmp)
    np.bitwise_xor(out, tmp, out=out)


def signatures(hashes: np.ndarray, first: np.ndarray, coordinates: int) -> np.ndarray:
    """One row of ``coordinates`` for every document; documents without shingles get the greatest value."""
    n = len(first) - 1
    out = np.full((coordinates, n), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        place = (mix64(hashes) >> np.uint64(32)).astype(np.uint32)  # the first permutation
        turned, tmp = np.empty_like(place), np.empty_like(place)
        for k in range(coordinates):
            np.add(place, np.uint32(k), out=turned)
            _second(turned, turned, tmp)
            out[k, some] = np.minimum.reduceat(turned, first[some])
    return out.T


#: Bits of a shingle hash that do not depend on the run of documents it was met in.
COMMON_BITS = np.uint64(0xFFFFFFFFFF) << np.uint64(24)


def signature_table(rows: DataFrame, size: int, bands: int, depth: int) -> DataFrame:
    """(id, digest, n_shingles, s1, s2, keys, sketch)"""

    def fn(part, texts):
        hashes, first = shingle_sets(texts, size)
        hashes &= COMMON_BITS
        n = np.diff(first)
        sums = []
        for salt in (1, 2):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(hashes + np.uint64(salt)))])
            sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
        sig = signatures(hashes, first, bands * depth)
        keys = np.empty((len(n), bands), np.uint64)
        for b in range(bands):
            k = np.full(len(n), b + 1, np.uint64)
            for r in range(depth):
                k = mix64(k * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * depth + r])
            keys[:, b] = k
        low = np.ascontiguousarray(sig.astype(np.uint8))
        yield pa.RecordBatch.from_arrays(
            [
                part.column("id"), part.column("digest"), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]),
                pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), pa.array(keys.ravel().view(np.int64))),
                binary_array(low, np.arange(len(n) + 1) * low.shape[1]),
            ],
            names=["id", "digest", "n_shingles", "s1", "s2", "keys", "sketch"],
        )

    return map_texts(rows, fn, "id long, digest long, n_shingles long, s1 long, s2 long, keys array<long>, sketch binary")


def with_centers(pairs: DataFrame, a_side: DataFrame, b_side: DataFrame) -> DataFrame:
    """Pairs with both sides' columns; those of a centre in many pairs are dealt out, and its row goes to every part."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CENTER_PAIRS).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    centers = a_side.join(many, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return dealt.join(centers, ["a", "part"]).drop("part").join(b_side, "b")


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those (a, b) whose full shingle sets reach the threshold."""
    ta = texts.select(F.col("id").alias("a"), F.col("text").alias("a_text"))
    tb = texts.select(F.col("id").alias("b"), F.col("text").alias("b_text"))
    joined = with_centers(pairs.select("a", "b"), ta, tb).select("a", "b", "a_text", "b_text")

    def run(batches):
        for whole in batches:
            for part, left in chunks(whole, "a_text", 1 << 20):
                right = texts_of(part.column("b_text"))
                n = len(left)
                both = Texts(np.concatenate([left.data, right.data]), np.concatenate([left.offsets, right.offsets[1:] + left.offsets[-1]]))
                hashes, first = shingle_sets(both, size)
                sizes = np.diff(first)
                pair = np.repeat(np.concatenate([np.arange(n), np.arange(n)]), sizes)
                order = np.lexsort((hashes, pair))
                h, p = hashes[order], pair[order]
                shared = np.bincount(p[1:][(h[1:] == h[:-1]) & (p[1:] == p[:-1])], minlength=n)
                linked = 100 * shared >= percent * (sizes[:n] + sizes[n:] - shared)
                yield part.select(["a", "b"]).filter(pa.array(linked))

    return joined.mapInArrow(run, "a long, b long")


def _agree(sketch_a: np.ndarray, sketch_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Pairs (broadcast over the leading axes) that sizes and sketches allow."""
    sizes = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    k = sketch_a.shape[-1]
    return sizes & ((sketch_a == sketch_b).sum(axis=-1) >= (percent / 100 - SKETCH_SLACK) * k)


def _plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    side = lambda s: reps.select(F.col("id").alias(s), F.col("n_shingles").alias(f"{s}_n"), F.col("sketch").alias(f"{s}_sketch"))
    joined = with_centers(pairs, side("a"), side("b"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sa, sb = (np.stack([np.frombuffer(x, np.uint8) for x in b.column(c).to_pylist()]) for c in ("a_sketch", "b_sketch"))
            ok = _agree(sa, sb, b.column("a_n").to_numpy(), b.column("b_n").to_numpy(), percent)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return joined.mapInArrow(run, "a long, b long")


def set_table(texts: DataFrame, size: int) -> DataFrame:
    """(id, hashes): the sorted 64-bit hashes of the full shingle set."""

    def fn(part, texts):
        h, first = full_sets(texts, size)
        yield pa.RecordBatch.from_arrays([part.column("id"), binary_array(h.view(np.uint8), first * 8)], names=["id", "hashes"])

    return map_texts(texts, fn, "id long, hashes binary")


def cross_links(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): confirmed links between different components of one bucket.

    ``members``: key, id, component, n_shingles, sketch, hashes, major (whether
    of the bucket's largest component), majors and minors (how many blocks these
    and the others are cut in).  A member goes to every pair of blocks that holds
    its own, but for pairs of two blocks of majors, so a task sees two blocks at
    a time whatever the bucket's size.  Pairs that sizes and sketches allow are
    tested on the full sets, the likeliest first; one link to a component is
    enough, so only links leave the task, at most one for a member and component.
    """
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    own = F.when(F.col("major"), place("majors")).otherwise(F.col("majors") + place("minors"))
    other = F.explode(F.sequence(F.when(F.col("major"), F.col("majors")).otherwise(0), F.col("majors") + F.col("minors") - 1))
    dealt = (
        members.withColumn("own", own)
        .withColumn("other", other)
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component", "n_shingles", "sketch", "hashes")
    )

    def fn(key, t):
        found = [(NONE, NONE)]
        own, ids, comp, n = (t.column(c).to_numpy() for c in ("own", "id", "component", "n_shingles"))
        ids, at = np.unique(ids, return_index=True)
        own, comp, n = own[at], comp[at], n[at]
        if comp.min() != comp.max():
            sketch, sets = ([np.frombuffer(x, kind) for x in t.column(c).take(pa.array(at)).to_pylist()] for c, kind in (("sketch", np.uint8), ("hashes", np.uint64)))
            sketch = np.stack(sketch)
            i, j = key[1].as_py(), key[2].as_py()
            others = np.flatnonzero(own == j)
            for x in np.flatnonzero(own == i):
                y = others[others > x] if i == j else others
                y = y[comp[y] != comp[x]]
                if len(y):
                    linked = _first_links(x, y, comp, n, sketch, sets, percent)
                    found.append((np.minimum(ids[x], ids[linked]), np.maximum(ids[x], ids[linked])))
        a, b = (np.concatenate(v) for v in zip(*found, strict=True))
        return pa.table({"a": a, "b": b})

    return dealt.groupBy("key", "i", "j").applyInArrow(fn, "a long, b long").distinct()


def _first_links(x, y, comp, n, sketch, sets, percent) -> np.ndarray:
    """Of the members ``y``, the first of each component that links with ``x``."""
    same = (sketch[x][None, :] == sketch[y]).sum(axis=1)
    ok = (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (same >= (percent / 100 - SKETCH_SLACK) * sketch.shape[1])
    y, same = y[ok], same[ok]
    done, linked = set(), []
    for k in y[np.argsort(-same, kind="stable")].tolist():
        if comp[k] in done:
            continue
        place = np.minimum(np.searchsorted(sets[x], sets[k]), len(sets[x]) - 1)
        shared = int((sets[x][place] == sets[k]).sum())
        if 100 * shared >= percent * (len(sets[x]) + len(sets[k]) - shared):
            done.add(comp[k])
            linked.append(k)
    return np.array(linked, np.int64)


def near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row; ``kept`` is one id of each component, its least."""
    spark = docs.sparkSession
    work = Workspace(spark, "minhash")
    base = keyed(docs, key, text)
    sigs = work.save(signature_table(base, shingle_words, bands, rows), "signatures")
    same = ["s1", "s2", "n_shingles"]
    classes = work.save(sigs.where("n_shingles > 0").groupBy(*same).agg(F.min("id").alias("rep")), "classes")
    reps = work.save(
        sigs.join(classes.withColumnRenamed("rep", "id"), ["id", *same], "left_semi").select("id", "n_shingles", "keys", "sketch"), "representatives"
    )
    banded = reps.select("id", F.explode("keys").alias("key")).distinct()
    buckets = banded.groupBy("key").agg(F.min("id").alias("center"), F.count(F.lit(1)).alias("size")).where("size > 1")
    met = work.save(banded.join(buckets, "key"), "buckets")
    # texts of all documents that met another move once, at every size by the same join; both confirmations read them
    texts = work.save(base.select("id", "text").join(met.select("id").distinct().hint("merge"), "id", "left_semi"), "texts")
    stars = met.where("id > center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    stars = work.save(_plausible(stars, reps, percent), "stars")
    links = work.save(confirm(stars, texts, shingle_words, percent), "links")
    labels = connected_components(links, "a", "b", Workspace(spark, "minhash-components"))

    # what is left: buckets that hold several components
    placed = met.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sized = reps.select("id", "n_shingles", "sketch")
    parts = placed.join(sized, "id").groupBy("key", "component").agg(F.sum("n_shingles").alias("total"))
    largest = F.max(F.struct("total", "component"))
    # a bucket that fits is one block, without majors
    hot, blocks = F.col("total") > BLOCK_SHINGLES, lambda c: F.ceil(c / BLOCK_SHINGLES).cast("int")
    majors = F.when(hot, blocks(F.col("largest.total"))).otherwise(0)
    minors = F.when(hot, blocks(F.col("total") - F.col("largest.total"))).otherwise(1)
    open_ = (
        parts.groupBy("key")
        .agg(F.count(F.lit(1)).alias("components"), F.sum("total").alias("total"), largest.alias("largest"))
        .where("components > 1")
        .select("key", F.when(hot, F.col("largest.component")).alias("top"), majors.alias("majors"), minors.alias("minors"))
    )
    placed_open = placed.select("key", "id", "component").join(open_, "key")
    members = work.save(placed_open.withColumn("major", F.coalesce(F.expr("component = top"), F.lit(False))).drop("top"), "members")
    asked = members.select("id").distinct()
    sets = work.save(set_table(texts.join(asked, "id", "left_semi"), shingle_words), "sets")
    found = work.save(cross_links(members.join(sized, "id").join(sets, "id"), percent), "more-links")
    if not found.isEmpty():
        labels = connected_components(links.unionByName(found), "a", "b", Workspace(spark, "minhash-components"))
    rep_of = classes.join(labels, classes["rep"] == labels["node"], "left").select(*same, F.coalesce("component", "rep").alias("component"))
    out = sigs.select("id", *same).join(rep_of, same, "left").withColumn("component", F.coalesce("component", "id"))
    return out.select(
        key_back(F.col("id")).alias(key), "n_shingles", F.when(F.col("component") != NULL_ID, F.col("component")).alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )

