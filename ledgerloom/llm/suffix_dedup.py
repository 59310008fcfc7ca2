"""Byte-level dedup over common-prefix interval trees of sparse suffix arrays.

A string of ``width`` bytes that occurs twice contains, at the same place, the
same anchor: the ``GRAM``-byte run whose hash is least in the window.  Anchors
are about 3 % of all places.  Steps:

1. anchors are counted by hash; places of anchors seen once are dropped;
2. a remaining place gets its context, all bytes of the windows around the
   anchor.  Places with equal contexts are one class: all but the first lose
   the whole context, and only the first of each class goes on, if its anchor
   has several classes;
3. the contexts of one anchor make a sparse enhanced suffix array: suffixes
   that begin at the anchor, sorted, with the common-prefix lengths of
   neighbours.  A stack scan yields the interval tree.  In each interval all
   occurrences (not only neighbours) are ordered by what precedes them; a stack
   scan of these gives the sets with diverse left extensions.  Those that span
   several children of the interval are diverse on the right too: maximal
   repeats, with all their occurrences.  Of ``width`` bytes or more, every
   occurrence but the first is removed.  A class of several places is a leaf of
   that weight: the repeat of its whole context, taken in step 2.

``repeat_groups`` returns the groups themselves, ``remove_repeats`` what is left
without their later occurrences.

Earlier means smaller id, then (same document) earlier start.  Copies of a
passage collapse in step 2 whatever their number; depths are bounded by the
context, so an occurrence is in a bounded number of intervals.  One task holds
the distinct contexts of an anchor: those around a passage border, 190 bytes each.

Null text: no bytes.  Null id: before every other.  Rows with equal id and
equal text are one document and all get its result; with equal id and
different texts, the order is by text digest.  A very long text is held whole by
its task, with some 60 bytes for each of its own.  Other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Rolling, Workspace, batch, map_texts, mix64, ranges, unused
from ledgerloom.llm.postings import NOTHING, SCHEMA, Places, _ids, _row_key, buckets_of, by_kind, dealt, key_back, keyed, meet, post

WIDTH = 100
GRAM = 24
TAG = 6

_BYTES, _BYTES2 = Rolling(501), Rolling(502, 1)


def slide(f, x: np.ndarray, width: int) -> np.ndarray:
    """``f`` (minimum or maximum) over every run of ``width`` values, by doubling."""
    n = 1
    while 2 * n <= width:
        x = f(x[:-n], x[n:])
        n *= 2
    rest = width - n
    return f(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(texts, prefix: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, documents and hashes of all grams that are least in a window.

    Equal hashes are all taken, so the choice depends on the window's bytes
    alone.  Windows and grams across a border, and documents too short for a
    window, have none.
    """
    span = width - GRAM + 1
    h = _BYTES.windows(prefix, GRAM)
    if len(h) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rank = (h >> np.uint64(32)).astype(np.uint32)
    least = slide(np.minimum, rank, span)
    across = np.zeros(len(least) + 1, np.int32)  # windows across a border choose nothing
    np.add.at(across, np.clip(texts.offsets[1:-1] - width + 1, 0, len(least)), 1)
    np.add.at(across, np.clip(texts.offsets[1:-1], 0, len(least)), -1)
    least[np.cumsum(across[:-1]) > 0] = 0
    edge = np.zeros(span - 1, np.uint32)
    chosen = np.flatnonzero(slide(np.maximum, np.concatenate([edge, least, edge]), span) == rank)
    doc = np.searchsorted(texts.offsets, chosen, side="right") - 1
    lo, hi = _context(texts, chosen, doc, width)
    ok = (chosen + GRAM <= texts.offsets[doc + 1]) & (hi - lo >= width)
    return chosen[ok], doc[ok], h[chosen[ok]]


def _context(texts, at, doc, width):
    return np.maximum(texts.offsets[doc], at - (width - GRAM)), np.minimum(texts.offsets[doc + 1], at + width)


def _bytes8(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int32)


def anchor_postings(rows: DataFrame, width: int, buckets: int) -> DataFrame:
    """Kind 0: a run's distinct anchors, twice if seen twice; kind 1: all places."""

    def fn(part, texts):
        ids, digests = _ids(part)
        at, doc, h = anchors(texts, _BYTES.bytes_prefix(texts.data), width)
        if not len(at):
            return
        order = np.argsort(h, kind="stable")
        nth = np.arange(len(h)) - np.searchsorted(h[order], h[order], side="left")
        some = np.sort(order[nth < 2])
        tags, pos = _bytes8(h)[:, 8 - TAG :], at - texts.offsets[doc]
        for kind, s in ((0, some), (1, np.arange(len(h)))):
            yield post(kind, _bucket(h[s], buckets), tags[s], doc[s], pos[s], ids, digests)

    return map_texts(rows, fn, SCHEMA)


def _keys(tags: np.ndarray) -> np.ndarray:
    out = np.zeros((len(tags), 8), np.uint8)
    out[:, : tags.shape[1]] = tags
    return out.view(np.uint64).ravel()


def _in(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(keys), bool)
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


def repeated_anchors(postings: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        parts, table, places = [], None, Places(buckets)
        for kind, p in by_kind(batches, TAG):
            keys = _keys(p.tags)
            if kind == 0:
                parts.append(keys)
                continue
            if table is None:
                keys0, n = np.unique(np.concatenate(parts), return_counts=True)
                table, parts = keys0[n > 1], []
            keep = np.flatnonzero(_in(table, keys))
            yield from places.add(1, p.id()[keep], p.digest()[keep], p.pos[keep])
        yield from places.flush()

    return dealt(postings, buckets).mapInArrow(run, SCHEMA)


def context_postings(rows: DataFrame, hits: DataFrame, width: int, buckets: int) -> DataFrame:
    """Tag: anchor hash, context digest of 16 bytes, context bytes before and from the anchor."""

    def fn(part, texts, found):
        ids, digests = _ids(part)
        doc, pos = found.get(1, NOTHING)
        if not len(doc):
            return
        order = np.lexsort((pos, doc))
        doc, pos = doc[order], pos[order]
        at = texts.offsets[doc] + pos
        # a 48-bit tag may name a place that is no anchor of its text's equal-id twin
        ok = at + GRAM <= texts.offsets[doc + 1]
        doc, pos, at = doc[ok], pos[ok], at[ok]
        lo, hi = _context(texts, at, doc, width)
        one, two = _BYTES.bytes_prefix(texts.data), _BYTES2.bytes_prefix(texts.data)
        h = _BYTES.windows(one, GRAM)[at]
        sides = np.stack([at - lo, hi - at], axis=1).astype(np.uint8)
        salt = (at - lo).astype(np.uint64)
        tags = np.concatenate([_bytes8(h), _bytes8(_BYTES.spans(one, lo, hi) + salt), _bytes8(_BYTES2.spans(two, lo, hi) + salt), sides], axis=1)
        seen = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(pos) != 0)])
        for kind in (0, 1):
            yield post(kind, _bucket(h[seen], buckets), tags[seen], doc[seen], pos[seen], ids, digests)

    return meet(rows, hits, buckets, fn, SCHEMA, inner=True)


def _classes(batches):
    """(postings, first place of each one's class, is it that place, does its class repeat, has its anchor several classes).

    A first place is (ids, digests, positions); the postings are those of kind 1.
    """

    def least(parts):
        a, c, d, ids, digests, pos, many = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((pos, digests, ids, d, c, a))
        a, c, d, ids, digests, pos = (x[order] for x in (a, c, d, ids, digests, pos))
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])
        begin = np.flatnonzero(new)
        first = begin[np.cumsum(new) - 1]
        other = many[order] | (ids != ids[first]) | (digests != digests[first]) | (pos != pos[first])
        return a[new], c[new], d[new], ids[new], digests[new], pos[new], np.logical_or.reduceat(other, begin)

    parts, size, table = [], 0, None
    for kind, p in by_kind(batches, 26):
        a, c, d = (p.tags[:, 8 * i : 8 * i + 8].copy().view(np.uint64).ravel() for i in range(3))
        ids, digests = p.id(), p.digest()
        if kind == 0:
            parts.append((a, c, d, ids, digests, p.pos, np.zeros(len(a), bool)))
            size += len(a)
            if size > 1 << 21:
                parts = [least(parts)]
                size = 0
            continue
        if table is None:
            ta, tc, td, tid, tdig, tpos, many = least(parts)
            _, inverse, n = np.unique(ta, return_inverse=True, return_counts=True)
            several = n[inverse] > 1
            key = ta ^ (tc * np.uint64(0x9E3779B97F4A7C15))
            by_key = np.argsort(key)
            table, parts = key[by_key], []
        j = by_key[np.minimum(np.searchsorted(table, a ^ (c * np.uint64(0x9E3779B97F4A7C15))), len(table) - 1)]
        known = (ta[j] == a) & (tc[j] == c) & (td[j] == d)
        own = (np.where(known, tid[j], ids), np.where(known, tdig[j], digests), np.where(known, tpos[j], p.pos))
        first = (own[0] == ids) & (own[1] == digests) & (own[2] == p.pos)
        yield p, own, first, known & many[j], several[j] | ~known


def classify_contexts(postings: DataFrame, buckets: int) -> DataFrame:
    """Kinds 1 and 2: where removed contexts begin and end; kind 3: first places of ambiguous anchors."""

    def run(batches):
        places = Places(buckets)
        for p, _, first, _, several in _classes(batches):
            ids, digests = p.id(), p.digest()
            gone, asks = np.flatnonzero(~first), np.flatnonzero(first & several)
            left, right = p.tags[gone, 24].astype(np.int64), p.tags[gone, 25].astype(np.int64)
            yield from places.add(1, ids[gone], digests[gone], p.pos[gone] - left)
            yield from places.add(2, ids[gone], digests[gone], p.pos[gone] + right)
            yield from places.add(3, ids[asks], digests[asks], p.pos[asks])
        yield from places.flush()

    return dealt(postings, buckets).mapInArrow(run, SCHEMA)


#: Of a member: its class's first place, the sides of their context, and whether the class repeats.
MEMBER = np.dtype([("id", "<i8"), ("digest", "<u4"), ("pos", "<i8"), ("left", "u1"), ("right", "u1"), ("many", "u1")])
MEMBERS = 2


def class_members(postings: DataFrame, buckets: int) -> DataFrame:
    """All places of classes that repeat or share their anchor with others, still in the bucket of their anchor."""

    def run(batches):
        for p, own, _, many, several in _classes(batches):
            keep = np.flatnonzero(many | several)
            if not len(keep):
                continue
            tags = np.zeros(len(keep), MEMBER)
            for name, v in zip(("id", "digest", "pos", "left", "right", "many"), (*own, p.tags[:, 24], p.tags[:, 25], many), strict=True):
                tags[name] = v[keep]
            runs = np.repeat(np.arange(len(p.counts)), p.counts)[keep]
            bucket = _bucket(p.tags[keep, :8].copy().view(np.uint64).ravel(), buckets)
            yield post(MEMBERS, bucket, tags.view(np.uint8).reshape(-1, MEMBER.itemsize), runs, p.pos[keep], p.ids, p.digests)

    return dealt(postings, buckets).mapInArrow(run, SCHEMA)


#: Fills contexts up; never a byte of UTF-8.
PAD = 0xFF


def _run_of_true(rows: np.ndarray) -> np.ndarray:
    """How many values are true from the first on."""
    return np.where(rows.all(axis=1), rows.shape[1], rows.argmin(axis=1))


def context_bytes(rows: DataFrame, places: DataFrame, width: int, buckets: int) -> DataFrame:
    """Tag: anchor hash, how far it is the least gram on either side, bytes before (nearest first) and from it, filled up."""
    before = width - GRAM

    def fn(part, texts, found):
        ids, digests = _ids(part)
        doc, pos = found.get(3, NOTHING)
        if not len(doc):
            return
        order = np.lexsort((pos, doc))
        doc, pos = doc[order], pos[order]
        at = texts.offsets[doc] + pos
        grams = _BYTES.windows(_BYTES.bytes_prefix(texts.data), GRAM)
        h, ranks = grams[at], (grams >> np.uint64(32)).astype(np.uint32)
        lo, hi = _context(texts, at, doc, width)
        data = np.append(texts.data, np.uint8(PAD))
        step = 1 << 14
        for i in range(0, len(at), step):
            s = slice(i, i + step)
            left = at[s, None] - 1 - np.arange(before)
            right = at[s, None] + np.arange(width)
            left[left < lo[s, None]] = len(data) - 1
            right[right >= hi[s, None]] = len(data) - 1
            reach = [_run_of_true(ranks[np.clip(at[s, None] + k * np.arange(1, before + 1), 0, len(ranks) - 1)] >= ranks[at[s], None]) for k in (-1, 1)]
            tags = np.concatenate([_bytes8(h[s]), np.stack(reach, axis=1).astype(np.uint8), data[left], data[right]], axis=1)
            yield post(1, _bucket(h[s], buckets), tags, doc[s], pos[s], ids, digests)

    return meet(rows, places.where("kind = 3"), buckets, fn, SCHEMA, inner=True)


def _words(rows: np.ndarray) -> list[np.ndarray]:
    """Columns of big-endian numbers, last first, as lexsort takes them."""
    width = -(-rows.shape[1] // 8) * 8
    full = np.zeros((len(rows), width), np.uint8)
    full[:, : rows.shape[1]] = rows
    return list(full.view(">u8").astype(np.uint64).T[::-1])


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows, without the filling."""
    stop = (a != b) | (a == PAD)
    return np.where(stop.any(axis=1), stop.argmax(axis=1), a.shape[1])


def prefix_intervals(lcp: list[int]) -> list[tuple[int, int, int, int]]:
    """(depth, first, end, parent's depth) of every interval of the common-prefix tree.

    ``lcp[i]`` is between suffixes i - 1 and i; ``lcp[0]`` is not read.
    """
    out, stack = [], [(0, 0)]
    for i in range(1, len(lcp) + 1):
        depth = lcp[i] if i < len(lcp) else 0
        first = i - 1
        while stack[-1][0] > depth:
            d, first = stack.pop()
            out.append((d, first, i, max(depth, stack[-1][0])))
        if stack[-1][0] < depth:
            stack.append((depth, first))
    return out


def maximal_repeats(anchor: np.ndarray, left: np.ndarray, right: np.ndarray, width: int):
    """Blocks of (members, item, bytes before the anchor, bytes from it): whole groups, one row an occurrence.

    ``members`` counts the rows of each group, ``left`` and ``right`` are filled rows.
    """
    n = len(anchor)
    if n < 2:
        return
    by_right = np.lexsort([*_words(right), anchor])
    anchor, left, right = anchor[by_right], left[by_right], right[by_right]
    lcp = np.zeros(n, np.int64)
    lcp[1:] = _common(right[1:], right[:-1])
    lcp[1:][anchor[1:] != anchor[:-1]] = 0
    by_left = np.lexsort(_words(left))
    left_rank = np.empty(n, np.int64)
    left_rank[by_left] = np.arange(n)
    tree = np.array(prefix_intervals(lcp.tolist()), np.int64).reshape(-1, 4)
    depth, first, end, _ = tree.T
    # bytes on the left that make a repeat of `width`
    need = width - depth
    use = need <= left.shape[1]
    depth, first, end, need = depth[use], first[use], end[use], need[use]
    pair = end - first == 2
    x = first[pair]
    if len(x):
        ext = _common(left[x], left[x + 1])
        ok = ext >= need[pair]
        item = (x[ok, None] + np.arange(2)).ravel()
        yield np.full(int(ok.sum()), 2), by_right[item], np.repeat(ext[ok], 2), np.repeat(depth[pair][ok], 2)
    found, size = [], 0
    for d, lo, hi, least in zip(*(v[~pair].tolist() for v in (depth, first, end, need)), strict=True):
        members = lo + np.argsort(left_rank[lo:hi])
        rows = left[members]
        # common left extensions, counted from the least that is enough
        common = np.maximum(_common(rows[1:], rows[:-1]) - least + 1, 0)
        top = int(common.max())
        if not top:
            continue
        if common.min() == top:
            ext, begin, stop = np.array([top]), np.array([0]), np.array([hi - lo])
        else:
            ext, begin, stop, _ = np.array(prefix_intervals([0, *common.tolist()]), np.int64).reshape(-1, 4).T
        child = np.concatenate([[0], np.cumsum(lcp[lo + 1 : hi] == d)])[members - lo]
        turns = np.concatenate([[0], np.cumsum(child[1:] != child[:-1])])
        ok = turns[stop - 1] > turns[begin]  # in one child only: a longer repeat, met there
        sizes = (stop - begin)[ok]
        found.append((sizes, by_right[members[ranges(begin[ok], sizes)]], np.repeat(ext[ok] + least - 1, sizes), np.full(int(sizes.sum()), d)))
        size += len(found[-1][1])
        if size > 1 << 18:
            yield tuple(np.concatenate(v) for v in zip(*found, strict=True))
            found, size = [], 0
    if found:
        yield tuple(np.concatenate(v) for v in zip(*found, strict=True))


def firsts(members: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For every row, the least value of its group."""
    return np.repeat(np.minimum.reduceat(values, np.cumsum(members) - members), members) if len(values) else values


def repeats_of_contexts(anchor: np.ndarray, left: np.ndarray, right: np.ndarray, order: np.ndarray, width: int):
    """(item, bytes before the anchor, bytes from it) of all occurrences that are not their group's first.

    ``order`` ranks the items.  Of groups as deep, an item's longest is enough.
    """
    found = [(*NOTHING, NOTHING[0])]
    for members, item, lefts, rights in maximal_repeats(anchor, left, right, width):
        later = order[item] > firsts(members, order[item])
        item, lefts, rights = item[later], lefts[later], rights[later]
        by = np.lexsort((lefts, rights, item))
        item, lefts, rights = item[by], lefts[by], rights[by]
        last = np.ones(len(item), bool)
        last[:-1] = (item[1:] != item[:-1]) | (rights[1:] != rights[:-1])
        found.append((item[last], lefts[last], rights[last]))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def _gathered(parts, width: int):
    """Per run of whole anchors: (its rows, anchors, reaches, bytes before, bytes from the anchor), and all places."""
    before = width - GRAM
    tags, ids, digests, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((pos, digests, ids))
    new = np.ones(len(ids), bool)  # repeated rows are one document
    new[1:] = (np.diff(ids[order]) != 0) | (np.diff(digests[order]) != 0) | (np.diff(pos[order]) != 0)
    tags, ids, digests, pos = (v[order[new]] for v in (tags, ids, digests, pos))
    anchor, rank = _keys(tags[:, :8]), np.arange(len(ids))
    # whole anchors at a time bound the temporaries
    by_anchor = np.argsort(anchor, kind="stable")
    begins = np.flatnonzero(np.diff(anchor[by_anchor], prepend=anchor[by_anchor][:1] + np.uint64(1)))
    cut = 0
    bounds = [*begins[1:].tolist(), len(anchor)]
    for i, b in enumerate(bounds):
        if b - cut < 1 << 15 and i + 1 < len(bounds):
            continue
        s, cut = by_anchor[cut:b], b
        reach, sides = tags[s, 8:10].astype(np.int64), tags[s, 10:]
        yield anchor[s], reach, sides[:, :before], sides[:, before:], rank[s], (ids[s], digests[s], pos[s])


def _tag_width(width: int) -> int:
    return 10 + width - GRAM + width


def scan_contexts(postings: DataFrame, width: int, buckets: int) -> DataFrame:
    def run(batches):
        parts, places = [(p.tags, p.id(), p.digest(), p.pos) for _, p in by_kind(batches, _tag_width(width))], Places(buckets)
        if not parts:
            return
        for anchor, _, left, right, rank, (ids, digests, pos) in _gathered(parts, width):
            item, lefts, rights = repeats_of_contexts(anchor, left, right, rank, width)
            yield from places.add(1, ids[item], digests[item], pos[item] - lefts)
            yield from places.add(2, ids[item], digests[item], pos[item] + rights)
        yield from places.flush()

    return dealt(postings, buckets).mapInArrow(run, SCHEMA)


GROUP_SCHEMA = "first_id long, first_digest long, first_start long, length int, id long, digest long, start long"


def scan_groups(contexts: DataFrame, members: DataFrame, width: int, buckets: int) -> DataFrame:
    """One row an occurrence of a group, its first place naming the group; members stream past the bucket's trees."""
    before = width - GRAM

    def place_key(ids, digests, pos):
        return mix64(_row_key(ids, digests) + pos.astype(np.uint64))

    def trees(parts):
        """By class: (key, first place of the group, bytes before and from the anchor), and classes whose whole context is a group."""
        found = [(np.zeros(0, np.uint64), NOTHING[0], np.zeros(0, np.uint32), NOTHING[0], NOTHING[0], NOTHING[0])]
        whole = [np.zeros(0, np.uint64)]
        for anchor, reach, left, right, rank, (ids, digests, pos) in _gathered(parts, width) if parts else ():
            by_rank = np.argsort(rank)
            key, sides = place_key(ids, digests, pos), [(x != PAD).sum(axis=1) for x in (left, right)]
            for sizes, item, lefts, rights in maximal_repeats(anchor, left, right, width):
                # only an anchor that is least in a window inside the repeat is met at all its occurrences
                inside = np.minimum(reach[item, 0], lefts) + np.minimum(reach[item, 1], rights - GRAM) >= before
                first = by_rank[np.searchsorted(rank[by_rank], firsts(sizes, rank[item]))]
                item, first, lefts, rights = item[inside], first[inside], lefts[inside], rights[inside]
                found.append((key[item], ids[first], digests[first], pos[first] - lefts, lefts, rights))
                whole.append(key[item][(lefts == sides[0][item]) & (rights == sides[1][item])])
        table = [np.concatenate(v) for v in zip(*found, strict=True)]
        order = np.argsort(table[0], kind="stable")
        return [v[order] for v in table], np.unique(np.concatenate(whole))

    def run(batches):
        parts, table = [], None
        for kind, p in by_kind(batches, {1: _tag_width(width), MEMBERS: MEMBER.itemsize}):
            if kind == 1:
                parts.append((p.tags, p.id(), p.digest(), p.pos))
                continue
            if table is None:
                (keys, *groups), whole = trees(parts)
                table, parts = keys, []
            tags, ids, digests = np.ascontiguousarray(p.tags).view(MEMBER).ravel(), p.id(), p.digest()
            key = place_key(tags["id"], tags["digest"], tags["pos"])
            lo, hi = np.searchsorted(table, key, side="left"), np.searchsorted(table, key, side="right")
            g, m = ranges(lo, hi - lo), np.repeat(np.arange(len(key)), hi - lo)
            leaf = np.flatnonzero((tags["many"] > 0) & ~_in(whole, key))
            left, right = tags["left"][leaf].astype(np.int64), tags["right"][leaf].astype(np.int64)
            for who, first_id, first_digest, start, lefts, rights in (
                (m, *(v[g] for v in groups)),
                (leaf, tags["id"][leaf], tags["digest"][leaf], tags["pos"][leaf] - left, left, right),
            ):
                for i in range(0, len(who), 1 << 16):
                    s = slice(i, i + (1 << 16))
                    yield batch(
                        first_id=first_id[s], first_digest=first_digest[s].astype(np.int64), first_start=start[s], length=(lefts + rights)[s].astype(np.int32),
                        id=ids[who[s]], digest=digests[who[s]].astype(np.int64), start=(p.pos[who] - lefts)[s],
                    )

    return dealt(contexts.unionByName(members), buckets).mapInArrow(run, GROUP_SCHEMA)


def repeat_groups(docs: DataFrame, width: int = WIDTH, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(first_id, first_digest, first_start, length, key, digest, start): every occurrence of every maximal repeat.

    A group is named by its first occurrence and its length.  Repeats are
    maximal as far as an anchor's context reaches, ``width - GRAM`` bytes before
    and ``width`` from it on: a longer one is a chain of overlapping groups.
    Digests are those of texts (CRC-32); null ids stay null.
    """
    spark = docs.sparkSession
    rows, buckets = keyed(docs, key, text), buckets_of(spark)
    work = Workspace(spark, "suffix-groups")
    hits = work.save(repeated_anchors(anchor_postings(rows, width, buckets), buckets), "anchors")
    contexts = work.save(context_postings(rows, hits, width, buckets), "contexts")
    asks = work.save(classify_contexts(contexts, buckets), "classes")
    bytes_ = context_bytes(rows, asks, width, buckets)
    out = work.save(scan_groups(bytes_, class_members(contexts, buckets), width, buckets).distinct(), "groups")
    for done in ("anchors", "contexts", "classes"):
        work.drop(done)
    return out.select(key_back(F.col("first_id")).alias("first_id"), "first_digest", "first_start", "length", key_back(F.col("id")).alias(key), "digest", "start")


def remove_repeats(docs: DataFrame, width: int = WIDTH, *, key: str = "doc_id", text: str = "text", whole_characters: bool = False) -> DataFrame:
    """(key, digest, n_bytes, n_removed, spans, kept) for every row.

    ``spans`` are the maximal removed runs as [start, end) byte numbers and
    ``kept`` the other bytes (cut at byte level, so not always valid UTF-8).
    With ``whole_characters``, a character that loses some of its bytes loses all.
    """
    spark = docs.sparkSession
    rows, buckets = keyed(docs, key, text), buckets_of(spark)
    work = Workspace(spark, "suffix")
    hits = work.save(repeated_anchors(anchor_postings(rows, width, buckets), buckets), "anchors")
    classes = work.save(classify_contexts(context_postings(rows, hits, width, buckets), buckets), "classes")
    work.drop("anchors")
    scanned = work.save(scan_contexts(context_bytes(rows, classes, width, buckets), width, buckets), "repeats")

    def fn(part, texts, found):
        edge = np.zeros(len(texts.data) + 1, np.int32)
        for kind, sign in ((1, 1), (2, -1)):
            row, pos = found.get(kind, NOTHING)
            np.add.at(edge, texts.offsets[row] + pos, sign)
        gone = np.cumsum(edge[:-1]) > 0
        yield _rendered(part, texts, _widened(texts.data, gone) if whole_characters else gone)

    places = classes.where("kind < 3").unionByName(scanned)
    final = meet(rows, places, buckets, fn, "id long, digest long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
    return final.select(key_back(F.col("id")).alias(key), "digest", "n_bytes", "n_removed", "spans", "kept")


def _widened(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Removed bytes, and all other bytes of their characters."""
    if not gone.any():
        return gone
    first = np.flatnonzero((data & 0xC0) != 0x80)  # bytes that begin a character
    return np.repeat(np.maximum.reduceat(gone, first), np.diff(np.append(first, len(data))))


def _rendered(part, texts, gone) -> pa.RecordBatch:
    n = len(texts)
    out = texts.data[~gone]
    bounds = np.concatenate([[0], np.cumsum(~gone)])[texts.offsets]
    before = np.zeros(len(gone), bool)
    before[1:] = gone[:-1]
    after = np.zeros(len(gone), bool)
    after[:-1] = gone[1:]
    inner = texts.offsets[:-1][texts.offsets[:-1] < len(gone)]
    before[inner] = False
    last = texts.offsets[1:][texts.offsets[1:] > 0] - 1
    after[last] = False
    begins, stops = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
    doc = np.searchsorted(texts.offsets, begins, side="right") - 1
    spans = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(begins - texts.offsets[doc]), pa.array(stops - texts.offsets[doc])], names=["start", "end"]),
    )
    size = np.diff(texts.offsets)
    kept = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out))])
    return pa.RecordBatch.from_arrays(
        [part.column("id"), part.column("digest"), pa.array(size), pa.array(size - np.diff(bounds)), spans, kept],
        names=["id", "digest", "n_bytes", "n_removed", "spans", "kept"],
    )


def clean(docs: DataFrame, width: int = WIDTH, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the removed bytes cut from their texts; characters cut in half go too.

    Null texts stay null.  Columns of ``docs`` may bear any names.
    """
    own, digest, rest = unused(docs, "_id", "_digest", "_kept")
    out = remove_repeats(docs, width, key=key, text=text, whole_characters=True)
    cut = out.where("n_removed > 0").select(F.col(key).alias(own), F.col("digest").alias(digest), F.col("kept").cast("string").alias(rest)).dropDuplicates([own, digest])
    same = docs[key].eqNullSafe(cut[own]) & (F.crc32(F.coalesce(docs[text], F.lit(""))) == cut[digest])
    joined = docs.join(cut, same, "left")
    return joined.select(*(F.when(cut[digest].isNotNull(), cut[rest]).otherwise(docs[text]).alias(text) if c == text else docs[c] for c in docs.columns))
