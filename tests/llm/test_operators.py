"""Every operator against plain versions, on odd rows: nulls, empty, long, repeated, no rows, clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F


from ledgerloom.llm import decontam, langid, lm_score, minhash, packing, postings, sharding, simhash, substring_dedup, suffix_dedup, url_filter
from ledgerloom.llm.common import texts_of
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, id long, digest string, kind int, bucket string"


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(60), prose(30)
    near = base.split()
    near[40] = "changed"
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "ONE two"),
        (9, prose(20) + "\n" + passage + "  " + prose(20)), (10, passage), (11, prose(9) + " " + passage.upper()), (12, passage + " " + passage),
        (13, "ab" * 400), (14, "x" * 5000), (15, prose(4000)), (16, "123 456 !!"), (17, base + " " + prose(3)), (18, passage + prose(5) + passage[:50]),
    ]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", 7, "d", 1, "b") for i, t in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    return texts()


def plain(df):
    return sorted(tuple(r) for r in df.collect())


def test_substring(spark, rows):
    got = substring_dedup.remove_repeats(frame(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert plain(got) == brute.substring(rows)


def test_substring_spans_and_repeated_rows(spark, rows):
    twice = [*rows, rows[8]]
    out = substring_dedup.remove_repeats(frame(spark, twice)).collect()
    assert len(out) == len(twice)
    for r in out:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_suffix(spark, rows):
    got = suffix_dedup.remove_repeats(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    assert plain(got) == brute.byte_repeats(rows)


def groups_of(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.first_id, r.first_start, r.length].append((r.doc_id, r.start))
    return {k: sorted(v) for k, v in out.items()}


def test_suffix_groups_hold_every_occurrence(spark, rows):
    """Against strings found plainly: complete, maximal, and all that the removal rests on."""
    got = groups_of(suffix_dedup.repeat_groups(frame(spark, [*rows, rows[8]])))
    places = {}
    for i, t in rows:
        one = texts_of(pa.array([t], pa.string()))
        places[i] = suffix_dedup.anchors(one, suffix_dedup._BYTES.bytes_prefix(one.data), 100)[0].tolist()
    data, want = brute.byte_groups(rows, places)
    strings = set()
    for (i, start, length), where in got.items():
        string = data[i][start : start + length]
        assert where == brute.occurrences(data, string) and where[0] == (i, start) and len(where) > 1
        strings.add(string)
    assert len(strings) == len(got) and strings <= {s for s, _ in want}
    # what is left of the plain ones: an anchor that is least only in a window outside of the string
    grams = lambda s: suffix_dedup._BYTES.windows(suffix_dedup._BYTES.bytes_prefix(np.frombuffer(s, np.uint8)), 24) >> np.uint64(32)
    for string, a in want:
        g = grams(string)
        inside = any(g[w : w + 77].min() == g[a] for w in range(max(0, a - 76), min(a, len(string) - 100) + 1))
        assert (string in strings) or not inside
    gone = {i: set() for i in data}
    for (_, _, length), where in got.items():
        for i, start in where[1:]:
            gone[i].update(range(start, start + length))
    assert {(i, len(v)) for i, v in gone.items()} == {(r[0], r[2]) for r in brute.byte_repeats(rows)}


def test_suffix_repeated_rows_keep_their_first_occurrences(spark, rows):
    twice = [*rows, rows[0], rows[8], rows[9]]
    once = {r.doc_id: (r.n_removed, r.kept) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    out = suffix_dedup.remove_repeats(frame(spark, twice)).collect()
    assert len(out) == len(twice) and all((r.n_removed, r.kept) == once[r.doc_id] for r in out)


def test_suffix_groups_of_odd_rows(spark):
    odd = [(None, "x" * 300), (None, "x" * 300), (3, None), (4, ""), (5, "short")]
    got = groups_of(suffix_dedup.repeat_groups(frame(spark, odd)))
    assert got and all(k[0] is None for k in got)
    assert suffix_dedup.repeat_groups(frame(spark, odd).where("false")).count() == 0


def test_suffix_clean_keeps_columns(spark, rows):
    docs = frame(spark, rows)
    out = suffix_dedup.clean(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert out.where("doc_id = 4").first().text is None


def test_interval_scan_against_all_pairs():
    rng = random.Random(3)
    for _ in range(150):
        n, before, width = rng.randint(2, 7), 3, 5
        left, right = np.full((n, before), 255, np.uint8), np.full((n, width), 255, np.uint8)
        for i in range(n):
            one, two = rng.randint(0, before), rng.randint(0, width - 1)
            left[i, :one] = [rng.choice([1, 2]) for _ in range(one)]
            right[i, : two + 1] = [9, *(rng.choice([1, 2]) for _ in range(two))]
        order = np.array(rng.sample(range(n), n))
        found = zip(*(v.tolist() for v in suffix_dedup.repeats_of_contexts(np.zeros(n, np.uint64), left, right, order, width)), strict=True)
        got = {(x, k) for x, a, b in found for k in range(width - b, a + 1)}
        piece = lambda z, k, left=left, right=right, width=width: (tuple(left[z, :k]), tuple(right[z, : width - k]))
        want = {
            (x, k)
            for x in range(n) for y in range(n) for k in range(before + 1)
            if order[y] < order[x] and piece(x, k) == piece(y, k) and 255 not in sum(piece(x, k), ())
        }
        assert got == want


def test_minhash(spark, rows):
    assert plain(minhash.near_duplicates(frame(spark, rows), shingle_words=4)) == brute.near(rows)


def test_minhash_cross_links_split_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(30):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(40)] = f"x{rng.randrange(99)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 200)
    assert plain(minhash.near_duplicates(frame(spark, rows), shingle_words=4)) == brute.near(rows)


def test_minhash_recall_just_above_the_threshold(spark):
    """300 pairs of 0.80 to 0.85 by their full sets: all are linked, and nothing else."""
    rng = random.Random(23)
    rows = []
    while len(rows) < 600:
        one = [f"v{rng.randint(0, 99999)}" for _ in range(rng.randint(60, 240))]
        two = list(one)
        for _ in range(rng.randint(1, 9)):
            two[rng.randrange(len(two))] = f"u{rng.randint(0, 99999)}"
        a, b = (brute.shingles(" ".join(x)) for x in (one, two))
        if 0.80 <= len(a & b) / len(a | b) <= 0.85:
            rows += [(len(rows), " ".join(one)), (len(rows) + 1, " ".join(two))]
    got = minhash.near_duplicates(frame(spark, rows), shingle_words=4).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 for i, _ in rows}


@pytest.mark.parametrize("block,pairs", [(100, 2), (400, 3)])
def test_minhash_hot_bucket_in_parts(spark, monkeypatch, block, pairs):
    """A large component, strays near some of its members, and a centre in many pairs."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(minhash, "CENTER_PAIRS", pairs)
    rng = random.Random(31)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            w[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    assert plain(minhash.near_duplicates(frame(spark, rows), shingle_words=4)) == brute.near(rows)


def test_simhash(spark, rows):
    out = {r.doc_id: r for r in simhash.fingerprint_edits(frame(spark, rows)).collect()}
    ordered = [(i, t or "") for i, t in rows]
    for (i, t), (_, nxt) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        assert out[i].n_chars == len(t)
        assert out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= out[i].near_next <= 1 and 0 <= out[i].near_edited <= 1
    assert out[1].fingerprint == out[2].fingerprint
    assert out[15].near_edited > out[15].near_next + 0.1


def test_simhash_search_finds_all(spark):
    rng = random.Random(1)
    prints = [rng.getrandbits(128) for _ in range(150)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, 5))) for p in prints[:60]]
    df = spark.createDataFrame([(i, f"{p:032x}") for i, p in enumerate(prints)], "doc_id long, fingerprint string")
    got = {(r.doc_id, r.match, r.distance) for r in simhash.search(df, df, len(prints)).collect()}
    want = {(i, f"{q:032x}", (p ^ q).bit_count()) for i, p in enumerate(prints) for q in prints if (p ^ q).bit_count() <= simhash.RADIUS}
    assert got == want


def test_simhash_finds_near_documents(spark, tmp_path):
    from ledgerloom.llm import queries

    rng = random.Random(8)
    base = [[f"w{rng.randrange(5000)}" for _ in range(100)] for _ in range(60)]
    rows = [(20 * i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):  # ten terms of 96 leave, ten come: likeness 86 / 106
        rows.append((20 * i + 1, " ".join([*w[:50], "x", *w[51:56], "y", *w[57:]])))
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in queries.op1_simhash(spark, str(tmp_path)).collect()}
    found = [20 * i + 1 in {n.doc_id for n in out[20 * i].near} for i in range(60)]
    assert sum(found) >= 57
    for i in range(60):
        near = out[20 * i].near
        assert out[20 * i].n_in_radius == sum(n.copies for n in near) - 1
        assert {n.doc_id for n in near} <= {20 * i, 20 * i + 1}


@pytest.mark.parametrize("radius", [3, 28])
def test_simhash_search_is_exact_at_any_radius(spark, radius):
    rng = random.Random(2)
    prints = [rng.getrandbits(128) for _ in range(60)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, 32))) for p in prints for _ in range(3)]
    df = spark.createDataFrame([(i, f"{p:032x}") for i, p in enumerate(prints)], "doc_id long, fingerprint string")
    got = {(r.doc_id, r.match, r.distance) for r in simhash.search(df, df, len(prints), radius).collect()}
    want = {(i, f"{q:032x}", (p ^ q).bit_count()) for i, p in enumerate(prints) for q in prints if (p ^ q).bit_count() <= radius}
    assert got == want


URLS = [
    (1, "http://a.example.com/en/7x?q=1"), (2, "https://EXAMPLE.com/en/8#t"), (3, None), (4, "no scheme"), (5, "http://x.example.net/de/81"),
    (6, "http://x.net/de/1"), (7, "http://notexample.net/fr"), (8, "http://casino-win.example.org/de/1"), (9, "http://org/es/"), (10, "://"),
]


def test_url_filter(spark):
    from ledgerloom.llm.queries import URL_PATTERNS, URL_RULES

    df = spark.createDataFrame(URLS, "page_id long, url string")
    out = {r.page_id: r for r in url_filter.filter_urls(df, URL_RULES, URL_PATTERNS).collect()}
    rule = {1: "example.com/en/7", 2: "com/en/", 5: "example.net/de/8", 6: "net/de/", 9: "org/es/"}
    for i, _ in URLS:
        assert out[i].rule == rule.get(i)
    assert [out[i].verdict for i in (1, 2, 3, 5, 6, 8, 9)] == ["allow", "block", "allow", "block", "allow", "block", "block"]
    assert (out[3].host, out[3].path) == ("", "") == (out[4].host, out[4].path)
    joined = url_filter.filter_urls(df, URL_RULES, URL_PATTERNS, inline_rules=0)
    assert plain(joined.select("page_id", "verdict")) == plain(url_filter.filter_urls(df, URL_RULES, URL_PATTERNS).select("page_id", "verdict"))


def test_url_words_at_any_border(spark, tmp_path):
    import duckdb

    from ledgerloom.llm import queries

    blocked = ["https://x.com/casino", "https://site.xxx", "https://x.com/?login", "http://x.fr:poker", "x+spam+y", "casino", "http://x.fr/a;ads%20", "http://x.fr/CART"]
    allowed = ["http://x.fr/casinos", "http://x.fr/mycasino", "http://x.fr/casino2", "http://x.fr/roads"]
    urls = [(i, u) for i, u in enumerate([*blocked, *allowed])]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    out = queries.op2_url_filter(spark, str(tmp_path))
    assert {r.page_id: r.verdict for r in out.collect()} == {i: "block" if i < len(blocked) else "allow" for i, _ in urls}
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    ref = con.execute(queries.OP2_SQL)
    names = [c[0] for c in ref.description]
    assert plain(out.select(*names)) == sorted(ref.fetchall())


def test_decontamination(spark, rows):
    item = "The quick brown fox jumps over the lazy dog while seven wizards box with quite many jolly quacking frogs near the old river bank today."
    edited = item.replace("lazy", "lazzy").replace("wizards", "wizard")
    docs = [*rows, (100, "Lead in text. " + item + " And out."), (101, "x " + edited), (102, item[:60]), (103, item.upper().replace(" ", "\n"))]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short"), (4, "")], "item_id long, text string")
    got = decontam.contaminated(frame(spark, docs), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(100, 1), (101, 1), (103, 1)}


@pytest.mark.parametrize("size", [71, 80, 100, 130])
def test_every_excerpt_of_an_item_is_found(spark, size):
    rng = random.Random(6)
    item = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(40))
    docs = [(i, "Zz! " + item[i : i + size] + " Yy?") for i in range(len(item) - size + 1)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontam.contaminated(frame(spark, docs), bench).count() == len(docs)


def test_banded_edits_against_plain():
    rng = random.Random(2)

    def plain_edits(p, t, band):
        best = 1 << 30
        for s in range(band + 1):
            row = {j: 0 if j == s else 1 << 20 for j in range(len(t) + 1)}
            for j in range(s + 1, len(t) + 1):
                row[j] = row[j - 1] + 1
            for i, ch in enumerate(p, 1):
                new = {}
                for j in range(len(t) + 1):
                    inside = 0 <= j - i <= band
                    new[j] = min(row[j] + 1, (row[j - 1] + (t[j - 1] != ch)) if j else 1 << 20, (new[j - 1] + 1) if j else 1 << 20) if inside else 1 << 20
                row = new
            best = min(best, *row.values())
        return best

    for _ in range(60):
        m, band = rng.randint(3, 8), rng.randint(1, 5)
        p, t = ([rng.choice([1, 2, 3]) for _ in range(n)] for n in (m, m + band))
        got, _ = decontam.banded_edits(np.array([p]), np.array([m]), np.array([t]))
        assert got[0] == plain_edits(p, t, band)


def test_langid(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs)
    out = langid.predict(docs, model).join(docs, "doc_id").where(langid.held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)
    odd = {r.doc_id: r for r in langid.predict(frame(spark, texts()), model).collect()}
    assert {odd[i].lang_pred for i in (4, 5, 6, 16)} == {"und"} and odd[4].score == 0
    assert all(0 <= r.score <= 1 for r in odd.values())


def test_langid_sample_size(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text", "if(id % 2 = 0, 'en', 'de') as lang")
    seen = []
    monkeypatch.setattr(langid.Model, "fit_features", lambda x, langs: seen.extend(langs))
    langid.train(docs)
    assert all(seen.count(c) == langid.PER_LANGUAGE for c in ("en", "de"))


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = [*rows, (19, "日本語 <|endoftext|>  \u0085 x"), (19, "twin id")]
    out = packing.pack(frame(spark, docs), with_ids=True).collect()
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)
    by_seq: dict = {}
    for r in out:
        ids = np.frombuffer(r.ids, "<u4")
        assert r.length == len(ids) <= 1024 and zlib.crc32(r.ids) == r.ids_crc32
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        mine = sorted((r for r in out if r.doc_id == i), key=lambda r: r.piece)
        assert [x for r in mine for x in np.frombuffer(r.ids, "<u4")] == ids
        assert all(r.length == 1024 for r in mine[1:])
    assert any(np.array_equal(np.frombuffer(r.ids, "<u4")[:-1], tok.encode(docs[-2][1], add_special_tokens=False).ids) for r in out if r.doc_id == 19)


def test_fast_encoder_equals_the_exact_one():
    enc = packing.encoder()
    text = "".join(chr(c) for c in range(0x250)) + " ".join(chr(c) * 2 for c in range(0x250)) + " it's 12 3  x\n\n y"
    assert enc.fast.encode_ordinary(text) == enc.exact.encode(text, add_special_tokens=False).ids


def test_sharding(spark, rows):
    out = sharding.shard_rows(frame(spark, [*rows, rows[0]]), 5).collect()
    by: dict = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
        assert sharding.place(r.row_no, len(out), 5) == (r.shard, r.slot) and sharding.row_at(r.shard, r.slot, len(out), 5) == r.row_no
        text = dict(rows)[r.doc_id] or ""
        assert (r.size, r.text_crc32) == (len(text.encode()) + 8, zlib.crc32(text.encode()))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_feistel_is_a_permutation(n):
    f = sharding.Feistel(n)
    p = f.forward(np.arange(n))
    assert sorted(p) == list(range(n)) and (f.backward(p) == np.arange(n)).all()


def test_gap_coding():
    gaps = np.array([0, 1, 254, 255, 256, 509, 510, 511, 100000, 3])
    data, size = postings.encode_gaps(gaps)
    assert (postings.decode_gaps(data) == gaps).all() and size.sum() == len(data)


def test_no_rows(spark):
    none = frame(spark, [], 1)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert substring_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert simhash.fingerprint_edits(none).count() == 0
    assert decontam.contaminated(none, bench).count() == 0
    assert langid.predict(none, langid.train(none)).count() == 0
    assert packing.pack(none).count() == 0
    assert sharding.shard_rows(none, 3).count() == 0
    assert lm_score.score(none, lm_score.fit(none, replicas=2, steps=2)).count() == 0


def test_null_ids(spark):
    rows = [(None, "a b c d e f g h i j k l m n o"), (1, "a b c d e f g h i j k l m n o")]
    docs = frame(spark, rows)
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()} == {None: 0, 1: 15}
    assert {r.doc_id: r.kept for r in minhash.near_duplicates(docs).collect()} == {None: True, 1: False}
    for out in (suffix_dedup.remove_repeats(docs), simhash.fingerprint_edits(docs), packing.pack(docs), sharding.shard_rows(docs, 2)):
        assert out.count() == 2
