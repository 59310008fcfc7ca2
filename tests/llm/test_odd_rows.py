"""Odd rows: very long texts, null and repeated ids, characters cut in half, clashing columns, no rows."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import decontam, langid, lm_score, minhash, packing, queries, sharding, simhash, substring_dedup, suffix_dedup, url_filter
from ledgerloom.llm.common import unused
from tests.llm import brute

SF = "/root/testdata/sf0.001"
RUN = hashlib.sha512(b"run").hexdigest()  # without a period


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "x " + " \n" * 300_000 + "y", "a" * 300_000, "7" * 300_000, "." * 300_000])
def test_packing_of_long_runs(text):
    """Long runs of white space stack up in the fast table's pattern; ids are those of the exact encoder."""
    assert packing.encoder().ids(text) == packing.encoder().exact.encode(text, add_special_tokens=False).ids


def test_packing_cuts_a_long_text(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "x"), (2, "x")], "doc_id long, text string")
    out = packing.pack(docs).collect()
    assert sum(r.length for r in out if r.doc_id == 1) == 1_000_001 and sum(r.doc_id == 2 for r in out) == 2


def test_clean_keeps_replacement_characters(spark):
    """A character cut in half goes as a whole; U+FFFD that the text holds itself stays."""
    # \u00a9 and \u00e9 end in the same byte, \u20ac and \u20ad begin with the same two
    rows = [(1, "a" + RUN), (2, "mark � here é" + RUN), (3, "xé" + RUN + "€"), (4, "y©" + RUN + "₭ � end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffix_dedup.clean(docs).collect()}
    assert got[1] == rows[0][1] and got[2] == "mark � here é" and got[3] == "x€"
    assert got[4] == "y � end"


def test_clean_with_clashing_columns(spark):
    rows = [(i, t, 5, "x", "v", "k") for i, t in ((1, RUN), (2, "b" + RUN), (None, None))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, _digest string, _valid string, _KEPT string")
    out = suffix_dedup.clean(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text, r._id, r._digest) for r in out.collect()) == [(0, None, 5, "x"), (1, RUN, 5, "x"), (2, "b", 5, "x")]
    assert unused(docs, "_Id", "new") == ["_Id_", "new"]


@pytest.mark.parametrize("key", ["cast(null as long)", "5L"])
def test_training_sample_is_bounded_without_ids(spark, key):
    """Null or one repeated id: rows are chosen by their text too, and copies of a row are one."""
    docs = spark.range(9000).selectExpr(f"{key} as doc_id", "concat('text ', id % 4000) as text", "if(id % 2 = 0, 'en', 'de') as lang")
    rows = docs.selectExpr("doc_id as k", "text", "lang as l")
    got = langid.sample(rows, 300).groupBy("l").count().collect()
    assert {r["l"]: r["count"] for r in got} == {"en": 300, "de": 300}
    assert langid.sample(docs.selectExpr("doc_id as k", "'same' as text", "lang as l"), 300).count() == 2


def test_features_of_a_long_text_are_those_of_its_bytes(monkeypatch):
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("abcdeé "), 5000))
    one = langid.features(langid.texts_of(pa.array([text])))
    monkeypatch.setattr(langid, "SLICE", 700)
    assert np.allclose(one, langid.features(langid.texts_of(pa.array([text]))), atol=1e-6)
    many = langid.features(langid.texts_of(pa.array([text, "", "abc", text[:900]])))
    assert np.allclose(many[0], one[0], atol=1e-6) and not many[1].any()


CLASH = {"id": 1, "digest": "d", "text_": "t", "k": 2, "bucket": 3, "component": 4, "kept": True, "_id": 5, "_digest": "e", "_own": "o", "n": 6, "g": 7, "page_id_": 8}


@pytest.fixture(scope="module")
def odd(spark):
    prose = "the quick brown fox jumps over the lazy dog while seven small birds watch from a green fence near the old mill " * 4
    rows = [(1, prose, "en"), (2, prose, "en"), (2, prose, "en"), (3, None, "de"), (None, prose + " tail", None), (None, "", "en"), (4, "ab " * 60_000, "en"), (5, "� é", "de"), (6, "x", None), (7, "der kleine hund läuft " * 9, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs.select("*", F.lit("web").alias("source"), F.length("text").cast("long").alias("n_chars"), *(F.lit(v).alias(c) for c, v in CLASH.items()))


OPERATORS = {
    "simhash": lambda d, s: simhash.fingerprint_edits(d),
    "substring": lambda d, s: substring_dedup.remove_repeats(d),
    "minhash": lambda d, s: minhash.near_duplicates(d),
    "suffix": lambda d, s: suffix_dedup.remove_repeats(d),
    "langid": lambda d, s: langid.predict(d, langid.train(d)),
    "sharding": lambda d, s: sharding.shard_rows(d, 3),
    "lm_score": lambda d, s: lm_score.score(d, lm_score.fit(d)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_a_row(spark, odd, name):
    out = OPERATORS[name](odd, spark)
    got = sorted(str(r.doc_id) for r in out.select("doc_id").collect())
    assert got == sorted(str(r.doc_id) for r in odd.select("doc_id").collect())


def test_odd_rows_of_the_others(spark, odd):
    items = spark.createDataFrame([(1, "seven small birds watch from a green fence near the old mill and more of it"), (2, None), (3, ""), (None, "x" * 80)], "item_id long, text string")
    found = decontam.contaminated(odd.withColumn("item_id", F.lit(1)), items)
    assert sorted(str(r.doc_id) for r in found.collect()) == ["1", "2", "None"] or {str(r.doc_id) for r in found.collect()} == {"1", "2", "None"}
    assert packing.pack(odd).where("piece = 0").count() == odd.count()
    pages = spark.createDataFrame([(1, None, "h"), (2, "", "h"), (2, "", "h"), (None, "http://A.com/en/" + "x" * 200_000, "h"), (3, "://", "h")], "page_id long, url string, host string")
    out = url_filter.filter_urls(pages, queries.URL_RULES, queries.URL_PATTERNS)
    assert out.count() == 5 and out.where("page_id is null").first().rule == "com/en/"


def test_stages_with_odd_rows(spark, odd, tmp_path):
    """Each stage on its predecessor's rows: columns stay, rows without text go first."""
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        path = str(tmp_path / f"s{i}")
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == odd.columns, name
        docs = after
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert 3 not in kept and 7 in kept
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).where("piece = 0").count() == docs.count()


def test_stages_without_rows(spark, odd, tmp_path):
    spark.read.parquet(f"{SF}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0, name
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(pages, queries.URL_RULES, queries.URL_PATTERNS).count() == 0


def test_repeated_rows_share_a_component(spark, odd):
    got = minhash.near_duplicates(odd).where("doc_id = 2 or doc_id = 1").collect()
    assert {r.component_id for r in got} == {None}, "the null id comes before every other"
    assert brute.near([(r.doc_id if r.doc_id is not None else -1, r.text) for r in odd.collect()], 5)
