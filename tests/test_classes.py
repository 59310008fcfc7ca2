"""Decisions by classes against decisions by pairs, on records that repeat and on odd ones."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import classes, linkage

NAMES = ["blue ring llc", "Blue Ring Inc", "ring blue", "blue anvil & co", "", "-", "blue", "bluebell gardens of the north", None, "red bolt"]
PLACES = ["12 Oak Street", "12 Oak St STE 3", "12-a Oak Road", "\t12 Oak Street", "٣ Oak Street", "", "-", None, "P.O. Box 12", "7 Elm Avenue", "Oak Street"]


@pytest.fixture(scope="module")
def sides(spark):
    rows = [(3 * (len(PLACES) * i + j) + k, n, p) for i, n in enumerate(NAMES) for j, p in enumerate(PLACES) for k in range(3 if (i + j) % 4 == 0 else 1)]
    a = spark.createDataFrame(rows, "ra long, name string, address string")
    b = spark.createDataFrame([r for r in rows if r[0] % 5 != 1], "rb long, name string, address string")
    return linkage.prepared(a, "a", "ra", "name", "address"), linkage.prepared(b, "b", "rb", "name", "address")


@pytest.fixture(scope="module")
def by_pairs(sides):
    return {(r["ra"], r["rb"]): r["decision"] for r in linkage.prejudge(linkage.rule_filter(*sides)).collect()}


def test_counts(sides, by_pairs):
    levels = classes.decided(*sides)[2]
    stats = classes.match_stats(levels).first()
    want = list(by_pairs.values())
    assert (stats["total"], stats["auto_match"], stats["auto_reject"], stats["needs_review"]) == (len(want), want.count("AUTO_MATCH"), want.count("AUTO_REJECT"), want.count(None))
    assert 0 < stats["auto_match"] < stats["total"] and stats["auto_reject"]
    assert sum(x.pairs.count() for x in levels) < len(want)  # classes, not pairs


def test_matches(sides, by_pairs):
    a, b, levels = classes.decided(*sides, matches=True)
    want = {k for k, v in by_pairs.items() if v == "AUTO_MATCH"}
    got = [tuple(r) for r in classes.matched_pairs(a, b, levels, ["ra", "rb"]).collect()]
    assert len(got) == len(want) and set(got) == want
    for i, (records, s, key) in enumerate(((a, "a", "ra"), (b, "b", "rb"))):
        assert sorted(r[0] for r in classes.matched_keys(records, levels, s, key).collect()) == sorted({k[i] for k in want})


def test_no_records(sides):
    a, b = sides
    stats = classes.match_stats(classes.decided(a.where(F.lit(False)), b)[2]).first()
    assert tuple(stats) == (0, 0, 0, 0, 0, 0)


def test_like_and_blank_pairs(sides):
    keys = lambda df: sorted((r["ra"], r["rb"]) for r in df.collect())
    scored = linkage.scored(linkage.candidate_pairs(*linkage.written(*sides))).cache()
    assert keys(linkage.like_pairs(*sides, 80, 90)) == keys(scored.where("name_score >= 80 and address_score >= 90")) != []
    assert keys(linkage.blank_pairs(*sides, 70)) == keys(scored.where("(a_blank or b_blank) and name_score >= 70")) != []


def test_all_pairs_of_records(sides):
    """Decisions and simple scores of every candidate, from classes."""
    want = {(r["ra"], r["rb"]): (r["decision"], round(r["simple_score"], 6)) for r in linkage.prejudge(linkage.rule_filter(*sides)).collect()}
    a, b, levels = classes.decided(*sides)
    rows = classes.record_pairs(a, b, levels, ["ra", "rb", "decision", "simple_score"]).collect()
    assert len(rows) == len(want) and {(r["ra"], r["rb"]): (r["decision"], round(r["simple_score"], 6)) for r in rows} == want
    open_ = classes.record_pairs(a, b, levels, ["ra", "rb"], F.col("decision").isNull()).collect()
    assert sorted(map(tuple, open_)) == sorted(k for k, v in want.items() if v[0] is None) != []


@pytest.mark.parametrize("limits", [{}, {"LISTED": 2, "LARGE": 1}])
def test_pairs_from_lists(sides, by_pairs, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(classes, name, value)
    a, b, levels = classes.decided(*sides)
    pairs = classes.record_pairs(a, b, levels, ["ra", "rb", "b_name", "decision"])
    rows = pairs.collect()
    assert len(rows) == len(by_pairs) and {(r["ra"], r["rb"]): r["decision"] for r in rows} == by_pairs
    names = {r["rb"]: r["b_name"] for r in b.collect()}
    assert all(r["b_name"] == names[r["rb"]] for r in rows)
    above = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert above.index("Generate explode") < above.index("Join")  # before, a merge join made the pairs


def test_open_pairs_of_each_record(sides, by_pairs):
    """How many questions each record has, without a list of them."""
    a, _, levels = classes.decided(*sides)
    got = {r["ra"]: r["pairs"] for r in classes.pairs_of_records(a, levels, "a", "ra", F.col("decision").isNull()).collect()}
    want = [k for k, v in by_pairs.items() if v is None]
    assert got == {k: sum(x == k for x, _ in want) for k in {x for x, _ in want}} != {}
