"""Clusters from few links against clusters from all links, and near misses across clusters."""

from pyspark.sql import functions as F

from ledgerloom.operators import dedup
from ledgerloom.operators.graph import connected_components

PLACES = ["12 Oak Street", "12 Oak St STE 3", "14 Oak Street", "P.O. Box 12", "P.O. Box 7", "PO Box", "Oak Street", "Oak Stret", ""]
#: Names with the kinds of address that they bear.
BORNE = {"blue ring": [0, 1, 2, 8], "blue rings": [0, 2, 4], "old anvil": [3, 4], "old anvill": [3, 5], "red bolt": [0, 3], "red bolts": [2, 4], "green plate": [0, 1, 2, 6, 7], "green plates": [0, 2, 6], "": [0, 3, 8], "cold lamp": [3, 4], "cold lamps": [0, 2], "tin horn": [3, 4], "small gear": [0, 1, 2, 2, 7]}


def _prepared(spark):
    rows = [(n, PLACES[i]) for n, at in BORNE.items() for i in at]
    return dedup.preprocess(spark.createDataFrame([(37 * i % 1009, *r) for i, r in enumerate(rows)], "k long, name string, address string"), "k", "name", "address")


def _groups(links):
    out = {}
    for r in connected_components(links, "a", "b").collect():
        out.setdefault(r["component"], set()).add(r["node"])
    return out


def test_components_are_the_same(spark):
    want = _groups(dedup.duplicate_links(_prepared(spark)))
    assert _groups(dedup.component_links(_prepared(spark))) == want and len(want) > 3


def test_links_grow_with_the_forms(spark):
    """Blank and boxed forms of one name: all pairs of them would be links."""
    rows = spark.range(600).selectExpr("id as k", "'blue ring' as name", "case when id % 3 = 0 then '' when id % 3 = 1 then concat('P.O. Box ', id) else concat(id, ' Oak Street') end as address")
    assert dedup.component_links(dedup.preprocess(rows, "k", "name", "address")).count() < 600


def test_near_misses_make_no_pair_of_a_cluster(spark, monkeypatch):
    """4,000 records of one name, all but one in one cluster: only its 3,999 pairs with them meet."""
    rows = spark.range(4000).selectExpr("id as k", "'blue ring' as name", "concat(id % 7, ' Oak Street') as address")
    members = dedup.preprocess(rows, "k", "name", "address").withColumn("cluster", F.when(F.col("idx") == 5, 1).otherwise(0))
    met, join = [], dedup.tiled_join
    monkeypatch.setattr(dedup, "tiled_join", lambda a, b, on: met.append(a.join(b, on).count()) or join(a, b, on))
    assert dedup.near_misses(members).count() == 3999 and met == [2 * 3999]
