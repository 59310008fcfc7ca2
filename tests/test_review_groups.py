"""Groups of clusters that open pairs link."""

from ledgerloom.operators import review


def test_pairs_are_made_once(spark):
    """Components and groups read the same links; before, each made all pairs anew."""
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(1, 2, "UNCERTAIN"), (2, 3, "UNCERTAIN"), (4, 5, "UNCERTAIN"), (4, 6, "DUPLICATE"), (7, 8, "UNCERTAIN")]
    pairs = spark.createDataFrame(rows, "a long, b long, decision string").mapInArrow(seen, "a long, b long, decision string")
    assigned = spark.createDataFrame([(i, {8: 7}.get(i, i) * 10) for i in range(1, 9)], "idx long, cluster long")
    got = {r["component"]: (r["clusters"], [tuple(x) for x in r["linking_pairs"]]) for r in review.cluster_groups(pairs, assigned).collect()}
    assert got == {10: ([10, 20, 30], [(1, 2), (2, 3)]), 40: ([40, 50], [(4, 5)])}
    assert made.value == len(rows)
