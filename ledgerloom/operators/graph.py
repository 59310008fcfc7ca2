"""Connected components of an edge table.

Alternates the large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond"): every step replaces edges by edges to a
smaller neighbour and never holds a node's neighbours together, so hubs are
only skewed join keys.  Each round is written once; rounds grow with the
logarithm of the diameter.  Edge files are small for their rows, so steps are
merge joins and nothing is broadcast by its file's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.workspace import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least.hint("merge"), "u").select(F.col("m").alias("u"), "v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least.hint("merge"), "v").where("u > m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return moved.unionByName(least.select(F.col("m").alias("u"), "v")).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return row["n"], row["x"] or 0


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", work: Workspace | None = None) -> DataFrame:
    """(node, component) of every node that has an edge to another; the component is its least node.

    Null ends and loops are ignored; parallel edges and either direction count once.
    """
    work = work or Workspace(edges.sparkSession, "components")
    a, b = F.col(src), F.col(dst)
    plain = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    now = work.save(plain, "edges-0")
    state, step = _state(now), 0
    while state[0]:
        step += 1
        new = work.save(_small_star(_large_star(now)), f"edges-{step}")
        if step > 1:
            work.drop(f"edges-{step - 1}")
        now, before, state = new, state, _state(new)
        if state == before:
            break
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )
