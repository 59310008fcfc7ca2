"""Collapsing clusters and describing them (A2-A4 drivers, L-A17 to L-A20, O8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import values as V
from ledgerloom.functions.normalize import base_and_suffix, text


def column_groups(columns: list[str]) -> dict[str, list[str]]:
    """Numbered columns by base, in the order of their numbers; the bare column comes first."""
    groups: dict[str, list[tuple[int, str]]] = {}
    for c in columns:
        base, n = base_and_suffix(c)
        groups.setdefault(base, []).append((n or 0, c))
    return {b: [c for _, c in sorted(m)] for b, m in groups.items() if len(m) > 1 or m[0][0]}


def merge_groups(df: DataFrame, longest: list[str], phones: list[str], first: list[str]) -> DataFrame:
    """A2-A4 on the numbered columns of each base; the numbered columns go."""
    groups, out = column_groups(df.columns), df
    for how, bases in ((V.longest, longest), (V.merged_phones, phones), (lambda a: V.first_filled(*a), first)):
        for base in bases:
            cols = groups.get(base, [base] if base in df.columns else [])
            if cols:
                merged = how([F.col(c) for c in cols]) if bases is first else how(F.array(*(text(F.col(c)) for c in cols)))
                out = out.withColumn(base, merged)
    drop = [c for b in [*longest, *phones, *first] for c in groups.get(b, []) if c != b]
    return out.drop(*drop)


def widened(records: DataFrame, cluster: str, order: str, columns: list[str]) -> DataFrame:
    """L-A19 on arrays: constant columns keep one value, varying ones all, in order."""
    w = F.array_sort(F.collect_list(F.struct(F.col(order), *(text(F.col(c)).alias(c) for c in columns))))
    packed = records.groupBy(cluster).agg(w.alias("_rows"))
    cell = lambda c: F.transform("_rows", lambda r: r[c])
    return packed.select(cluster, *(F.when(F.size(F.array_distinct(cell(c))) == 1, F.slice(cell(c), 1, 1)).otherwise(cell(c)).alias(c) for c in columns))


def numbered_columns(wide: DataFrame, cluster: str, column: str, most: int) -> DataFrame:
    """Arrays as ``column_1 .. column_n``, at the edge only."""
    return wide.select(cluster, *(F.coalesce(F.get(F.col(column), F.lit(i)), F.lit("")).alias(f"{column}_{i + 1}") for i in range(most)))


def cluster_sizes(assigned: DataFrame, cluster: str = "cluster") -> DataFrame:
    """L-A17: how many clusters of each size, and the rows in them."""
    sizes = assigned.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("clusters")).withColumn("rows", F.col("size") * F.col("clusters"))


def varying_columns(records: DataFrame, cluster: str, columns: list[str]) -> DataFrame:
    """L-A18: for each column, in how many clusters of two rows and more it varies."""
    distinct = records.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"), *(F.count_distinct(text(F.col(c))).alias(c) for c in columns)).where("_n > 1")
    stacked = ", ".join(f"'{c}', `{c}`" for c in columns)
    return distinct.selectExpr(f"stack({len(columns)}, {stacked}) as (column_name, distinct_values)").where("distinct_values > 1").groupBy("column_name").agg(F.count(F.lit(1)).alias("clusters"))


def top_columns(counts: DataFrame, n: int = 10) -> DataFrame:
    """L-O8: columns whose count reaches the n-th greatest (all of them if fewer)."""
    w = Window.orderBy(F.desc("clusters"), "column_name")  # one row a column
    ranked = counts.withColumn("_r", F.row_number().over(w))
    least = ranked.where(F.col("_r") <= n).agg(F.min("clusters").alias("_least"))
    return ranked.crossJoin(F.broadcast(least)).where("clusters >= _least").select("column_name", "clusters")


def empty_columns(df: DataFrame) -> DataFrame:
    """L-A20: (column_name) of columns without any value."""
    counts = df.agg(*(F.count(F.when(text(F.col(c)) != "", 1)).alias(c) for c in df.columns))
    stacked = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return counts.selectExpr(f"stack({len(df.columns)}, {stacked}) as (column_name, n)").where("n = 0").select("column_name")


def best_per_key(df: DataFrame, key: str, score: str, order: str) -> DataFrame:
    """L-A21, L-A22: the best row of each key, the first of equals."""
    w = Window.partitionBy(key).orderBy(F.desc(score), order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def union_all(parts: list[DataFrame]) -> DataFrame:
    """U1."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
