"""Decisions as an append-only log, and the views a reviewer reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.graph import connected_components
from ledgerloom.sources.workspace import Workspace

#: Order of run states in the city list.
STATUS_ORDER = {"paused": 0, "running": 1, "failed": 2, "pending": 3, "not_started": 4, "completed": 5}


def latest(log: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The last entry of each key, by one aggregation that combines before it shuffles."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("_e")).select(key, *(F.col(f"_e.{c}").alias(c) for c in rest))


def reviewed(pairs: DataFrame, log: DataFrame, key: str = "pair_id") -> DataFrame:
    """Pairs with the latest human decision in place of what was open."""
    last = latest(log, key, "reviewed_at", "event_id").select(key, F.col("decision").alias("_human"))
    return pairs.join(last, key, "left").withColumn("final_decision", F.coalesce("_human", "final_decision")).drop("_human")


def pending(pairs: DataFrame, column: str = "final_decision", value: str = "NEEDS_REVIEW") -> DataFrame:
    """P13, A13."""
    return pairs.where(F.col(column) == value)


def review_queue(pairs: DataFrame, registry: DataFrame, master: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """Open pairs with both records nested; pairs that lost a record are left out."""
    a = registry.select(a_key, F.struct(*registry.columns).alias("registry"))
    b = master.select(b_key, F.struct(*master.columns).alias("master"))
    return pending(pairs).join(a, a_key).join(b, b_key)


def searched(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows with the text in any of the columns, without case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(query.lower()))
    return df.where(found)


def status_rank(c):
    rank = F.lit(9)
    for name, n in STATUS_ORDER.items():
        rank = F.when(c == name, n).otherwise(rank)
    return rank


def city_list(cities: DataFrame, runs: DataFrame) -> DataFrame:
    """Cities with their last run, by state (O5) and then the newest first (O1)."""
    last = latest(runs, "city_id", "run_id", "run_id").select("city_id", "run_id", "status")
    joined = cities.join(last, "city_id", "left").withColumn("status", F.coalesce("status", F.lit("not_started")))
    return joined.withColumn("rank", status_rank(F.col("status"))).orderBy("rank", F.desc("created_at"), "city_id")


def cluster_groups(pairs: DataFrame, assigned: DataFrame) -> DataFrame:
    """Open pairs grouped by the components of the clusters they link.

    ``pairs``: a, b, decision; ``assigned``: idx, cluster.  One row a group:
    the sorted clusters and the linking pairs.  Links are written, since
    components and groups both read them.
    """
    of = lambda s: assigned.select(F.col("idx").alias(s), F.col("cluster").alias(f"{s}_cluster"))
    met = pairs.where("decision = 'UNCERTAIN'").join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b").where("a_cluster <> b_cluster")
    open_ = Workspace(pairs.sparkSession, "groups").save(met, "links")
    labels = connected_components(open_, "a_cluster", "b_cluster").withColumnRenamed("node", "a_cluster")
    linked = open_.join(labels.hint("merge"), "a_cluster")
    return linked.groupBy("component").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("a_cluster", "b_cluster"))))).alias("clusters"),
        F.array_sort(F.collect_list(F.struct("a", "b"))).alias("linking_pairs"),
    )


def resume_allowed(pairs: DataFrame) -> bool:
    """Nothing of either pass is open."""
    return pending(pairs).isEmpty()


# ---------------------------------------------------------------- decisions on duplicate pairs


def duplicate_queue(pairs: DataFrame) -> DataFrame:
    """Open pairs with what a reviewer reads."""
    return pending(pairs, "decision", "UNCERTAIN")


def duplicate_results(pairs: DataFrame) -> DataFrame:
    """All pairs by decision, the likest first, then by id."""
    return pairs.orderBy("decision", F.desc("similarity"), "pair_id")


def match_results(pairs: DataFrame, registry: DataFrame, master: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """Confirmed pairs with both records nested, by pair."""
    a = registry.select(a_key, F.struct(*registry.columns).alias("registry"))
    b = master.select(b_key, F.struct(*master.columns).alias("master"))
    return pairs.where(F.col("final_decision").isin("AUTO_MATCH", "HUMAN_ACCEPT")).join(a, a_key).join(b, b_key).orderBy(a_key, b_key)


def decided(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pairs with the decisions of a batch (pair_id, decision); ids that no pair bears are ignored."""
    new = decisions.select("pair_id", F.col("decision").alias("_new"))
    return pairs.join(new, "pair_id", "left").withColumn("decision", F.coalesce("_new", "decision")).drop("_new")


def remaining(pairs: DataFrame, decisions: DataFrame, column: str = "decision", open_value: str = "UNCERTAIN") -> DataFrame:
    """(processed, remaining) after a batch, in one row."""
    known = decisions.join(pairs.select("pair_id"), "pair_id", "left_semi").agg(F.count(F.lit(1)).alias("processed"))
    left = decided(pairs.withColumnRenamed(column, "decision"), decisions).agg(F.count_if(F.col("decision") == open_value).alias("remaining"))
    return known.crossJoin(left)  # one row each


def valid_ids(decisions: DataFrame, column: str = "pair_id") -> DataFrame:
    """R2: rows whose id is a whole number, as a number."""
    return decisions.withColumn(column, F.trim(F.col(column).cast("string")).try_cast("long")).where(F.col(column).isNotNull())


def relabelled(assigned: DataFrame, pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Clusters linked by pairs that a batch calls duplicates take their least number, whole components at once."""
    of = lambda s: assigned.select(F.col("idx").alias(f"index_{s}"), F.col("cluster").alias(f"{s}_cluster"))
    met = pairs.join(decisions.where("decision = 'DUPLICATE'").select("pair_id"), "pair_id", "left_semi")
    links = met.join(of("a"), "index_a").join(of("b"), "index_b").select("a_cluster", "b_cluster")
    labels = connected_components(links, "a_cluster", "b_cluster").withColumnRenamed("node", "cluster")
    return assigned.join(labels, "cluster", "left").withColumn("cluster", F.coalesce("component", "cluster")).drop("component")


def merged(assigned: DataFrame, clusters: list[int]) -> DataFrame:
    """A stated list of clusters becomes the least of them."""
    return assigned.withColumn("cluster", F.when(F.col("cluster").isin(*clusters), F.lit(min(clusters))).otherwise(F.col("cluster")))


def merge_decisions(pairs: DataFrame, assigned: DataFrame, clusters: list[int]) -> DataFrame:
    """Open pairs that touch one of the merged clusters are duplicates."""
    side = lambda s: assigned.select(F.col("idx").alias(f"index_{s}"), F.col("cluster").alias(f"_{s}"))
    both = pairs.join(side("a"), "index_a", "left").join(side("b"), "index_b", "left")
    known = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    touched = known & (F.col("_a").isin(*clusters) | F.col("_b").isin(*clusters)) & (F.col("decision") == "UNCERTAIN")
    return both.withColumn("decision", F.when(touched, "DUPLICATE").otherwise(F.col("decision"))).select(*pairs.columns)


def clusters_involved(pairs: DataFrame, assigned: DataFrame) -> DataFrame:
    """The clusters of all indexes that open pairs name."""
    open_ = duplicate_queue(pairs)
    named = open_.select(F.col("index_a").alias("idx")).union(open_.select(F.col("index_b").alias("idx"))).distinct()
    return assigned.join(named, "idx", "left_semi").select("cluster").distinct()


def step_log(log: DataFrame) -> DataFrame:
    """The last state of each step of a run, by id."""
    return latest(log, "step_key", "seen_at", "log_id").orderBy("log_id")


def status_with_logs(runs: DataFrame, logs: DataFrame) -> DataFrame:
    """Every run with its step logs in order of their ids."""
    packed = logs.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("log_id", "step", "status"))).alias("logs"))
    return runs.join(packed, "run_id", "left").withColumn("logs", F.coalesce("logs", F.array().cast("array<struct<log_id:bigint,step:string,status:string>>")))


# Columns that a record view hides.
SYSTEM_COLUMNS = ("registry_index", "master_index", "cluster id", "cluster", "lsh_bucket", "norm_name", "is_po_box", "po_box_num", "street_num", "street_name", "norm_address", "business_address")


def record_view(df: DataFrame, hidden: tuple[str, ...] = SYSTEM_COLUMNS) -> DataFrame:
    """P16."""
    return df.drop(*hidden)


def stage_stats(assigned: DataFrame, pairs: DataFrame) -> DataFrame:
    """Records, clusters, merged records and open pairs of the dedup stage, in one row."""
    rows = assigned.agg(F.count(F.lit(1)).alias("records"), F.count_distinct("cluster").alias("clusters"))
    open_ = pairs.agg(F.count_if(F.col("decision") == "UNCERTAIN").alias("open_pairs"))
    return rows.crossJoin(open_).withColumn("merged", F.col("records") - F.col("clusters"))


def first_row(df: DataFrame, order: list[str]) -> DataFrame:
    """One row, the first in a total order; a top-k, never a full sort in one task."""
    return df.orderBy(*order).limit(1)
