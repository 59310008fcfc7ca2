"""Deduplication of one registry."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import normalize as N
from ledgerloom.functions import similarity as S
from ledgerloom.operators import judge
from ledgerloom.operators.graph import connected_components
from ledgerloom.operators.linkage import scored_once, tiled_join
from ledgerloom.sources.workspace import Workspace, shuffle_partitions


def preprocess(records: DataFrame, key: str, name: str, address: str) -> DataFrame:
    """One projection of native expressions; ``kind`` is blank, box, numbered or plain."""
    a = F.col(address)
    norm = N.dedup_name(F.col(name))
    street = N.street_name(a)
    blank = N.text(a).isin("", "-")
    number = N.street_number(a)
    kind = F.when(blank, "blank").when(N.is_po_box(a), "box").when(number != "", "numbered").otherwise("plain")
    return records.select(
        F.col(key).alias("idx"), F.lower(N.text(F.col(name))).alias("raw"), norm.alias("norm"), S.sorted_tokens(norm).alias("tokens"),
        N.dedup_address(a).alias("address"), S.sorted_tokens(street).alias("street"), number.alias("number"), N.po_box_number(a).alias("box"), kind.alias("kind"),
    )


def _sides(df: DataFrame, s: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{s}_{c}") for c in df.columns))


def _dealt(pairs: DataFrame) -> DataFrame:
    """Joins make many pairs from few rows, so pairs are dealt out by both keys before Python scores them."""
    return pairs.repartition(shuffle_partitions(pairs.sparkSession), "a_idx", "b_idx")


def _distinct_forms(df: DataFrame) -> DataFrame:
    """Records with equal forms stand for one another: (forms, least index, members)."""
    forms = [c for c in df.columns if c != "idx"]
    return df.groupBy(*forms).agg(F.min("idx").alias("idx"))


def similar_names(forms: DataFrame, column: str, sorted_column: str | None, least: int, spread: float) -> DataFrame:
    """(a_name, b_name, score) of distinct names that reach the score, both orders and each with itself.

    Names are compared once however many records bear them.  They meet by
    length class: classes grow by ``spread``, the largest ratio of lengths that
    the score allows, so neighbouring classes hold every partner.
    """
    names = forms.select(F.col(column).alias("name"), F.col(sorted_column or column).alias("sorted")).distinct()
    slot = F.floor(F.log(F.greatest(F.length("name"), F.lit(1)).cast("double")) / F.log(F.lit(spread)))
    a = names.select(F.col("name").alias("a_name"), F.col("sorted").alias("a_sorted"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    b = names.select(F.col("name").alias("b_name"), F.col("sorted").alias("b_sorted"), slot.alias("slot"))
    near = a.join(b, "slot").where((F.col("a_name") < F.col("b_name")) & S.length_allows(F.col("a_name"), F.col("b_name"), least)).drop("slot")
    score = S.ratio(F.col("a_name"), F.col("b_name"))
    near = near.repartition(shuffle_partitions(forms.sparkSession))
    if sorted_column:
        score = F.greatest(score, S.ratio(F.col("a_sorted"), F.col("b_sorted")))
    found = near.withColumn("score", score).where(F.col("score") >= least).select("a_name", "b_name", "score")
    back = found.select(F.col("b_name").alias("a_name"), F.col("a_name").alias("b_name"), "score")
    return found.unionByName(back).unionByName(names.select(F.col("name").alias("a_name"), F.col("name").alias("b_name"), F.lit(100.0).alias("score")))


def is_duplicate() -> Column:
    """C1."""
    s, st = F.col("name_score"), F.col("street_score")
    exact = F.col("a_raw") == F.col("b_raw")
    kind = lambda *k: F.col("a_kind").isin(*k) & F.col("b_kind").isin(*k)
    box_a, box_b = F.col("a_kind") == "box", F.col("b_kind") == "box"
    return (
        F.when((F.col("a_kind") == "blank") | (F.col("b_kind") == "blank"), (s >= 83) | exact)
        .when(box_a != box_b, (s >= 83) | exact)
        .when(box_a & box_b, (s >= 83) & ((F.col("a_box") == "") | (F.col("b_box") == "") | (F.col("a_box") == F.col("b_box"))))
        .when(kind("numbered"), (F.col("a_number") == F.col("b_number")) & (s >= 85) & (st >= 80))
        .when(kind("plain"), (s >= 90) & (st >= 90))
        .otherwise((s >= 85) & (st >= 80))
    )


def duplicate_links(prepared: DataFrame) -> DataFrame:
    """(a, b): forms that C1 accepts, by their least record.

    Every case of C1 needs a name score of 83 (equal raw names have 100), so
    names are linked first and forms meet through them; where both sides have a
    number or a box number it is a join key as well.
    """
    return _accepted(*_named_forms(prepared, Workspace(prepared.sparkSession, "dedup")))


def _named_forms(prepared: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    forms = work.save(_distinct_forms(prepared), "forms")
    return forms, work.save(similar_names(forms, "norm", "tokens", 83, 1.5), "names")


def _accepted(forms: DataFrame, linked: DataFrame) -> DataFrame:
    """Pairs of forms that C1 accepts; files of forms are small for their rows, so these meet by merge joins."""
    key = lambda s: F.when(F.col(f"{s}_kind") == "numbered", F.col(f"{s}_number")).when((F.col(f"{s}_kind") == "box") & (F.col(f"{s}_box") != ""), F.concat(F.lit("box "), F.col(f"{s}_box")))
    a = _sides(forms, "a").withColumn("_ka", key("a")).join(linked.withColumnRenamed("a_name", "a_norm").hint("merge"), "a_norm")
    b = _sides(forms, "b").withColumn("_kb", key("b")).withColumnRenamed("b_norm", "b_name").hint("merge")
    same = a.where("_ka is not null").join(b.where("_kb is not null").hint("merge"), (F.col("_ka") == F.col("_kb")) & (a["b_name"] == b["b_name"])).drop(b["b_name"])
    # a numbered address and a box are compared by names alone
    mixed = a.where("_ka is not null").join(b.where("_kb is not null").hint("merge"), "b_name").where("(a_kind = 'box') <> (b_kind = 'box')")
    open_a = a.where("_ka is null").join(b, "b_name")
    open_b = a.where("_ka is not null").join(b.where("_kb is null").hint("merge"), "b_name")
    columns = same.columns
    pairs = same.unionByName(mixed.select(*columns)).unionByName(open_a.select(*columns)).unionByName(open_b.select(*columns)).where("a_idx < b_idx")
    scored = _dealt(pairs).withColumnRenamed("score", "name_score").withColumn("street_score", S.ratio(F.col("a_street"), F.col("b_street")))
    return scored.where(is_duplicate()).select(F.col("a_idx").alias("a"), F.col("b_idx").alias("b"))


def component_links(prepared: DataFrame) -> DataFrame:
    """(a, b) with the same components as ``duplicate_links``, far fewer of them.

    C1 accepts a blank address with any other, and a box with any other kind, by
    the names alone.  So where two like names bear a blank address, or boxes and
    others, all their forms are one component and follow the least form of the
    name; only other names' forms are paired and scored.
    """
    work = Workspace(prepared.sparkSession, "dedup")
    forms, linked = _named_forms(prepared, work)
    borne = lambda c: F.max(c.cast("int")) == 1
    kind = F.col("kind")
    held = work.save(forms.groupBy(F.col("norm").alias("name")).agg(
        F.min("idx").alias("least"), borne(kind == "blank").alias("blank"), borne(kind == "box").alias("box"), borne(~kind.isin("blank", "box")).alias("other")
    ), "held")
    pairs = linked.join(_sides(held, "a").hint("merge"), "a_name").join(_sides(held, "b").hint("merge"), "b_name")
    one = F.col("a_blank") | F.col("b_blank") | ((F.col("a_box") | F.col("b_box")) & (F.col("a_other") | F.col("b_other")))
    pairs = work.save(pairs.withColumn("one", one), "pairs")
    gathered = pairs.where("one").select(F.col("a_name").alias("norm"), "a_least").distinct()
    stars = forms.join(gathered.hint("merge"), "norm").select(F.col("a_least").alias("a"), F.col("idx").alias("b"))
    between = pairs.where("one and a_least < b_least").select(F.col("a_least").alias("a"), F.col("b_least").alias("b"))
    rest = pairs.where("not one")
    free = work.save(forms.join(rest.select(F.col("a_name").alias("norm")).distinct().hint("merge"), "norm", "left_semi"), "free")
    return stars.where("a <> b").unionByName(between).unionByName(_accepted(free, rest.select(*linked.columns)))


def clusters(prepared: DataFrame) -> DataFrame:
    """(idx, cluster) with clusters numbered densely by their least record."""
    prepared = Workspace(prepared.sparkSession, "dedup").save(prepared, "prepared")
    forms = [c for c in prepared.columns if c != "idx"]
    own = prepared.select("idx", F.min("idx").over(Window.partitionBy(*forms)).alias("form"))
    labels = connected_components(component_links(prepared), "a", "b")
    placed = own.join(labels.withColumnRenamed("node", "form").hint("merge"), "form", "left").withColumn("least", F.coalesce("component", "form"))
    return dense_numbers(placed.select("idx", "least"), "least", "cluster")


def dense_numbers(df: DataFrame, column: str, name: str) -> DataFrame:
    """Dense rank minus one of a column, numbered over its distinct values by range partition."""
    values = df.select(column).distinct()
    return df.join(row_numbers(values, [column], name), column)


def row_numbers(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Dense row numbers from 0 in a total order, without gathering rows in one task."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    kept = Workspace(df.sparkSession, "numbers").save(ranged, "rows")
    part = F.shiftright("_m", 33)
    counts = kept.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))  # one row a partition
    first = counts.withColumn("_f", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", F.coalesce("_f", F.lit(0)).alias("_f"))
    return kept.withColumn("_p", part).join(F.broadcast(first), "_p").withColumn(name, F.col("_f") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_p", "_f", "_m")


def representatives(records: DataFrame, cluster: str, order: str, columns: list[str]) -> DataFrame:
    """A1: of each cluster the row with the fewest blanks, the first of equals."""
    blanks = sum((F.coalesce(F.col(c).cast("string"), F.lit("")) == "").cast("int") for c in columns)
    w = Window.partitionBy(cluster).orderBy(blanks, order)
    return records.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def cluster_pairs(members: DataFrame) -> DataFrame:
    """Pairs inside a cluster; ``members``: cluster and the prepared columns.

    Large clusters are cut in tiles, so no task holds a whole one.
    """
    kept = Workspace(members.sparkSession, "inside").save(members.withColumn("sorted", S.sorted_tokens(F.col("address"))), "members")
    a, b = _sides(kept, "a"), _sides(kept, "b")
    return tiled_join(a.withColumn("cluster", F.col("a_cluster")), b.withColumn("cluster", F.col("b_cluster")), ["cluster"]).where("a_idx < b_idx").drop("cluster")


def verify_inside(pairs: DataFrame) -> DataFrame:
    """KEEP, SPLIT (the later row leaves), JUDGE or NONE; names and addresses are scored once a distinct pair."""
    work = Workspace(pairs.sparkSession, "verify")
    scored = scored_once(pairs, ["a_tokens", "b_tokens"], {"name_score": S.ratio(F.col("a_tokens"), F.col("b_tokens"))}, work, "names")
    scored = scored_once(scored, ["a_sorted", "b_sorted"], {"address_score": S.ratio(F.col("a_sorted"), F.col("b_sorted"))}, work, "addresses")
    same = (F.col("a_address") != "") & (F.col("a_address") == F.col("b_address"))
    blank = (F.col("a_kind") == "blank") | (F.col("b_kind") == "blank")
    action = (
        F.when(same & (F.col("name_score") >= 95), "KEEP")
        .when((F.col("a_number") != "") & (F.col("b_number") != "") & (F.col("a_number") != F.col("b_number")), "SPLIT")
        .when(blank | ((F.col("address_score") >= 70) & (F.col("name_score") >= 85)), "JUDGE")
        .otherwise("NONE")
    )
    return scored.withColumn("action", action)


def apply_splits(assigned: DataFrame, splits: DataFrame) -> DataFrame:
    """The k-th split row (by index) gets the next free cluster number; ``splits``: idx."""
    most = assigned.agg(F.max("cluster").alias("_most"))
    fresh = row_numbers(splits.select("idx").distinct(), ["idx"], "_k").crossJoin(F.broadcast(most)).select("idx", (F.col("_most") + 1 + F.col("_k")).alias("_new"))
    return assigned.join(fresh.hint("merge"), "idx", "left").withColumn("cluster", F.coalesce("_new", "cluster")).drop("_new")


def near_misses(members: DataFrame, name_least: int = 92, address_least: int = 80) -> DataFrame:
    """Pairs of different clusters with like names and, where both are given, like addresses.

    Like names are found first, over distinct names, and then the clusters that
    hold them; members meet through both, so no pair of one cluster is made.
    """
    cols = members.select("idx", "cluster", "tokens", "address", S.sorted_tokens(F.col("address")).alias("sorted_address"), (F.col("kind") == "blank").alias("blank"))
    cols = Workspace(members.sparkSession, "near").save(cols, "members")
    work = Workspace(members.sparkSession, "near")
    linked = similar_names(cols, "tokens", None, name_least, 1.2).withColumnsRenamed({"a_name": "a_tokens", "b_name": "b_tokens", "score": "name_score"})
    held = work.save(cols.select("tokens", "cluster").distinct(), "held")
    met = _sides(held, "a").join(work.save(linked, "linked").hint("merge"), "a_tokens").join(_sides(held, "b").hint("merge"), "b_tokens")
    met = work.save(met.where("a_cluster <> b_cluster"), "met")
    a = _sides(cols, "a").join(met.hint("merge"), ["a_tokens", "a_cluster"])
    named = tiled_join(a, _sides(cols, "b"), ["b_tokens", "b_cluster"]).where("a_idx < b_idx")
    scored = scored_once(named, ["a_sorted_address", "b_sorted_address"], {"address_score": S.ratio(F.col("a_sorted_address"), F.col("b_sorted_address"))}, work, "addresses")
    return scored.where(F.col("a_blank") | F.col("b_blank") | (F.col("address_score") >= address_least)).select(
        F.col("a_idx").alias("a"), F.col("b_idx").alias("b"), "a_cluster", "b_cluster", "name_score", "address_score"
    )


def near_verdicts(misses: DataFrame, records: DataFrame, key: str, name: str, address: str) -> DataFrame:
    """C4: MERGE where both F6 addresses are given and equal, else JUDGE; with the fields a judge reads."""
    blank = F.trim(N.text(F.col(address))).isin("", "-", "nan")
    near = F.when(blank, "").otherwise(N.near_address(F.col(address)))
    side = lambda s: records.select(F.col(key).alias(s), F.col(name).alias(f"name_{s}"), F.col(address).alias(f"address_{s}"), near.alias(f"near_{s}"))
    met = misses.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    return met.withColumn("verdict", F.when((F.col("near_a") != "") & (F.col("near_a") == F.col("near_b")), "MERGE").otherwise("JUDGE")).drop("near_a", "near_b")


def accepted_misses(verdicts: DataFrame, by: judge.Judge) -> DataFrame:
    """Near misses that merge by themselves or that the judge calls duplicates; the rest stay open."""
    work = Workspace(verdicts.sparkSession, "near")
    kept = work.save(verdicts, "verdicts")
    asked = row_numbers(kept.where("verdict = 'JUDGE'"), ["a", "b"], "pair_id")
    answers = judge.judge_pairs(asked, by, ("DUPLICATE",)).where("judged = 'DUPLICATE'")
    return kept.where("verdict = 'MERGE'").unionByName(asked.join(answers.select("pair_id"), "pair_id", "left_semi").select(*kept.columns))


def merge_clusters(assigned: DataFrame, links: DataFrame) -> DataFrame:
    """Clusters linked by (a_cluster, b_cluster) take their least number, whole components at once."""
    labels = connected_components(links, "a_cluster", "b_cluster").withColumnRenamed("node", "cluster")
    return assigned.join(labels.hint("merge"), "cluster", "left").withColumn("cluster", F.coalesce("component", "cluster")).drop("component")


# ---------------------------------------------------------------- TF-IDF and random planes


def char_grams(c: Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """All runs of 2 and 3 characters; none of a shorter text."""
    def run(n):
        places = F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1)))
        return F.when(F.length(c) >= n, F.transform(places, lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    runs = [run(n) for n in sizes]
    return F.concat(*runs)


def tfidf(records: DataFrame, key: str, column: str) -> DataFrame:
    """(key, gram, weight), smoothed idf, rows of length one."""
    grams = records.select(key, F.explode(char_grams(F.col(column))).alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("tf"))
    df = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    n = records.agg(F.count(F.lit(1)).alias("n"))
    raw = grams.join(df, "gram").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "gram", (F.col("w") / F.col("norm")).alias("weight"))


def plane_buckets(weights: DataFrame, key: str, planes: int = 3, seed: int = 42) -> DataFrame:
    """the signs of projections on random planes; a plane's entry for a gram comes from the gram's hash."""

    @F.pandas_udf("array<double>")
    def normal(h: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng(abs(int(x)) + seed).standard_normal(planes) for x in h])

    entry = weights.select("gram").distinct().withColumn("plane", normal(F.xxhash64("gram")))
    sums = weights.join(entry, "gram").groupBy(key).agg(*(F.sum(F.col("weight") * F.col("plane")[i]).alias(f"p{i}") for i in range(planes)))
    return sums.select(key, F.concat(*(F.when(F.col(f"p{i}") > 0, "1").otherwise("0") for i in range(planes))).alias("bucket"))
