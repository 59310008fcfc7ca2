"""The whole reconciliation as a state machine of steps and gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import dedup, judge, linkage
from ledgerloom.sources.workspace import Workspace

#: Step names in order; soft gates stop only while something is open, hard ones always.
STEPS = ("dedup", "collapse", "match", "split", "second_match", "schema", "outputs", "contacts")
SOFT = {"dedup", "match", "second_match"}


def next_step(step: str) -> str | None:
    i = STEPS.index(step) + 1
    return STEPS[i] if i < len(STEPS) else None


def gate(step: str, open_pairs: int) -> str:
    """``go`` or ``pause``."""
    return ("pause" if open_pairs else "go") if step in SOFT else "pause"


@dataclass
class Outcome:
    pairs: DataFrame
    matched: DataFrame
    registry_rest: DataFrame
    master_rest: DataFrame


def pair_ids(pairs: DataFrame, a_key: str, b_key: str) -> DataFrame:
    return pairs.withColumn("pair_id", F.xxhash64(a_key, b_key))


def match(registry: DataFrame, master: DataFrame, pair_judge: judge.Judge | None = None) -> DataFrame:
    """Pairs with ``final_decision``; records as in ``plans.fixtures``.

    Scored pairs and a judge's answers are written once: pairs are read twice,
    and no question is asked again when an executor is lost later.
    """
    a = linkage.prepared(registry, "a", "registry_index", "business_name", "address1")
    b = linkage.prepared(master, "b", "master_index", "name", "address1")
    pairs = pair_ids(linkage.prejudge(linkage.rule_filter(a, b)), "registry_index", "master_index")
    if pair_judge is None:
        judged = F.lit(judge.UNCERTAIN)
    else:
        work = Workspace(registry.sparkSession, "match")
        pairs = work.save(pairs, "pairs")
        asked = pairs.where("decision is null").selectExpr("pair_id", "a_name as name_a", "a_address as address_a", "b_name as name_b", "b_address as address_b")
        pairs = judge.with_judgement(pairs, work.save(judge.judge_pairs(asked, pair_judge, ("MATCH", "NOT_MATCH", judge.UNCERTAIN)), "answers"))
        judged = F.col("judged")
    return pairs.withColumn("final_decision", linkage.final_decision(F.col("decision"), judged))


def split(registry: DataFrame, master: DataFrame, pairs: DataFrame) -> Outcome:
    """J6, J7."""
    return Outcome(
        pairs, linkage.side_by_side(pairs, registry, master, "registry_index", "master_index"),
        linkage.residue(registry, pairs, "registry_index"), linkage.residue(master, pairs, "master_index"),
    )


def deduplicate(registry: DataFrame) -> DataFrame:
    """One row a cluster, with ``cluster``."""
    prepared = dedup.preprocess(registry, "registry_index", "business_name", "address1")
    assigned = dedup.clusters(prepared).withColumnRenamed("idx", "registry_index").select("registry_index", "cluster")
    return dedup.representatives(registry.join(assigned, "registry_index"), "cluster", "registry_index", ["business_name", "address1"])
