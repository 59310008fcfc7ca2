"""Pluggable judges of ambiguous pairs (X1-X3, X5's reply contract, J18).

A judge maps pairs (id, name and address of both sides) to decisions.  It runs
in ``mapInPandas``; whatever it leaves out is ``UNCERTAIN``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNCERTAIN = "UNCERTAIN"
FIELDS = ["pair_id", "name_a", "address_a", "name_b", "address_b"]


class Judge(Protocol):
    chunk: int

    def decide(self, pairs: list[dict]) -> Iterable[dict]:
        """``{"id", "decision", "reason"}`` for the pairs it can decide."""


class UncertainJudge:
    """Without a service every answer is open."""

    chunk = 1000

    def decide(self, pairs):
        return []


class RecordedJudge:
    """Answers from a table of earlier replies."""

    chunk = 1000

    def __init__(self, replies: dict[int, str]):
        self.replies = replies

    def decide(self, pairs):
        return [{"id": p["pair_id"], "decision": self.replies[p["pair_id"]], "reason": "recorded"} for p in pairs if p["pair_id"] in self.replies]


class ReplyJudge:
    """Sends chunks through ``ask`` (a list of pairs to the text of a reply) and reads ``{"results": [...]}``.

    A reply that fails or cannot be read leaves its pairs uncertain.
    """

    def __init__(self, ask, chunk: int = 20):
        self.ask, self.chunk = ask, chunk

    def decide(self, pairs):
        try:
            return parse_reply(self.ask(pairs))
        except (ValueError, OSError, KeyError):
            return []


def parse_reply(reply: str) -> list[dict]:
    body = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", reply)
    return [r for r in json.loads(body)["results"] if "id" in r and "decision" in r]


def judge_pairs(pairs: DataFrame, judge: Judge, allowed: tuple[str, ...]) -> DataFrame:
    """(pair_id, judged, reason): one row a pair."""

    def run(batches):
        for batch in batches:
            answers = {}
            asked = batch.to_dict("records")
            for i in range(0, len(asked), judge.chunk):
                for a in judge.decide(asked[i : i + judge.chunk]):
                    if a["decision"] in allowed:
                        answers[a["id"]] = (a["decision"], a.get("reason", ""))
            got = [answers.get(i, (UNCERTAIN, "")) for i in batch["pair_id"]]
            yield pd.DataFrame({"pair_id": batch["pair_id"], "judged": [g[0] for g in got], "reason": [g[1] for g in got]})

    return pairs.select(*FIELDS).mapInPandas(run, "pair_id long, judged string, reason string")


def with_judgement(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """Missing answers are uncertain."""
    return pairs.join(answers, "pair_id", "left").withColumn("judged", F.coalesce("judged", F.lit(UNCERTAIN)))
