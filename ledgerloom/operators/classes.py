"""Decisions of linkage between classes of records, for results that need no list of pairs.

Pairs grow with the square of the records, but what decides a pair are few
forms.  Where a street number is missing on either side, only the names and
the blanks decide; else the numbers do too, and whole addresses only where a
name leaves it open.  Each pair of records is in one pair of classes of one
level, with the decision that ``linkage.prejudge`` gives it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import normalize as N
from ledgerloom.functions import similarity as S
from ledgerloom.operators import linkage
from ledgerloom.sources.workspace import Workspace, shuffle_partitions

#: Columns of a side that name a class, by level.
OPEN = ("form", "blank", "unnumbered", "unstarted")
CLOSE = ("form", "blank", "num", "first")
FULL = ("form", "place")
#: What names a place: blanks, numbers and streets come from an address.
PLACE = ("blank", "num", "first", "street", "address")
#: Records of a class in one list, and pairs of records from which lists that meet are dealt out.
LISTED = 1 << 8
LARGE = 1 << 14


@dataclass
class Level:
    """Pairs of classes: ``a_*`` and ``b_*`` of ``on``, ``decision``, ``simple_score`` and ``pairs``, how many pairs of records they hold."""

    on: tuple[str, ...]
    pairs: DataFrame


def _formed(records: DataFrame, s: str, work: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records with the numbers of their name form and their place, the forms and the places."""
    named = records.withColumn(f"{s}_simple", N.simple_name(F.col(f"{s}_name")))
    named = work.save(named.withColumn(f"{s}_unnumbered", F.col(f"{s}_num") == "").withColumn(f"{s}_unstarted", F.col(f"{s}_first") == ""), f"named_{s}")
    own = ["block", f"{s}_norm", f"{s}_simple"]
    forms = work.save(named.select(*own).distinct().withColumn(f"{s}_form", F.monotonically_increasing_id()), f"forms_{s}")
    at = [f"{s}_{c}" for c in PLACE]
    places = work.save(named.select(*at).distinct().withColumn(f"{s}_place", F.monotonically_increasing_id()), f"places_{s}")
    return work.save(named.join(forms.hint("merge"), own).join(places.hint("merge"), at), f"records_{s}"), forms, places


def _counted(records: DataFrame, s: str, on: tuple[str, ...], *more: str) -> DataFrame:
    return records.groupBy(*more, *(f"{s}_{c}" for c in on)).agg(F.count(F.lit(1)).alias(f"{s}_n"))


def _kept(pairs: DataFrame, on: tuple[str, ...]) -> DataFrame:
    return pairs.select(*(f"{s}_{c}" for s in "ab" for c in on), "decision", "simple_score", (F.col("a_n") * F.col("b_n")).alias("pairs"))


def decided(a: DataFrame, b: DataFrame, *, matches: bool = False) -> tuple[DataFrame, DataFrame, list[Level]]:
    """Both sides as records with their class columns, and the levels; ``a``, ``b`` are ``linkage.prepared``.

    ``matches``: automatic matches alone.  Every one has a simple score of 88
    or equal simple names, so other names are left out before addresses meet.
    """
    work = Workspace(a.sparkSession, "classes")
    (a, a_forms, a_places), (b, b_forms, b_places) = _formed(a, "a", work), _formed(b, "b", work)

    # a number is missing on either side, in both readings of it
    names = linkage.tiled_join(_counted(a, "a", OPEN, "block", "a_norm"), _counted(b, "b", OPEN, "block", "b_norm"), ["block"])
    hopeful = S.length_allows(F.col("a_norm"), F.col("b_norm"), 55) | S.substring_match(F.col("a_norm"), F.col("b_norm"))
    names = names.where("(a_unnumbered or b_unnumbered) and (a_unstarted or b_unstarted)").where(hopeful)
    names = work.save(names.drop("block", "a_norm", "b_norm"), "open")

    # equal numbers, or a number that only one of the two readings finds
    a1, b1 = _counted(a, "a", CLOSE, "block"), _counted(b, "b", CLOSE, "block")
    numbered = linkage.tiled_join(a1.where("a_num <> ''"), b1.where("b_num <> ''").withColumn("a_num", F.col("b_num")), ["block", "a_num"])
    odd_a = linkage.tiled_join(a1.where("a_num = '' and a_first <> ''"), b1.where("b_first <> ''"), ["block"])
    odd_b = linkage.tiled_join(a1.where("a_num <> '' and a_first <> ''"), b1.where("b_num = '' and b_first <> ''"), ["block"])
    met = work.save(numbered.unionByName(odd_a).unionByName(odd_b).drop("block"), "close")

    scores = _scored(names.select("a_form", "b_form").unionByName(met.select("a_form", "b_form")).distinct(), a_forms, b_forms, work)
    if matches:
        scores = work.save(scores.where("simple_score >= 88 or same"), "alike")

    none = {c: F.lit("") for c in ("a_num", "b_num", "a_first", "b_first")}
    names = names.join(scores, ["a_form", "b_form"]).withColumns(none).withColumn("address_score", F.lit(100.0)).withColumn("_addr", F.lit(None).cast("double"))
    names = names.where(linkage.rule_verdict() == linkage.CANDIDATE).withColumn("decision", linkage.rule_decision("same"))

    # what the best and the worst street score agree on needs no street, and only near pairs need an address
    met = met.join(scores, ["a_form", "b_form"]).withColumn("_addr", F.lit(None).cast("double"))
    met = met.withColumn("address_score", F.lit(100.0)).where(linkage.rule_verdict() == linkage.CANDIDATE)
    met = met.withColumn("address_score", F.lit(0.0)).withColumn("_street", linkage.rule_verdict() != linkage.CANDIDATE).withColumn("decision", linkage.rule_decision("same"))
    met = met.withColumn("_asks", F.col("_street") | (F.col("decision").isNull() & linkage.is_near()))
    met = work.save(met.drop("_addr", "address_score"), "met")

    levels = [Level(OPEN, _kept(names, OPEN)), Level(CLOSE, _kept(met.where("not _asks"), CLOSE)), Level(FULL, _kept(_by_address(met, a, b, a_places, b_places, work), FULL))]
    if matches:
        levels = [Level(x.on, x.pairs.where(F.col("decision") == linkage.AUTO_MATCH)) for x in levels]
    return a, b, [Level(x.on, work.save(x.pairs, f"level-{i}")) for i, x in enumerate(levels)]


def _scored(pairs: DataFrame, a_forms: DataFrame, b_forms: DataFrame, work: Workspace) -> DataFrame:
    """Scores of pairs of forms."""
    pairs = pairs.join(a_forms.drop("block"), "a_form").join(b_forms.drop("block"), "b_form")
    pairs = work.save(pairs.repartition(shuffle_partitions(pairs.sparkSession), "a_form", "b_form"), "forms")
    scored = linkage.scored_once(pairs, ["a_norm", "b_norm"], linkage.name_scores(), work, "names")
    scores, forms = linkage.simple_scores(F.col("a_simple"), F.col("b_simple"))
    scored = linkage.scored_once(scored, ["a_simple", "b_simple"], scores, work, "simple", forms)
    return work.save(scored.select("a_form", "b_form", "name_score", "contained", "simple_score", "same"), "scores")


def _by_address(met: DataFrame, a: DataFrame, b: DataFrame, a_places: DataFrame, b_places: DataFrame, work: Workspace) -> DataFrame:
    """Pairs of classes that names and numbers leave open, by street and address, which are scored once for two places."""
    asked = met.where("_asks").drop("a_n", "b_n", "decision")
    side = lambda df, s: _counted(df, s, (*CLOSE, "place")).hint("merge")
    pairs = asked.join(side(a, "a"), [f"a_{c}" for c in CLOSE]).join(side(b, "b"), [f"b_{c}" for c in CLOSE])
    pairs = work.save(pairs, "asked")
    text = lambda df, s: df.select(f"{s}_place", f"{s}_street", f"{s}_address")
    places = pairs.select("a_place", "b_place").distinct().join(text(a_places, "a"), "a_place").join(text(b_places, "b"), "b_place")
    places = work.save(places.repartition(shuffle_partitions(met.sparkSession), "a_place", "b_place"), "places")
    places = linkage.scored_once(places, ["a_street", "b_street"], linkage.street_scores(), work, "streets")
    places = linkage.scored_once(places, ["a_address", "b_address"], {"_addr": linkage.address_likeness()}, work, "addresses")
    places = work.save(places.select("a_place", "b_place", "address_score", "_addr"), "place-scores")
    pairs = pairs.join(places.hint("merge"), ["a_place", "b_place"])
    return pairs.where(linkage.rule_verdict() == linkage.CANDIDATE).withColumn("decision", linkage.rule_decision("same"))


def match_stats(levels: list[Level]) -> DataFrame:
    """A11 without a judge: what no rule decides needs review."""
    final = F.coalesce("decision", F.lit(linkage.NEEDS_REVIEW))
    counts = _united([x.pairs.groupBy("decision").agg(F.sum("pairs").alias("pairs")) for x in levels])
    is_ = lambda *v: F.coalesce(F.sum(F.when(final.isin(*v), F.col("pairs"))), F.lit(0)).cast("long")
    return counts.agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).cast("long").alias("total"), is_(linkage.AUTO_MATCH).alias("auto_match"), is_(linkage.AUTO_REJECT).alias("auto_reject"),
        is_(linkage.NEEDS_REVIEW).alias("needs_review"), is_(linkage.HUMAN_ACCEPT).alias("human_accept"), is_(*linkage.CONFIRMED).alias("confirmed"),
    )


def matched_keys(records: DataFrame, levels: list[Level], s: str, key: str) -> DataFrame:
    """Keys of one side's records that an automatic match holds, each once."""
    found = []
    for x in levels:
        on = [f"{s}_{c}" for c in x.on]
        classes = x.pairs.where(F.col("decision") == linkage.AUTO_MATCH).select(*on).distinct()
        found.append(records.join(classes.hint("merge"), on, "left_semi").select(key))
    return _united(found).distinct()


def pairs_of_records(records: DataFrame, levels: list[Level], s: str, key: str, chosen: Column) -> DataFrame:
    """(key, pairs): in how many of the chosen pairs each record of one side is; none is made."""
    found = []
    for x in levels:
        on = [f"{s}_{c}" for c in x.on]
        sums = x.pairs.where(chosen).groupBy(*on).agg(F.sum("pairs").alias("pairs"))
        each = sums.join(_counted(records, s, x.on).hint("merge"), on).select(*on, F.expr(f"pairs div {s}_n").alias("pairs"))
        found.append(records.select(key, *on).join(each.hint("merge"), on).select(key, "pairs"))
    return _united(found).groupBy(key).agg(F.sum("pairs").alias("pairs"))


def attached(records: DataFrame, originals: DataFrame, key: str, name: str) -> DataFrame:
    """Records with their original rows as one struct: joined here once a record and not once a pair."""
    rows = originals.select(key, F.struct(*originals.columns).alias(name))
    return Workspace(records.sparkSession, "attached").save(records.join(rows.hint("merge"), key), name)


def matched_pairs(a: DataFrame, b: DataFrame, levels: list[Level], columns: list[str]) -> DataFrame:
    """All pairs of records that match automatically, with ``columns`` of either side."""
    return record_pairs(a, b, levels, columns, F.col("decision") == linkage.AUTO_MATCH)


def record_pairs(a: DataFrame, b: DataFrame, levels: list[Level], columns: list[str], chosen: Column | None = None) -> DataFrame:
    """The pairs of records of all classes, or of the chosen ones, with ``columns`` of either side or of a level.

    Records of a class are lists of at most about ``LISTED``; the lists of two
    classes meet, and those of large ones are dealt out.  Pairs are made last,
    in one loop over two lists, and nothing joins, shuffles or sorts them.
    """
    work, out = Workspace(a.sparkSession, "lists"), []
    parts = 4 * shuffle_partitions(a.sparkSession)
    for i, x in enumerate(levels):
        pairs = x.pairs if chosen is None else x.pairs.where(chosen)
        lists = [_lists(records, s, x.on, columns, work, f"{i}-{s}") for s, records in (("a", a), ("b", b))]
        keys = [[f"{s}_{c}" for c in x.on] for s in "ab"]
        for large in (True, False):
            met = pairs.where(F.col("pairs") > LARGE if large else F.col("pairs") <= LARGE)
            for (rows, _), on in zip(lists, keys, strict=True):
                met = met.join(rows.hint("merge"), on)
            if large:
                met = met.repartition(parts, *keys[0], *keys[1], "a_part", "b_part")
            out.append(_made(met, [rest for _, rest in lists], columns))
    return _united(out)


def _lists(records: DataFrame, s: str, on: tuple[str, ...], columns: list[str], work: Workspace, name: str) -> tuple[DataFrame, list[str]]:
    """Of each class the wanted columns of its records as ``<s>_list``, a large class as several rows, and those columns."""
    own = [f"{s}_{c}" for c in on]
    rest = [c for c in records.columns if c in columns and c not in own]
    large = records.groupBy(*own).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LISTED)
    part = F.pmod(F.xxhash64(*rest), F.coalesce(F.ceil(F.col("_n") / LISTED), F.lit(1))).cast("int").alias(f"{s}_part")
    known = records.select(*own, *rest).join(large.hint("merge"), own, "left")
    listed = known.groupBy(*own, part).agg(F.collect_list(F.struct(*rest)).alias(f"{s}_list"))
    if len(rest) == 1:  # plain values are faster, and structs kept those that are null
        listed = listed.withColumn(f"{s}_list", F.col(f"{s}_list").getField(rest[0]))
    return work.save(listed, name), rest


def _made(met: DataFrame, rest: list[list[str]], columns: list[str]) -> DataFrame:
    """All pairs of the records of two lists."""
    kept = [c for c in columns if c not in rest[0] and c not in rest[1]]
    pairs = met.select(*kept, F.explode("a_list").alias("_a"), "b_list").select(*kept, "_a", F.explode("b_list").alias("_b"))
    at = {c: F.col(v) if len(own) == 1 else F.col(v)[c] for v, own in zip(("_a", "_b"), rest, strict=True) for c in own}
    return pairs.select(*(at[c].alias(c) if c in at else c for c in columns))


def _united(parts: list[DataFrame]) -> DataFrame:
    first, *rest = parts
    for x in rest:
        first = first.unionByName(x)
    return first
