"""Linking a registry with a master: blocking, rules, judge, split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import normalize as N
from ledgerloom.functions import similarity as S
from ledgerloom.sources.workspace import Workspace, shuffle_partitions

AUTO_MATCH, AUTO_REJECT, NEEDS_REVIEW, HUMAN_ACCEPT = "AUTO_MATCH", "AUTO_REJECT", "NEEDS_REVIEW", "HUMAN_ACCEPT"
CANDIDATE, NO_MATCH = "CANDIDATE", "DEFINITE_NO_MATCH"
#: Pairs that one task makes of a block at most.
TILE_PAIRS = 1 << 17
CONFIRMED = (AUTO_MATCH, HUMAN_ACCEPT)


def prepared(records: DataFrame, side: str, key: str, name: str, address: str) -> DataFrame:
    """Normal forms, once a distinct name or address and not once a pair: columns ``<side>_*``.

    They are long chains of expressions, and records share names and addresses.
    """
    own = [f"{side}_name", f"{side}_address"]
    rows = records.select(F.col(key).alias(key), N.text(F.col(name)).alias(own[0]), N.text(F.col(address)).alias(own[1]))
    a_name, place = map(F.col, own)
    street = S.sorted_tokens(F.regexp_replace(N.match_address(place), r"(?U)^\d+[\w\-]?\s*", ""))
    spread = lambda c: rows.select(c).distinct().repartition(shuffle_partitions(records.sparkSession), c)
    names = spread(own[0]).withColumn(f"{side}_norm", N.match_name(a_name))
    places = spread(own[1]).withColumns({f"{side}_street": street, f"{side}_num": N.street_number_wide(place), f"{side}_first": N.street_number(place), f"{side}_blank": N.is_blank(place)})
    met = rows.join(names.hint("merge"), own[0]).join(places.hint("merge"), own[1])
    forms = [f"{side}_{c}" for c in ("norm", "street", "num", "first", "blank")]
    return met.select(key, *own, *forms, F.substring(f"{side}_norm", 1, 2).alias("block"))


def written(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides as written tables: joins read them several times, and their forms are long chains of expressions."""
    work = Workspace(a.sparkSession, "sides")
    return work.save(a, "a"), work.save(b, "b")


def candidate_pairs(a: DataFrame, b: DataFrame, *, pushed: bool = True) -> DataFrame:
    """Pairs whose normal names begin with the same two characters.

    ``pushed``: pairs of different street numbers are rejected by the first
    rule and never kept, so they need not be made.  Pairs with both numbers join
    on block and number; the others, where a number is missing, on the block.
    """
    if not pushed:
        return tiled_join(a, b, ["block"])
    a1, a0 = a.where("a_num <> ''"), a.where("a_num = ''")
    b1, b0 = b.where("b_num <> ''"), b.where("b_num = ''")
    same = tiled_join(a1, b1.withColumn("a_num", F.col("b_num")), ["block", "a_num"])
    return same.unionByName(tiled_join(a0, b, ["block"])).unionByName(tiled_join(a1, b0, ["block"]))


def tiled_join(a: DataFrame, b: DataFrame, on: list[str], most: int = TILE_PAIRS) -> DataFrame:
    """Equi join that cuts the pairs of a large key in tiles of about ``most``.

    Rows are counted by key on either side.  A key with more pairs than a tile
    is cut into rows and columns of tiles; a left row goes to the tiles of its
    row, a right row to those of its column, so each pair meets once and no
    task holds a whole key.  Keys of one tile are joined as they are.

    Tiles meet by a merge join.  The planner sizes the dealt rows by the file
    they were read from, which is packed and holds each row once, and would
    send all of their copies to the driver for a broadcast.
    """
    count = lambda df, n: df.groupBy(*on).agg(F.count(F.lit(1)).alias(n))
    side = float(most) ** 0.5
    sizes = count(a, "_na").join(count(b, "_nb"), on).where(F.col("_na").cast("double") * F.col("_nb") > most)
    cut = lambda n, other: F.greatest(F.lit(1), F.ceil(F.col(n) / F.greatest(F.lit(side), most / F.col(other)))).cast("int")
    sizes = sizes.select(*on, cut("_na", "_nb").alias("_down"), cut("_nb", "_na").alias("_across"))

    def dealt(df, own, own_n, other, other_n):
        known = df.join(sizes, on, "left")
        place = F.pmod(F.xxhash64(*(c for c in df.columns if c not in on)), F.coalesce(own_n, F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other_n), F.lit(1)) - 1))
        return known.withColumn(own, place).withColumn(other, every).drop("_down", "_across")

    # few rows make many pairs: dealt by tile, whatever files they were read from
    left = dealt(a, "_i", F.col("_down"), "_j", "_across").repartition(shuffle_partitions(a.sparkSession), *on, "_i", "_j")
    right = dealt(b, "_j", F.col("_across"), "_i", "_down")
    return left.join(right.hint("merge"), [*on, "_i", "_j"]).drop("_i", "_j")


def scored_once(pairs: DataFrame, columns: list[str], scores: dict[str, Column], work: Workspace, name: str, forms: dict[str, Column] | None = None) -> DataFrame:
    """Scores of two texts, made once for each distinct pair of texts and joined back.

    Records share names and streets, so this is far less than one score a pair.
    ``forms`` are columns that scores read several times; they are made ahead of
    a shuffle, which keeps the optimizer from making them anew each time.

    They are joined back by a merge join: texts repeat in the written scores, so
    their file is far smaller than what a broadcast would bring to the driver.
    """
    parts = shuffle_partitions(pairs.sparkSession)
    distinct = pairs.select(*columns).distinct().withColumns(forms or {}).repartition(parts, *columns)
    return pairs.join(work.save(distinct.withColumns(scores).drop(*(forms or {})), name).hint("merge"), columns)


def scored(pairs: DataFrame) -> DataFrame:
    """Name and street scores (F39, F40) and the substring test.

    Pairs are far more than records: joining the written sides again is cheaper
    than writing the pairs.
    """
    work = Workspace(pairs.sparkSession, "scored")
    pairs = scored_once(pairs, ["a_norm", "b_norm"], name_scores(), work, "names")
    return scored_once(pairs, ["a_street", "b_street"], street_scores(), work, "streets")


def name_scores() -> dict[str, Column]:
    a, b = F.col("a_norm"), F.col("b_norm")
    named = F.when((a != "") & (b != ""), F.greatest(S.ratio(a, b), S.token_sort_ratio(a, b))).otherwise(0.0)
    return {"name_score": named, "contained": S.substring_match(a, b)}


def street_scores() -> dict[str, Column]:
    a, b = F.col("a_street"), F.col("b_street")
    return {"address_score": F.when((a != "") & (b != ""), S.ratio(a, b)).otherwise(0.0)}


def like_names(a: DataFrame, b: DataFrame, least: int, work: Workspace) -> DataFrame:
    """(a_norm, b_norm, name_score) of distinct names of a block that reach the score."""
    names = tiled_join(a.select("block", "a_norm").distinct(), b.select("block", "b_norm").distinct(), ["block"]).drop("block")
    near = names.where(S.length_allows(F.col("a_norm"), F.col("b_norm"), least)).repartition(shuffle_partitions(a.sparkSession), "a_norm", "b_norm")
    return work.save(near.withColumns(name_scores()).where(F.col("name_score") >= least).select("a_norm", "b_norm", "name_score"), f"names-{least}")


def like_streets(a: DataFrame, b: DataFrame, least: int, work: Workspace) -> DataFrame:
    """(a_street, b_street, address_score) of distinct streets of a block that reach the score; empty ones have none."""
    side = lambda df, s: df.where(F.col(f"{s}_street") != "").select("block", f"{s}_street").distinct()
    streets = tiled_join(side(a, "a"), side(b, "b"), ["block"]).drop("block").where(S.length_allows(F.col("a_street"), F.col("b_street"), least)).distinct()
    near = streets.repartition(shuffle_partitions(a.sparkSession), "a_street", "b_street")
    return work.save(near.withColumns(street_scores()).where(F.col("address_score") >= least), f"streets-{least}")


def like_pairs(a: DataFrame, b: DataFrame, name_least: int, address_least: int) -> DataFrame:
    """Candidates whose name and street scores both reach a bound above 0, made from the names and streets that do."""
    work = Workspace(a.sparkSession, "like")
    a, b = work.save(a, "a"), work.save(b, "b")
    names, streets = like_names(a, b, name_least, work), like_streets(a, b, address_least, work)
    met = a.join(names, "a_norm").join(streets, "a_street").drop("block")
    return met.join(b.hint("merge"), ["b_norm", "b_street"]).where("(a_num = '' or b_num = '' or a_num = b_num)")


def blank_pairs(a: DataFrame, b: DataFrame, name_least: int) -> DataFrame:
    """Candidates with a blank address on either side (so without a number there) whose name score reaches a bound above 0."""
    work = Workspace(a.sparkSession, "blank")
    a, b = work.save(a, "a"), work.save(b, "b")
    named = a.join(like_names(a, b, name_least, work), "a_norm").drop("block")
    meet = lambda x, y: x.join(y.hint("merge"), "b_norm")
    return meet(named.where("a_blank"), b).unionByName(meet(named.where("not a_blank"), b.where("b_blank")))


def rule_verdict() -> Column:
    """C5, the first rule that holds."""
    name, addr, inside = F.col("name_score"), F.col("address_score"), F.col("contained")
    a_num, b_num = F.col("a_num") != "", F.col("b_num") != ""

    def plausible(least):
        return F.when((name >= least) | inside, CANDIDATE).otherwise(NO_MATCH)

    return (
        F.when(a_num & b_num & (F.col("a_num") != F.col("b_num")), NO_MATCH)
        .when((name < 35) & (addr < 35) & ~inside, NO_MATCH)
        .when(F.col("a_blank") & F.col("b_blank"), plausible(83))
        .when(F.col("a_blank") | F.col("b_blank"), plausible(60))
        .when(~(a_num & b_num), plausible(55))
        .otherwise(CANDIDATE)
    )


def number_match() -> Column:
    """Null where a number is missing."""
    return F.when((F.col("a_num") != "") & (F.col("b_num") != ""), F.col("a_num") == F.col("b_num"))


def rule_filter(a: DataFrame, b: DataFrame) -> DataFrame:
    """The candidates with scores.

    A pair without two numbers needs a name score of 55 or one name inside the
    other, which lengths alone often rule out before anything is scored.
    """
    numbered = (F.col("a_num") != "") & (F.col("b_num") != "")
    hopeful = S.length_allows(F.col("a_norm"), F.col("b_norm"), 55) | S.substring_match(F.col("a_norm"), F.col("b_norm"))
    pairs = candidate_pairs(*written(a, b)).where(numbered | hopeful)
    return scored(pairs).withColumn("verdict", rule_verdict()).withColumn("number_match", number_match()).where(F.col("verdict") == CANDIDATE)


def simple_scores(a: Column, b: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    """F32 on F3 names and whether they are one name, and the forms that both read."""
    forms = {"_a": a, "_b": b, "_a_set": S.token_set(a), "_b_set": S.token_set(b)}
    return {"simple_score": S.token_set_score(F.col("_a_set"), F.col("_b_set")), "same": (F.col("_a") != "") & (F.col("_a") == F.col("_b"))}, forms


def address_likeness() -> Column:
    sorted_ = lambda c: S.sorted_tokens(F.lower(F.col(c)))
    return S.ratio(sorted_("a_address"), sorted_("b_address"))


def is_near() -> Column:
    """One street number and like names: the addresses decide."""
    return (F.col("a_first") != "") & (F.col("a_first") == F.col("b_first")) & (F.col("simple_score") >= 88)


def rule_decision(same: str) -> Column:
    """C6 from ``simple_score``, the first numbers, the blanks, ``_addr`` of near pairs and whether the simple names are one."""
    a_num, b_num, n = F.col("a_first"), F.col("b_first"), F.col("simple_score")
    blank_a, blank_b = F.col("a_blank"), F.col("b_blank")
    return (
        F.when((a_num != "") & (b_num != "") & (a_num != b_num), AUTO_REJECT)
        .when(n < 50, AUTO_REJECT)
        .when(blank_a & blank_b & (n >= 90), AUTO_MATCH)
        .when(is_near() & (F.col("_addr") >= 75), AUTO_MATCH)
        .when(F.col(same) & (blank_a | blank_b), AUTO_MATCH)
    )


def prejudge(candidates: DataFrame) -> DataFrame:
    """``decision`` AUTO_MATCH, AUTO_REJECT or null (a judge is needed); ``simple_score`` is F32 on F3 names.

    Names are scored once a distinct pair, addresses only where they decide.
    """
    work = Workspace(candidates.sparkSession, "prejudge")
    candidates = work.save(candidates.drop("a_norm", "b_norm", "a_street", "b_street", "a_num", "b_num", "block", "contained"), "candidates")
    scores, forms = simple_scores(N.simple_name(F.col("a_name")), N.simple_name(F.col("b_name")))
    named = scored_once(candidates, ["a_name", "b_name"], scores, work, "names", forms)
    asked = named.where(is_near()).select("a_address", "b_address").distinct()
    alike = work.save(asked.withColumn("_addr", address_likeness()), "addresses")
    judged = named.join(alike.hint("merge"), ["a_address", "b_address"], "left").withColumn("decision", rule_decision("same"))
    return judged.drop("_addr", "same", "a_first", "b_first")


def final_decision(decision: Column, judged: Column) -> Column:
    """Rules first, then the judge's answer; what stays open needs review."""
    by_judge = F.when(judged == "MATCH", AUTO_MATCH).when(judged == "NOT_MATCH", AUTO_REJECT)
    return F.coalesce(decision, by_judge, F.lit(NEEDS_REVIEW))


def without_matched(records: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Records that no automatic match holds."""
    return records.join(pairs.where(F.col("final_decision") == AUTO_MATCH).select(key).distinct(), key, "left_anti")


def confirmed(pairs: DataFrame) -> DataFrame:
    """P12."""
    return pairs.where(F.col("final_decision").isin(*CONFIRMED))


def side_by_side(pairs: DataFrame, registry: DataFrame, master: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """J6, joined by key and never by position."""
    clash = set(registry.columns) & set(master.columns)
    renamed = master.withColumnsRenamed({c: f"master_{c}" for c in clash})
    return confirmed(pairs).select(a_key, b_key).join(registry, a_key, "left").join(renamed, b_key, "left")


def residue(records: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """J7."""
    return records.join(confirmed(pairs).select(key).distinct(), key, "left_anti")


def match_stats(pairs: DataFrame) -> DataFrame:
    """A11, one pass."""
    is_ = lambda *v: F.count_if(F.col("final_decision").isin(*v))
    return pairs.agg(
        F.count(F.lit(1)).alias("total"), is_(AUTO_MATCH).alias("auto_match"), is_(AUTO_REJECT).alias("auto_reject"),
        is_(NEEDS_REVIEW).alias("needs_review"), is_(HUMAN_ACCEPT).alias("human_accept"), is_(*CONFIRMED).alias("confirmed"),
    )
