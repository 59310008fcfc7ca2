import difflib
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import normalize as N
from ledgerloom.functions import similarity as S
from ledgerloom.functions import values as V
from ledgerloom.operators import contacts, judge, outputs
from ledgerloom.operators.graph import connected_components
from ledgerloom.plans import reconcile
from ledgerloom.sources import mapping, tables

CASES = [
    (N.match_name, "Blue Coffee LLC", "blueffee"),
    (N.match_name, "A & B, Inc.", "a and b"),
    (N.dedup_address, "1011 W 4TH ST # 1/2", "1011 w 4th st"),
    (N.street_name, "1011 W 4TH ST # 1/2", "w 4th st"),
    (N.dedup_address, "2710-3040 Main Street", "2710 main st"),
    (N.dedup_address, "100 Highway 99", "100 hwy"),
    (N.street_number_wide, "2710-3040 Main", "2710-"),
    (N.street_number, "2710-3040 Main", "2710"),
    (N.dedup_name, "-", ""),
    (N.dedup_name, "Dr Jane Roe Jr", "jane roe"),
    (N.simple_name, "Acme Corp., LLC", "acme"),
    (N.phone, "+1 (555) 123-4567", "5551234567"),
    (V.largest_number, "12;3.2 a7b", "12"),
    (V.earliest_year, "03/01/2010;1999", "1999"),
    (V.earliest_date, "03/01/2010;01/02/1999", "01/02/1999"),
    (N.city_date, "Springfield_05_11_2023", "20231105"),
    (N.city_date, "Springfield", None),
    (N.cell, " NaN ", ""),
]


@pytest.mark.parametrize("fn,value,want", CASES)
def test_scalar(spark, fn, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(fn(F.col("v"))).first()[0] == want


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_lcs_and_scores():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(0, 80)))
    for _ in range(200):
        a, b = word(), word()
        assert S.lcs(a, b) == S.lcs(b, a) == _lcs(a, b)
        for score in (S._ratio, S._partial, S.weighted):
            assert 0 <= score(a, b) <= 100
            assert score(a, b) == pytest.approx(score(b, a))
    assert S._ratio("", "") == 100 and S.weighted("", "x") == 0
    assert S._partial("abc", "xxabcxx") == 100
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)


def test_phones(spark):
    df = spark.createDataFrame([(["555-123-4567", "1 555 123 4567", None, ""],)], "p array<string>")
    assert df.select(V.merged_phones(F.col("p"))).first()[0] == "555-123-4567"


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)] + [(None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_contacts():
    person = lambda name, *c: {"name": name, "title": "", "roles": "", "contact_sets": [{"contact": x, "contact_type": "phone_number", "type": t} for x, t in c]}
    out = contacts.deduplicated([person("Jane Roe", ("555-1", "other")), person("jane roe", ("5551", "work")), person("BLK_1", ("555 1", "work")), person("BLK_2", ("777", "work"))])
    assert [p["name"] for p in out] == ["Jane Roe", "BLK_2"]
    assert [s["type"] for s in out[0]["contact_sets"]] == ["work"]
    assert contacts.merged_list("Owner, CEO", "Manager") == "Owner, CEO, Manager"
    assert contacts.merged_list("Owner, CEO", "owner, Manager") == "Owner, CEO, owner, Manager"  # the second text is one item
    assert contacts.merged_list("Office Manager", "Office Managers") == "Office Managers"
    assert contacts.same_person("Jon Smith", "John Smith") == (difflib.SequenceMatcher(None, "jon smith", "john smith").ratio() >= 0.87)


def test_judges(spark):
    rows = [(i, "a", "1 st", "b", "2 st") for i in range(5)]
    df = spark.createDataFrame(rows, "pair_id long, name_a string, address_a string, name_b string, address_b string")
    allowed = ("MATCH", "NOT_MATCH", judge.UNCERTAIN)
    got = judge.judge_pairs(df, judge.RecordedJudge({1: "MATCH", 2: "WHAT"}), allowed)
    assert {r.pair_id: r.judged for r in got.collect()} == {0: "UNCERTAIN", 1: "MATCH", 2: "UNCERTAIN", 3: "UNCERTAIN", 4: "UNCERTAIN"}
    assert judge.parse_reply('```json\n{"results": [{"id": 1, "decision": "MATCH"}]}\n```') == [{"id": 1, "decision": "MATCH"}]
    assert list(judge.ReplyJudge(lambda p: "no json").decide([{}])) == []


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("x, \"y\"", None), ("", "2")], "a string, b string")
    for kind in ("csv", "parquet"):
        tables.write_sheet(df, f"{tmp_path}/t.{kind}", kind)
        back = tables.read_sheet(spark, f"{tmp_path}/t.{kind}")
        assert sorted(map(tuple, back.collect())) == [("", "2"), ('x, "y"', "")]
    assert tables.save_schema({"a": 1}, f"{tmp_path}/s.json", spark) and not tables.save_schema({"a": 2}, f"{tmp_path}/s.json", spark)
    assert tables.load_schema(f"{tmp_path}/s.json", spark) == {"a": 1}
    assert tables.pick_sheet(["Custom Data", "Business Record"], "business", True) == "Business Record"


def test_mapping():
    assert mapping.resolve(["Business_Name", "x"], "business name") == "Business_Name"
    assert mapping.guess_contact("Owner Email") == ("email", "Owner")
    assert mapping.clean_header("2_3_Contact.1") == "Contact"
    doc = mapping.field_document([{"source_col": "nm", "target_col": "Business Name", "mapping_type": "business"}])
    assert doc["NAME_LIST"] == ["nm"]
    assert N.column_index("AA") == 26 and N.column_letter(26) == "AA"


def test_gates():
    assert reconcile.gate("match", 0) == "go" and reconcile.gate("match", 2) == reconcile.gate("split", 0) == "pause"
    assert reconcile.next_step("dedup") == "collapse" and reconcile.next_step("contacts") is None


def test_types(spark):
    df = spark.createDataFrame([("1", "1999", "01/02/2000", "x" * 300)], "n string, y string, d string, t string")
    got = {r.column_name: r.data_type for r in outputs.data_types(df, ["n", "y", "d", "t"]).collect()}
    assert got == {"n": "Number", "y": "Number", "d": "Date", "t": "Text(Medium)"}


def test_decision_stream(spark, tmp_path):
    from ledgerloom.streaming import decisions

    rows = spark.createDataFrame([(1, 5, "HUMAN_ACCEPT")], "event_id long, pair_id long, decision string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = decisions.decision_stream(spark, f"{tmp_path}/in", "event_id long, pair_id long, decision string")
    decisions.start_log(stream, f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/log").count() == 1


def test_near_misses_merge_only_by_equal_address_or_judge(spark):
    from ledgerloom.operators import dedup, judge

    rows = [(1, "Blue Cafe", "12 Main St Ste 4"), (2, "Blue Cafes", "12 Main St #9"), (3, "Blue Cafe", ""), (4, "Blue Cafe", "-"), (5, "Blue Cafe", "14 Main St"), (6, "Blue Cafe", None)]
    records = spark.createDataFrame(rows, "id long, name string, address string")
    pairs = [(a, b, a * 10, b * 10) for a, b in ((1, 2), (1, 3), (3, 4), (1, 5), (4, 6))]
    misses = spark.createDataFrame(pairs, "a long, b long, a_cluster long, b_cluster long")
    verdicts = dedup.near_verdicts(misses, records, "id", "name", "address")
    assert {(r.a, r.b): r.verdict for r in verdicts.collect()} == {(1, 2): "MERGE", (1, 3): "JUDGE", (3, 4): "JUDGE", (1, 5): "JUDGE", (4, 6): "JUDGE"}
    assigned = spark.createDataFrame([(i, i * 10) for i in range(1, 7)], "idx long, cluster long")
    merged = lambda by: {r.idx: r.cluster for r in dedup.merge_clusters(assigned, dedup.accepted_misses(verdicts, by)).collect()}
    assert merged(judge.UncertainJudge()) == {1: 10, 2: 10, 3: 30, 4: 40, 5: 50, 6: 60}
    assert merged(judge.RecordedJudge({1: "DUPLICATE"})) == {1: 10, 2: 10, 3: 30, 4: 40, 5: 10, 6: 60}


def test_fuzzy_join_needs_no_common_start(spark):
    from ledgerloom.operators import legacy

    names = ["the blue cafe shop", "blue cafe shop", "xlue cafe shop", "shop cafe blue", "red barn", "a", "barn red mill store", "store barn mill red"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    a, b = df.withColumnRenamed("name", "x"), df.withColumnRenamed("name", "y")
    for method, score in (("ratio", S._ratio), ("token_sort", lambda p, q: S._ratio(" ".join(sorted(p.split())), " ".join(sorted(q.split()))))):
        got = {(r.x, r.y) for r in legacy.fuzzy_join_all(a, b, "x", "y", method, 85).collect()}
        assert got == {(p, q) for p in names for q in names if score(p, q) > 85}
    assert ("the blue cafe shop", "blue cafe shop") in {(r.x, r.y) for r in legacy.fuzzy_join_all(a, b, "x", "y", "ratio", 85).collect()}
    assert ("blue cafe shop", "shop cafe blue") in got


def _unnamed(*sets):
    return {"name": "BLK_1", "title": "", "roles": "", "contact_sets": [{"contact": c, "contact_type": "email", "type": t} for c, t in sets]}


def test_sets_of_placeholders_settle():
    """Equal sets and those typed "other" go; a specific one takes the place of a person's "other"."""
    person = _unnamed(("a@x", "other"), ("b@x", "work"))
    one, two = _unnamed(("a@x", "work"), ("b@x", "others"), ("c@x", "work")), _unnamed(("c@x", "work"), ("d@x", "other"))
    contacts.settle([one, two], [person])
    show = lambda p: [(s["contact"], s["type"]) for s in p["contact_sets"]]
    assert show(person) == [("b@x", "work"), ("a@x", "work")]
    assert show(one) == [] and show(two) == [("c@x", "work"), ("d@x", "other")]


def test_wide_rows_lose_nothing(spark):
    people = [{"name": f"p{i}", "title": "", "roles": "", "contact_sets": [{"contact": f"{i}-{j}", "contact_type": "t", "type": "w"} for j in range(4)]} for i in range(3)]
    out = contacts.wide(spark.createDataFrame([(1, people), (2, [])], f"id long, people {contacts.SCHEMA}"), "id")
    row = out.where("id = 1").first().asDict()
    assert {v for c, v in row.items() if c.endswith("Contact") or "_Contact_" in c or c.startswith("Contact_")} >= {f"{i}-{j}" for i in range(3) for j in range(4)}


def test_tiled_join_is_an_equi_join(spark):
    from ledgerloom.operators.linkage import tiled_join

    a = spark.range(60).selectExpr("id % 3 as k", "id as x")
    b = spark.range(40).selectExpr("id % 4 as k", "id as y")
    plain = sorted(tuple(r) for r in a.join(b, "k").select("k", "x", "y").collect())
    for most in (1, 7, 50, 1 << 20):
        assert sorted(tuple(r) for r in tiled_join(a, b, ["k"], most).select("k", "x", "y").collect()) == plain


def test_dealt_rows_are_never_broadcast(spark):
    """A file holds each row once, the dealt rows hold it once a tile: the planner's size of them is too small."""
    from ledgerloom.operators.linkage import tiled_join

    a = spark.range(2000).selectExpr("id as x", "id div 10000 as k")
    b = spark.range(2000).selectExpr("id as y", "id div 10000 as k")
    pairs = tiled_join(a, b, ["k"], 1000)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "_i#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    assert pairs.count() == 4_000_000
