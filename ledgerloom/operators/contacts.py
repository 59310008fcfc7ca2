"""Contacts of a record: extraction, people merged by name, contact sets.

The steps that depend on the order of earlier ones (greedy merges) run in one
Python function a record, in Arrow batches; all else is native.
"""

from __future__ import annotations

import difflib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.normalize import CONTACT_BLANK, base_and_suffix, cell, digits, full_name, literal
from ledgerloom.operators.dedup import row_numbers
from ledgerloom.sources.mapping import resolve

SCHEMA = "array<struct<name:string,title:string,roles:string,contact_sets:array<struct<contact:string,contact_type:string,type:string>>>>"
PLACEHOLDER = "BLK_"


@dataclass
class ContactConfig:
    """Columns of one contact: each a column's base name, a literal ``[value]`` or empty; a person may be several columns."""

    contact: str
    contact_type: str
    type: str
    person: str | list[str] | None = None
    title: str | None = None
    roles: str | None = None


def configs_of(document: dict) -> list[ContactConfig]:
    """The contact part of a field document."""
    return [ContactConfig(c["contact_col"], c["contact_type"], c["type"], c.get("person_col"), c.get("title_col"), c.get("roles_col")) for c in document.get("CONTACT_CONFIG", {}).values()]


def _numbered(columns: list[str], base: str | None, suffix: int) -> Column | None:
    """The cell of ``base_suffix``; the bare column serves the first suffix."""
    found = resolve(columns, f"{base}_{suffix}", stand_ins=True) if base else None
    return cell(F.col(f"`{found}`")) if found else None


def _bare(columns: list[str], base: str | None) -> Column:
    found = resolve(columns, base, stand_ins=True) if base else None
    return cell(F.col(f"`{found}`")) if found else F.lit("")


def _value(columns: list[str], base: str | None, suffix: int) -> Column:
    if literal(base) is not None:
        return F.lit(literal(base))
    here = _numbered(columns, base, suffix)
    return here if here is not None else _bare(columns, base) if suffix == 1 else F.lit("")


def _person(columns: list[str], base: str | list[str] | None, suffix: int) -> Column:
    """F16: several columns joined; a first name is followed by the middle and last name beside it."""
    if isinstance(base, list):
        return full_name(*(_value(columns, b, suffix) for b in base)) if base else F.lit("")
    here = _numbered(columns, base, suffix) if literal(base) is None else None
    if literal(base) is not None or here is not None or suffix > 1 or "first" not in (base or "").lower():
        return _value(columns, base, suffix)
    return full_name(*(_bare(columns, b) for b in name_columns(base)))


def name_columns(base: str) -> list[str]:
    """First, middle and last name columns beside a first name column."""
    if "cntct" in base.lower():
        prefix = base.split("-")[0]
        return [base, f"{prefix}-Mid-Other-Name", f"{prefix}-Last-Name"]
    return [base, *(base.replace("First", part).replace("first", part.lower()) for part in ("Middle", "Last"))]


def most_suffixes(columns: list[str], configs: list[ContactConfig]) -> int:
    """The greatest number of a column that a config reads, 1 at least."""
    bases = {b.lower() for c in configs for x in (c.contact, c.contact_type, c.type, c.person, c.title, c.roles) for b in (x if isinstance(x, list) else [x]) if b}
    return max([1, *(n for base, n in map(base_and_suffix, columns) if n and base.lower() in bases)])


def extracted(df: DataFrame, key: str, configs: list[ContactConfig]) -> DataFrame:
    """(key, people): contacts by suffix, then config; then people without a contact.

    A contact without a person gets the placeholder of its person columns and
    suffix.  Everything is one projection.
    """
    columns = df.columns
    suffixes = range(1, most_suffixes(columns, configs) + 1)
    labels = {k: f"{PLACEHOLDER}{i}" for i, k in enumerate(dict.fromkeys((str(c.person), n) for n in suffixes for c in configs), 1)}
    rows, named = [], []
    for n in suffixes:
        for c in configs:
            person, contact = _person(columns, c.person, n), _value(columns, c.contact, n)
            if literal(c.person) is None:
                named.append(person)
            name = F.when((person == "") & (contact != ""), F.lit(labels[str(c.person), n])).otherwise(person)
            one = F.array(F.struct(contact.alias("contact"), _value(columns, c.contact_type, n).alias("contact_type"), _value(columns, c.type, n).alias("type")))
            sets = F.filter(one, lambda s: s["contact"] != "")
            rows.append(F.struct(name.alias("name"), _value(columns, c.title, n).alias("title"), _value(columns, c.roles, n).alias("roles"), sets.alias("contact_sets")))
    people = F.filter(F.array(*rows), lambda p: p["name"] != "").cast(SCHEMA)
    alone = F.filter(F.array(*named), lambda v: v != "") if named else F.array().cast("array<string>")
    met = F.transform("people", lambda p: p["name"])
    no_sets = F.array().cast("array<struct<contact:string,contact_type:string,type:string>>")
    person = lambda v: F.struct(v.alias("name"), F.lit("").alias("title"), F.lit("").alias("roles"), no_sets.alias("contact_sets"))
    rest = F.transform(F.array_except("_alone", met), person).cast(SCHEMA)
    return df.select(key, people.alias("people"), alone.alias("_alone")).withColumn("people", F.concat("people", rest)).drop("_alone")


def own_contacts(df: DataFrame, key: str) -> DataFrame:
    """Contacts that the master has already, found by their column names.

    ``Name`` (or ``Name_y``), ``Title``, ``Roles`` and up to any number of
    ``Contact``, ``Contact_type``, ``Type``, each bare, numbered in front
    (``2_Name``: the second person) or behind (``Contact_3``: the third set).
    """
    plain = {c.lower(): c for c in df.columns}

    def col(*names):
        return next((cell(F.col(f"`{plain[n]}`")) for n in names if n in plain), None)

    people, p = [], 1
    while True:
        mark = "" if p == 1 else f"{p}_"
        name = col(f"{mark}name_y", f"{mark}name_contact", f"{mark}name") if p == 1 else col(f"{mark}name")
        sets, s = [], 1
        while col(f"{mark}contact" if s == 1 else f"{mark}contact_{s}") is not None:
            tail = "" if s == 1 else f"_{s}"
            sets.append(F.struct(*((col(f"{mark}{f}{tail}") if col(f"{mark}{f}{tail}") is not None else F.lit("")).alias(f) for f in ("contact", "contact_type", "type"))))
            s += 1
        if name is None and not sets:
            break
        held = F.filter(F.array(*sets), lambda x: x["contact"] != "") if sets else F.array().cast("array<struct<contact:string,contact_type:string,type:string>>")
        name = name if name is not None else F.lit("")
        name = F.when((name == "") & (F.size(held) > 0), F.lit(f"{PLACEHOLDER}M{p}")).otherwise(name)
        title, roles = (col(f"{mark}{f}") if col(f"{mark}{f}") is not None else F.lit("") for f in ("title", "roles"))
        people.append(F.struct(name.alias("name"), title.alias("title"), roles.alias("roles"), held.alias("contact_sets")))
        p += 1
    found = F.filter(F.array(*people), lambda x: x["name"] != "").cast(SCHEMA) if people else F.array().cast(SCHEMA)
    return df.select(key, found.alias("people"))


def same_person(a: str, b: str) -> bool:
    """equal, one inside the other, or alike by 0.87."""
    a, b = a.strip().lower(), b.strip().lower()
    if not a or not b:
        return False
    return a == b or a in b or b in a or difflib.SequenceMatcher(None, a, b).ratio() >= 0.87


def merged_list(a: str, b: str) -> str:
    """the second text, taken whole, joins the first's comma list; of two items alike by 0.9 the longer stays."""
    a, b = (a or "").strip(), (b or "").strip()
    if not a or not b or a.lower() == b.lower():
        return a or b
    items = [x.strip() for x in a.split(",") if x.strip()]
    like = next((x for x in items if difflib.SequenceMatcher(None, x.lower(), b.lower()).ratio() >= 0.9), None)
    if like is None:
        return ", ".join([*items, b])
    return ", ".join(max(like, b, key=len) if x == like else x for x in items)


def _better(a: str, b: str) -> str:
    na, nb = len(a.split()), len(b.split())
    return a if na > nb else b if nb > na else min(a, b)


def _norm(s: dict) -> str:
    number = "".join(ch for ch in s["contact"] if ch.isdigit())
    return number[-10:] if "phone" in (s["contact_type"] or "") and number else s["contact"].strip().lower()


def united_sets(sets: list[dict]) -> list[dict]:
    """One of equal contacts; a set typed "other" goes if a specific one has its contact."""
    out: list[dict] = []
    for s in sets:
        if (s["contact"] or "").strip().lower() in CONTACT_BLANK:
            continue
        twin = next((i for i, o in enumerate(out) if _norm(o) == _norm(s) and (o["contact_type"] or "").lower() == (s["contact_type"] or "").lower()), None)
        if twin is None:
            out.append(dict(s))
        elif (out[twin]["type"] or "").lower().startswith("other") and not (s["type"] or "").lower().startswith("other"):
            out[twin] = dict(s)
    return out


def deduplicated(people: list[dict]) -> list[dict]:
    """Each person joins the first like one before it; unnamed contacts that a person has go."""
    kept: list[dict] = []
    for p in people:
        p = {**p, "contact_sets": list(p["contact_sets"])}
        unnamed = p["name"].startswith(PLACEHOLDER)
        for k in kept:
            if not unnamed and not k["name"].startswith(PLACEHOLDER) and same_person(k["name"], p["name"]):
                k["name"] = _better(k["name"], p["name"])
                k["title"], k["roles"] = merged_list(k["title"], p["title"]), merged_list(k["roles"], p["roles"])
                k["contact_sets"] += p["contact_sets"]
                break
        else:
            kept.append(p)
    for k in kept:
        k["contact_sets"] = united_sets(k["contact_sets"])
    unnamed = [k for k in kept if k["name"].startswith(PLACEHOLDER)]
    settle(unnamed, [k for k in kept if not k["name"].startswith(PLACEHOLDER)])
    return [k for k in kept if k["contact_sets"] or not k["name"].startswith(PLACEHOLDER)]


def _claim(own: dict, other: dict) -> str:
    """How a placeholder's set stands to another set: ``goes``, ``wins`` or nothing.

    It goes if both are the same, or if only its own type is "other"; it wins
    where only the other set's type is.
    """
    vague = lambda s: (s["type"] or "").strip().lower() in ("other", "others")
    kind = lambda s: (s["contact_type"] or "").strip().lower()
    if kind(own) != kind(other):
        return ""
    if _norm(own) == _norm(other) and (own["type"] or "").strip().lower() == (other["type"] or "").strip().lower():
        return "goes"
    if own["contact"].strip().lower() == other["contact"].strip().lower() and vague(own) != vague(other):
        return "goes" if vague(own) else "wins"
    return ""


def settle(unnamed: list[dict], named: list[dict]) -> None:
    """N6, in place: sets of placeholders against those of other placeholders, then against those of people.

    A set that wins takes the other's place: among placeholders the other set
    is dropped, from a person it is replaced and leaves its placeholder.
    """
    for k in unnamed:
        for own in list(k["contact_sets"]):
            for holder in [*(u for u in unnamed if u is not k), *named]:
                claims = [(other, _claim(own, other)) for other in holder["contact_sets"]]
                other, claim = next(((o, c) for o, c in claims if c), (None, ""))
                if not claim:
                    continue
                if claim == "wins":
                    holder["contact_sets"].remove(other)
                    if holder in unnamed:
                        continue
                    holder["contact_sets"].append(own)
                k["contact_sets"].remove(own)
                break


def merged_people(df: DataFrame, key: str) -> DataFrame:
    """N4-N7 and P18 for every row of (key, people)."""

    def run(batches):
        for b in batches:
            rows = []
            for people in b["people"]:
                done = deduplicated([{**p, "contact_sets": [dict(s) for s in p["contact_sets"]]} for p in people])
                rows.append([{**p, "name": "-" if p["name"].startswith(PLACEHOLDER) else p["name"]} for p in done])
            yield pd.DataFrame({key: b[key], "people": rows})

    return df.select(key, "people").mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, people {SCHEMA}")


def appended(people: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """People of the master's own contacts after the extracted ones."""
    m = more.select(key, F.col("people").alias("_more"))
    return people.join(m, key, "left").withColumn("people", F.concat("people", F.coalesce("_more", F.array().cast(SCHEMA)))).drop("_more")


def widths(df: DataFrame) -> tuple[int, int]:
    """(people, contact sets of one person): the most that a row holds."""
    row = df.agg(F.max(F.size("people")).alias("p"), F.max(F.array_max(F.transform("people", lambda p: F.size(p["contact_sets"])))).alias("s")).first()
    return max(1, row["p"] or 1), max(1, row["s"] or 1)


def wide(df: DataFrame, key: str, people: int | None = None, sets: int | None = None) -> DataFrame:
    """N8, at the edge: ``Name, Title, Roles, Contact, ...`` with numbers for the second and later.

    As many columns as the fullest row needs, unless widths are given.
    """
    if people is None or sets is None:
        most = widths(df)
        people, sets = people or most[0], sets or most[1]
    cols = []
    for p in range(people):
        mark = "" if p == 0 else f"{p + 1}_"
        person = F.get("people", F.lit(p))
        cols += [F.coalesce(person[f], F.lit("")).alias(f"{mark}{f.title()}") for f in ("name", "title", "roles")]
        for s in range(sets):
            tail = "" if s == 0 else f"_{s + 1}"
            set_ = F.get(person["contact_sets"], F.lit(s))
            cols += [F.coalesce(set_[f], F.lit("")).alias(f"{mark}{f.capitalize()}{tail}") for f in ("contact", "contact_type", "type")]
    return df.select(key, *cols)


def cleaned(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """P18 on wide rows: a blank name or a placeholder is ``-``; elsewhere ``-`` is blank."""
    out = []
    for c in df.columns:
        v = F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
        if c in keep:
            out.append(F.col(f"`{c}`"))
        elif c == "Name" or c.endswith("_Name"):
            out.append(F.when((v == "") | v.rlike(f"^{PLACEHOLDER}"), "-").otherwise(v).alias(c))
        else:
            out.append(F.when(v == "-", "").otherwise(v).alias(c))
    return df.select(*out)


def attach_ids(df: DataFrame, order: list[str], ids: DataFrame, id_column: str, id_order: list[str]) -> DataFrame:
    """The i-th row in order gets the i-th id, an empty one past the end of the ids."""
    left = row_numbers(df, order, "_row")
    right = row_numbers(ids.select(id_column, *(c for c in id_order if c != id_column)), id_order, "_row").select("_row", F.col(id_column).cast("string").alias("ID"))
    return left.join(right, "_row", "left").withColumn("ID", F.coalesce("ID", F.lit(""))).drop("_row")


def phone_key(c):
    return F.right(digits(c), F.lit(10))
