"""Column mapping: guesses from headers, renames, resolution, field documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Target fields, and which are required.
TARGETS = {
    "Business Name": True, "Address1": True, "Address2": False, "City": False, "State": False, "Country": False, "Zipcode": False,
    "Phonenumber": False, "Website": False, "Lat": False, "Long": False, "DBA Name": False, "Business Operational Status": False,
}
SKIP = "SKIP"
# The listing of the target schema, in order: (field, required).
TARGET_SCHEMA = [
    ("Business Name", True), ("Address1", True), ("Address2", False), ("City", False), ("State", False), ("ZIP", False), ("Phone", False),
    ("Email", False), ("Website", False), ("Owner Name", False), ("Owner Phone", False), ("Owner Email", False), (SKIP, False),
]
# Squeezed headers that stand in for a missing e-mail, phone or name column.
STAND_INS = {
    "email": ("email", "mainemail", "accountemail", "contactemail"),
    "phone": ("phone", "phonenumber", "mainaccountphone", "accountphone", "contactphone"),
    "name": ("name", "contactname", "personname"),
}
# Header patterns after lower-casing and dropping all but letters and digits: (pattern, unless, field).
HEADERS = [
    (r"businessname|dbaname|companyname|bizname", r"owner|contact", "Business Name"),
    (r"^name$", None, "Business Name"),
    (r"address1|streetaddress|addr1|^address$", r"2|two|owner", "Address1"),
    (r"address2|addr2|suite|unit", None, "Address2"),
    (r"^city$", None, "City"),
    (r"^state$|statecode", None, "State"),
    (r"^country$", None, "Country"),
    (r"^zip|postal|zipcode", None, "Zipcode"),
    (r"^phone$|businessphone", r"owner", "Phonenumber"),
    (r"website|^web$|^url$", None, "Website"),
    (r"^lat$|latitude", None, "Lat"),
    (r"^lon$|^lng$|^long$|longitude", None, "Long"),
]
CONTACT_HEADERS = [
    (rf"{who}{what}|{who}.*{what}", kind, who.title()) for who in ("owner", "manager", "contact") for what, kind in (("email", "email"), ("phone", "phone_number"))
]


def guess_field(column: Column) -> Column:
    """P20 over a column of headers."""
    c = F.regexp_replace(F.lower(column), r"[^a-z0-9]", "")
    out = F.lit(SKIP)
    for pattern, unless, name in reversed(HEADERS):
        fits = c.rlike(pattern) & ~c.rlike(unless) if unless else c.rlike(pattern)
        out = F.when(fits, name).otherwise(out)
    return out


def guess_contact(column: str) -> tuple[str, str] | None:
    """(contact type, role) of a header, or none."""
    c = re.sub(r"[^a-z0-9]", "", column.lower())
    return next(((kind, role) for pattern, kind, role in CONTACT_HEADERS if re.search(pattern, c)), None)


def apply_mapping(df: DataFrame, mapping: dict[str, str], required: tuple[str, ...] = ("Business Name", "Address1")) -> DataFrame:
    """Renames, drops skipped columns, keeps the first of equal names, adds what is missing."""
    seen, cols = set(), []
    for c in df.columns:
        name = mapping.get(c, c)
        if name != SKIP and name not in seen:
            seen.add(name)
            cols.append(F.col(f"`{c}`").alias(name))
    return df.select(*cols, *(F.lit("").alias(r) for r in required if r not in seen))


def target_schema(spark: SparkSession) -> DataFrame:
    """P24."""
    rows = [(i, field, required) for i, (field, required) in enumerate(TARGET_SCHEMA)]
    return spark.createDataFrame(rows, "place int, field string, required boolean")


def resolve(columns: list[str], wanted: str, *, stand_ins: bool = False) -> str | None:
    """Exact, numbered, without case, without spaces; for contacts the usual e-mail, phone and name columns."""
    if not wanted:
        return None
    folded = lambda s: s.strip().lower()
    squeezed = lambda s: folded(s).replace(" ", "").replace("_", "")
    low, tight = folded(wanted), squeezed(wanted)
    tests = [lambda c: c == wanted, lambda c: c == f"{wanted}_1", lambda c: folded(c) in (low, f"{low}_1"), lambda c: squeezed(c) in (tight, f"{tight}1")]
    if stand_ins:
        kind = "email" if "email" in low else "phone" if "phone" in low else "name" if "name" in low and "business" not in low and "account" not in low else ""
        tests.append(lambda c: squeezed(c) in STAND_INS.get(kind, ()))
    return next((c for test in tests for c in columns if test(c)), None)


def mapping_dict(mappings: DataFrame) -> dict[str, str]:
    """Source to target of a stated set of mapping rows; a later row wins."""
    return {r["source_col"]: r["target_col"] for r in mappings.select("source_col", "target_col").collect()}


def clean_header(name: str) -> str:
    """P5, P6."""
    return re.sub(r"\.\d+$", "", re.sub(r"^(\d+_)+", "", name))


def field_document(mappings: list[dict], registry_columns: list[str] = ()) -> dict:
    """Mapping rows (source_col, target_col, mapping_type, meta) as the lists the output steps read.

    A custom row with a ``master_custom_col`` fills that column; one without is
    a new field, unless its column already serves another purpose.
    """
    kind = lambda k: [m for m in mappings if m["mapping_type"] == k]
    meta = lambda m: m.get("meta") or {}
    business = [m for m in kind("business") if m["target_col"] in TARGETS]
    contact = kind("contact")
    matched = [m for m in kind("custom") if meta(m).get("master_custom_col")]
    used = {m["source_col"] for m in (*business, *contact, *matched)}
    new = list(dict.fromkeys(m["source_col"] for m in kind("custom") if m not in matched and m["source_col"] not in used))
    here = lambda source: resolve_numbered(registry_columns, source)
    pick = lambda *fields: [here(m["source_col"]) for m in business if m["target_col"] in fields]
    filled = {m["target_col"] for m in business}
    bracketed = lambda v: v if v.startswith("[") else f"[{v}]"
    return {
        "BUSINESS_MATCHED_REGISTRY_COLUMNS": [m["source_col"] for m in business],
        "BUSINESS_MATCHED_MASTER_COLUMNS": [m["target_col"] for m in business],
        "COLUMNS_LIST": [t for t, required in TARGETS.items() if required or t in filled],
        "CUSTOM_MATCHED_REGISTRY_COLUMNS": [m["source_col"] for m in matched],
        "CUSTOM_MATCHED_MASTER_COLUMNS": [meta(m)["master_custom_col"] for m in matched],
        "NEW_FIELDS": new,
        "NAME_LIST": pick("Business Name", "DBA Name"), "ADDRESS_LIST": pick("Address1"), "PHONE_LIST": pick("Phonenumber"),
        "CONTACT_CONFIG": {
            f"contact_{i}": {
                "person_col": meta(m).get("person_col_parts") or meta(m).get("person_col", ""), "title_col": meta(m).get("title_col", ""), "roles_col": meta(m).get("roles_col", ""),
                "contact_col": m["source_col"], "contact_type": bracketed(meta(m).get("contact_type") or "email"), "type": bracketed(meta(m).get("type") or "office"),
            }
            for i, m in enumerate(contact, 1)
        },
    }


def resolve_numbered(columns: list[str], source: str) -> str:
    """The first numbered column of a source if there is one, the bare one otherwise; the source itself if neither is there."""
    for test in (lambda c: c == f"{source}_1", lambda c: c == source, lambda c: c.lower() == f"{source}_1".lower(), lambda c: c.lower() == source.lower()):
        found = next((c for c in columns if test(c)), None)
        if found:
            return found
    return source


def output_frame(df: DataFrame, document: dict) -> DataFrame:
    """Every listed column is there, every source also as ``<source>_1``; what is missing is empty."""
    sources = [*document.get("BUSINESS_MATCHED_REGISTRY_COLUMNS", []), *document.get("CUSTOM_MATCHED_REGISTRY_COLUMNS", []), *document.get("NEW_FIELDS", [])]
    listed = [*document.get("COLUMNS_LIST", []), *document.get("BUSINESS_MATCHED_MASTER_COLUMNS", [])]
    new = {c: F.lit("") for c in listed if c not in df.columns}
    for source in dict.fromkeys(sources):
        found = resolve(df.columns, source)
        new[source] = new[f"{source}_1"] = F.col(f"`{found}`") if found else F.lit("")
    return df.withColumns(new)
