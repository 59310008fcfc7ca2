"""Business and custom sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import values as V
from ledgerloom.functions.normalize import text
from ledgerloom.operators.dedup import row_numbers
from ledgerloom.sources.mapping import output_frame

# State and province abbreviations by country.
STATES = {
    "United States": "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".split(),
    "Canada": "AB BC MB NB NL NS ON PE QC SK NT NU YT".split(),
}
#: Limits of the text types.
SMALL, MEDIUM = 256, 4096


def with_country(df: DataFrame, state: str, out: str = "country") -> DataFrame:
    """Country of a state abbreviation, else empty; the table has 63 rows."""
    pairs = [(s, c) for c, states in STATES.items() for s in states]
    table = F.create_map(*(F.lit(x) for p in pairs for x in p))
    return df.withColumn(out, F.coalesce(F.element_at(table, text(F.col(state))), F.lit("")))


def sequence_ids(df: DataFrame, order: list[str], prefix: str, out: str = "id") -> DataFrame:
    """Prefix and the row's number, as wide as the count of rows."""
    numbered = row_numbers(df, order, "_k")
    width = numbered.agg(F.length(F.count(F.lit(1)).cast("string")).alias("_w"))
    return numbered.crossJoin(F.broadcast(width)).withColumn(out, F.concat(F.lit(prefix), F.lpad((F.col("_k") + 1).cast("string"), F.col("_w"), F.lit("0")))).drop("_k", "_w")


def data_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, data_type) of all columns in one scan; without rows small text."""
    tests = []
    for i, name in enumerate(columns):
        c = text(F.col(f"`{name}`"))
        facts = (F.bool_and(V.is_float(c)), F.bool_and(c.rlike(r"^\d{4}$")), F.bool_and(V.parsed_date(c).isNotNull()))
        tests += [F.coalesce(f, F.lit(False)).alias(f"f{i}_{k}") for k, f in enumerate(facts)]
        tests.append(F.coalesce(F.max(F.length(c)), F.lit(0)).alias(f"f{i}_3"))

    def kind(i):
        number, year, date, longest = (F.col(f"f{i}_{k}") for k in range(4))
        short = F.when(longest < SMALL, "Text(Small)").when(longest < MEDIUM, "Text(Medium)").otherwise("Text(Large)")
        return F.when(number, "Number").when(year, "Year").when(date, "Date").otherwise(short)

    one = df.agg(*tests).select(F.array(*(F.struct(F.lit(c).alias("column_name"), kind(i).alias("data_type")) for i, c in enumerate(columns))).alias("t"))
    return one.select(F.inline("t"))


def typed(c: Column, kind: str) -> Column:
    """B2: a packed cell by its column's type."""
    return {"Number": V.largest_number, "Year": V.earliest_year, "Date": V.earliest_date}.get(kind, text)(c)


def business_sheet(df: DataFrame, fields: dict[str, list[str]], *, source: str, last: tuple[str, ...] = ("Lat", "Long", "Website"), state: str = "State") -> DataFrame:
    """B1: every target field from the first filled of its sources; constants; some columns moved to the end."""
    have = set(df.columns)
    cols = {f: V.first_filled(*(F.col(f"`{c}`") for c in sources if c in have)) if any(c in have for c in sources) else F.lit("") for f, sources in fields.items()}
    keys = [c for c in df.columns if c.endswith("_index") or c == "uuid"]
    out = df.select(*keys, *(v.alias(k) for k, v in cols.items()), F.lit("True").alias("is_business"), F.lit(source).alias("business_source"))
    if state in cols and "Country" not in cols:
        out = with_country(out, state, "Country")
    end = [c for c in last if c in out.columns]
    return out.select(*(c for c in out.columns if c not in end), *end)


def custom_sheet(df: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """B2's end: custom columns reduced by type, with two metadata rows in front.

    The rows carry ``ordinal`` (0 types, 1 who defines, 2 data), since a table has no order.
    """
    data = df.select(F.lit(2).alias("ordinal"), F.col(key).cast("string").alias(key), *(typed(F.col(f"`{c}`"), k).alias(c) for c, k in kinds.items()))
    head = data.sparkSession.createDataFrame([(0, "Custom Data Type", *kinds.values()), (1, "ID", *("User Defined" for _ in kinds))], data.schema)
    return head.unionByName(data)


# Types of columns that are not inferred.
FIXED_TYPES = {
    "Primary SIC Code and Sector": "Number", "PRIMARY SIC SECTOR": "Text(Small)",
    "Primary NAICS Code and Sector": "Number", "PRIMARY NAICS SECTOR": "Text(Small)",
}


def custom_records(df: DataFrame, key: str, matched: dict[str, str], new_fields: list[str]) -> DataFrame:
    """B2: the custom sheet of records with numbered source columns.

    ``matched``: source column to custom column.  A source's cells are its
    numbered columns, distinct and joined (A6); its type is inferred from the
    first of them (A12) unless it is a fixed one, and reduces the cells.
    """
    sources = {**{s: t for s, t in matched.items()}, **{f: f for f in new_fields}}
    numbered = {s: [c for c in df.columns if c.startswith(f"{s}_")] for s in sources}
    probe = {s: f"{s}_1" if f"{s}_1" in df.columns else s if s in df.columns else None for s in sources}
    known = [s for s in sources if probe[s]]
    found = df.select(*(F.col(f"`{probe[s]}`").alias(s) for s in known))
    kinds = {r["column_name"]: r["data_type"] for r in data_types(found, known).collect()} if known else {}  # one row a column
    types = {t: FIXED_TYPES.get(t, kinds.get(s, "Text(Small)")) for s, t in sources.items()}
    packed = df.select(key, *(V.distinct_joined(F.array(*(F.col(f"`{c}`") for c in numbered[s])) if numbered[s] else F.array().cast("array<string>")).alias(t) for s, t in sources.items()))
    return custom_sheet(packed.withColumnRenamed(key, "Custom Data Name"), "Custom Data Name", types)


# Target fields and their names in the business sheet.
SHEET_NAMES = {"Business Name": "Name", "Phonenumber": "Phonenumber", "Zipcode": "Zipcode"}


def renamed_sheet(df: DataFrame, state: str = "State") -> DataFrame:
    """P10: output names, and the country of the state."""
    out = df.withColumnsRenamed({c: n for c, n in SHEET_NAMES.items() if c in df.columns})
    return with_country(out, state, "Country") if state in out.columns else out


def step_outputs(matched: DataFrame, additional: DataFrame, document: dict, prefix: str, *, key: str = "uuid", order: str) -> dict[str, DataFrame]:
    """Business and custom sheets of matched and of additional records.

    Matched records keep their id and come from the master; additional ones get
    sequence ids with ``prefix`` in order of ``order`` and come from the user.
    """
    fields = dict.fromkeys(document["COLUMNS_LIST"])
    for target in fields:
        of = [s for s, t in zip(document["BUSINESS_MATCHED_REGISTRY_COLUMNS"], document["BUSINESS_MATCHED_MASTER_COLUMNS"], strict=True) if t == target]
        fields[target] = [c for s in of for c in (f"{s}_1", s)] + [target, f"{target}_1"]
    custom = dict(zip(document["CUSTOM_MATCHED_REGISTRY_COLUMNS"], document["CUSTOM_MATCHED_MASTER_COLUMNS"], strict=True))
    new = document["NEW_FIELDS"]
    out = {}
    for name, frame, source in (("matched", matched, "master"), ("additional", additional, "user")):
        ready = frame.withColumn("ID", F.col(key).cast("string")) if name == "matched" else sequence_ids(frame, [order], prefix, "ID")
        ready = output_frame(ready, document)
        business = business_sheet(ready.withColumn("uuid", F.col("ID")), fields, source=source)
        out[f"business_{name}"] = business.withColumnRenamed("uuid", "ID").drop(*(c for c in business.columns if c.endswith("_index")))
        if custom or new:
            out[f"custom_{name}"] = custom_records(ready, "ID", custom, new)
    return out
