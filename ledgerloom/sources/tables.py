"""Sources and sinks (S1-S11, K1-K12): sheets as folders of a workbook folder, decisions as appended files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, JSON or CSV by the ending; every column a string, nulls empty."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "json":
        df = spark.read.json(path, primitivesAsString=True)
    elif kind in ("csv", "tsv", "txt"):
        df = spark.read.csv(path, header=True, inferSchema=False, sep="\t" if kind == "tsv" else ",", multiLine=True, escape='"')
    elif kind == "orc":
        df = spark.read.orc(path)
    else:
        df = spark.read.parquet(path)
    return df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns))


def pick_sheet(names: list[str], wanted: str, fallback: bool = False) -> str | None:
    """The first name that holds the wanted one, without case; the business sheet falls back to the first."""
    return next((n for n in names if wanted.lower() in n.lower()), names[0] if fallback and names else None)


def read_workbook(spark: SparkSession, sheets: dict[str, str]) -> dict[str, DataFrame]:
    """{sheet name: path} to the business, custom and contact tables that are there."""
    names = list(sheets)
    picked = {"business": pick_sheet(names, "business", True), "custom": pick_sheet(names, "custom"), "contact": pick_sheet(names, "contact")}
    return {k: read_sheet(spark, sheets[n]) for k, n in picked.items() if n}


def header(spark: SparkSession, path: str) -> list[str]:
    """S3: no job but the schema's."""
    return read_sheet(spark, path).columns


def sample(df: DataFrame, n: int = 3) -> DataFrame:
    """S4."""
    return df.limit(n)


def custom_columns(df: DataFrame) -> list[str]:
    """S5."""
    return [c for c in df.columns if c not in ("UUID", "Custom Data Name", "ID")]


def partition_scan(spark: SparkSession, path: str, **where) -> DataFrame:
    """Rows of a partitioned table; conditions on partition columns prune its folders."""
    df = spark.read.parquet(path)
    for column, value in where.items():
        df = df.where(F.col(column) == value)
    return df


def sheet_columns(spark: SparkSession, sheets: dict[str, str], wanted: str = "custom") -> list[str]:
    """The custom columns of the sheet whose name holds ``wanted``; none without such a sheet."""
    name = pick_sheet(list(sheets), wanted)
    return custom_columns(read_sheet(spark, sheets[name])) if name else []


def abbreviations(spark: SparkSession, path: str) -> dict[str, str]:
    """A JSON object of word and expansion; empty if there is no such file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return load_schema(path, spark) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else {}


def register_city(spark: SparkSession, cities: str, name: str, kind: str, registry: str, master: str) -> list[str]:
    """Appends a city with the paths of its files, and gives the registry's columns."""
    row = spark.createDataFrame([(name, kind, registry, master)], "name string, city_or_county string, raw_data_path string, export_path string")
    row.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(cities)
    return header(spark, registry)


def three_files(registry: DataFrame, master: DataFrame, matched: DataFrame, a_key: str, b_key: str, system: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """L-K13: matched pairs side by side with ``_1`` and ``_2``, and what is left of either side.

    Names in ``system`` keep their name in the matched file; the files of the
    rest bear their key once more at the end, without a number.
    """
    keep = {a_key, b_key, *system}
    a = registry.select(*_ends(registry, 1, keep))
    b = master.select(*_ends(master, 2, keep))
    return {"matched": matched.select(a_key, b_key).join(a, a_key).join(b, b_key), "registry": rest_file(registry, matched, a_key, 1), "master": rest_file(master, matched, b_key, 2)}


def _ends(df: DataFrame, n: int, keep: set[str]) -> list[Column]:
    return [F.col(f"`{c}`").alias(c if c in keep else f"{c}_{n}") for c in df.columns]


def rest_file(records: DataFrame, matched: DataFrame, key: str, n: int) -> DataFrame:
    """L-K13: what is left of one side, numbered, its key once more at the end; ``matched`` needs the key alone."""
    return records.join(matched.select(key).distinct(), key, "left_anti").select(*_ends(records, n, set()), F.col(key))


def numbered(pairs: DataFrame, row: str, n: int, key: str) -> list[Column]:
    """L-K13: the fields of a pair's original row but its key, with their number."""
    return [F.col(f"{row}.`{c}`").alias(f"{c}_{n}") for c in pairs.schema[row].dataType.names if c != key]


def prefixed(pairs: DataFrame, a: str, b: str, keys: tuple[str, ...], prefix: str = "master_") -> list[Column]:
    """L-K14 of pairs that hold both rows: the fields but the keys; one of ``b`` whose name is taken gets the prefix."""
    taken, own = pairs.schema[a].dataType.names, pairs.schema[b].dataType.names
    renamed = [F.col(f"{b}.`{c}`").alias(f"{prefix}{c}" if c in taken else c) for c in own if c not in keys]
    return [F.col(f"{a}.`{c}`") for c in taken if c not in keys] + renamed


def matched_export(matched: DataFrame, registry: DataFrame, master: DataFrame, a_key: str, b_key: str, prefix: str = "master_") -> DataFrame:
    """L-K14: both records of each pair in one row; a master column whose name is taken gets the prefix."""
    taken = set(registry.columns)
    b = master.select(*(F.col(c).alias(f"{prefix}{c}" if c in taken else c) for c in master.columns))
    return matched.select(a_key, b_key).join(registry, a_key).join(b, b_key)


def concatenated(business: DataFrame, custom: DataFrame | None, contact: DataFrame | None, how: str = "left") -> DataFrame:
    """J1, J2 (left) and L-J3 (inner): side tables by their id column, clashing names with a suffix."""
    out = business
    for side, key, suffix in ((custom, "Custom Data Name", "_custom"), (contact, "ID", "_contact")):
        if side is None:
            continue
        on = key if key in side.columns else "UUID"
        clash = {c: f"{c}{suffix}" for c in side.columns if c in out.columns or c == on}
        renamed = side.withColumnsRenamed(clash)
        out = out.join(renamed, out["UUID"] == renamed[clash[on]], how)
        if on == "UUID":
            out = out.drop(clash[on])
    return out


def write_sheet(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """K1, K3."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).option("escape", '"').option("emptyValue", "").csv(path) if kind == "csv" else writer.format(kind).save(path)


def write_workbook(sheets: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """K2, K4, L-K15, L-K16: a folder a sheet; an existing sheet is replaced."""
    for name, df in sheets.items():
        write_sheet(df, f"{path}/{name}", kind)


def replace_partition(df: DataFrame, path: str, keys: list[str]) -> None:
    """Rewrites only the partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Decisions are never changed, only followed by later ones."""
    df.write.mode("append").parquet(path)


def save_schema(document: dict, path: str, spark: SparkSession) -> bool:
    """K6: written if it is not there; true if written."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p):
        return False
    out = fs.create(p)
    out.write(bytearray(json.dumps(document, indent=2).encode()))
    out.close()
    return True


def load_schema(path: str, spark: SparkSession) -> dict:
    """S8."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
