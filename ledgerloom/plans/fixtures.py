"""Registry, master and side tables derived from the star-schema tables, by the same SQL in Spark and elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REGISTRY = """select p_partkey as registry_index,
 case when p_partkey % 17 = 0 then '' else concat(p_name, ' ', lower(p_type),
   case p_partkey % 6 when 0 then ' LLC' when 1 then ' Inc' when 2 then ' & Co' when 3 then ' Group' else '' end) end as business_name,
 case when p_partkey % 11 = 0 then ''
      when p_partkey % 13 = 0 then concat('P.O. Box ', cast(p_size as string))
      else concat(cast(100 + p_partkey % 97 as string), case when p_partkey % 7 = 0 then '-3040' else '' end,
        ' ', replace(p_brand, '#', ' '),
        case p_partkey % 3 when 0 then ' Street' when 1 then ' Avenue' else ' Road' end,
        case p_partkey % 5 when 0 then ' STE 100' when 1 then ' # 1/2' else '' end) end as address1
from part"""

MASTER = """select p_partkey as master_index, concat('U', cast(p_partkey as string)) as uuid,
 concat(upper(p_name), ' ', p_type, case p_partkey % 4 when 0 then ' LIMITED' when 1 then ', CORP.' else '' end) as name,
 case when p_partkey % 19 = 0 then ''
      else concat(cast(100 + (p_partkey + case when p_partkey % 23 = 0 then 1 else 0 end) % 97 as string),
        ' ', replace(p_brand, '#', ' '),
        case p_partkey % 3 when 0 then ' St' when 1 then ' Ave' else ' Rd' end) end as address1
from part where p_partkey % 3 <> 2"""

#: Custom fields of some master records, and packed cells for the value functions.
CUSTOM = """select concat('U', cast(p_partkey as string)) as custom_uuid, p_size as seats,
 concat(cast(p_size as string), ';', cast(p_retailprice as string), ' a', cast(p_partkey % 10 as string), 'b') as capacity,
 concat('03/0', cast(1 + p_partkey % 9 as string), '/', cast(1990 + p_partkey % 30 as string), ';', cast(1985 + p_partkey % 40 as string)) as opened,
 concat('0', cast(1 + p_partkey % 9 as string), '/1', cast(p_partkey % 10 as string), '/2010;01/02/', cast(2000 + p_partkey % 20 as string), ' n/a') as permit_dates,
 case p_partkey % 4 when 0 then 'CA' when 1 then 'ON' when 2 then 'California' else '' end as state
from part where p_partkey % 2 = 0"""

CONTACTS = """select concat('U', cast(c_custkey as string)) as id, c_name as person, c_mktsegment as title,
 concat('555-', cast(100 + c_custkey % 900 as string), '-', cast(1000 + c_custkey % 9000 as string)) as phone_1,
 concat('1 (555) ', cast(100 + c_custkey % 900 as string), ' ', cast(1000 + (c_custkey + c_custkey % 2) % 9000 as string)) as phone_2,
 case when c_custkey % 5 = 0 then '' else concat(cast(1000 + c_custkey % 9000 as string), '') end as phone_3,
 concat(lower(replace(c_name, '#', '.')), '@example.com') as email
from customer"""

#: Reviews of pairs: the latest decision of a pair counts.
DECISIONS = """select event_id, user_id as pair_id, ts as reviewed_at,
 case event_type when 'click' then 'HUMAN_ACCEPT' when 'purchase' then 'HUMAN_ACCEPT' else 'HUMAN_REJECT' end as decision
from events"""


#: Pairs of possible duplicates with a decision, the clusters of their records, and a batch of new decisions.
DUPLICATES = """select o_orderkey as pair_id, o_custkey % 60 as index_a, 60 + o_orderkey % 60 as index_b, (o_orderkey % 1000) / 1000e0 as similarity,
 case o_orderstatus when 'F' then 'DUPLICATE' when 'O' then 'UNCERTAIN' else 'NOT_DUPLICATE' end as decision, o_orderkey % 3 = 0 as intra_cluster
from orders"""
ASSIGNED = "select p_partkey as idx, p_partkey % 45 as cluster from part where p_partkey < 110"
BATCH = """select o_orderkey * 3 as pair_id, case o_orderkey % 2 when 0 then 'DUPLICATE' else 'NOT_DUPLICATE' end as decision
from orders where o_orderkey % 211 = 5"""
#: Several runs of each step, and the states they went through.
STEP_LOG = """select event_id as log_id, concat(cast(user_id % 40 as string), '/', event_type) as step_key, user_id % 40 as run_id, event_type as step, ts as seen_at,
 case when value < 30 then 'failed' when value < 60 then 'running' else 'completed' end as status from events"""
#: Records of several owners, phones and mails, in numbered columns.
OWNERS = """select c_custkey as owner_id, concat('First', cast(c_custkey % 7 as string)) as owner_first, case when c_custkey % 3 = 0 then '' else 'M.' end as owner_middle,
 case when c_custkey % 5 = 0 then '-' else concat('Last', cast(c_custkey % 11 as string)) end as owner_last, concat('555', cast(1000000 + c_custkey as string)) as phone_1,
 case when c_custkey % 2 = 0 then concat('556', cast(1000000 + c_custkey as string)) else 'nan' end as phone_2, case when c_custkey % 4 = 1 then 'Jo Roe' else '' end as manager_1,
 case when c_custkey % 4 = 2 then 'Al Poe' else '' end as manager_2, case when c_custkey % 6 = 0 then concat(lower(c_mktsegment), '@example.com') else 'none' end as email from customer"""


def _load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs a one-table select over the Parquet table without registering a view."""
    head, _, rest = sql.rpartition("from ")
    table, _, where = rest.partition(" where ")
    df = _load(spark, sf_dir, table.strip())
    if where:
        df = df.where(where)
    return df.selectExpr(*_split(head.strip().removeprefix("select ")))


def _split(columns: str) -> list[str]:
    """Top-level commas."""
    out, depth, quoted, last = [], 0, False, 0
    for i, ch in enumerate(columns):
        if ch == "'":
            quoted = not quoted
        elif not quoted and ch in "()":
            depth += 1 if ch == "(" else -1
        elif not quoted and ch == "," and not depth:
            out.append(columns[last:i])
            last = i + 1
    return [*out, columns[last:]]


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, REGISTRY)


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, MASTER)


def custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, CUSTOM)


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, CONTACTS)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, DECISIONS)


def table_of(sql: str):
    """A fixture as a function of (spark, sf_dir)."""
    return lambda spark, sf_dir: derive(spark, sf_dir, sql)


duplicates, assigned, batch, step_log, owners = map(table_of, (DUPLICATES, ASSIGNED, BATCH, STEP_LOG, OWNERS))
