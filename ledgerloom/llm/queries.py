"""One query a training-data operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontam, langid, lm_score, minhash, packing, sharding, simhash, substring_dedup, suffix_dedup, url_filter
from ledgerloom.llm.common import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SEARCH_EVERY = 20


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and likenesses; rows with an id divisible by 20 also name what lies within the radius.

    ``near`` holds the classes of equal fingerprints met, the row's own among
    them, each by its least ``doc_id``, its distance and its rows; the other
    rows of a class are those with its fingerprint.
    """
    docs = table(spark, sf_dir, "documents")
    work = Workspace(spark, "simhash")
    prints = work.save(simhash.fingerprint_edits(docs), "prints")
    asked = prints.where(F.col("doc_id") % SEARCH_EVERY == 0)
    found = simhash.search(asked, prints, prints.count())
    # the row itself is one of its class
    one = F.struct("distance", F.col("first_id").alias("doc_id"), F.col("match").alias("fingerprint"), "copies")
    within = found.distinct().groupBy("doc_id").agg((F.sum("copies") - 1).alias("n_in_radius"), F.sort_array(F.collect_list(one)).alias("near"))
    return prints.join(within, "doc_id", "left")


URL_RULES = [
    url_filter.HostRule("com", "/en/", "block"),
    url_filter.HostRule("example.com", "/en/7", "allow"),
    url_filter.HostRule("net", "/de/", "allow"),
    url_filter.HostRule("example.net", "/de/8", "block"),
    url_filter.HostRule("org", "/es/", "block"),
]
#: Whole words of a URL that mark gambling, adult, pharmacy, advertising and spam pages, and session or login pages.
URL_WORDS = ("ads", "adult", "bets", "cart", "casino", "jsessionid", "login", "pills", "poker", "porn", "spam", "viagra", "xxx")
URL_PATTERNS = [url_filter.PatternRule(w, f"(?:^|[^0-9a-z]){w}(?:[^0-9a-z]|$)", "block", (w,)) for w in URL_WORDS]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES, URL_PATTERNS)


OP2_SQL = r"""
with u as (
  select page_id, url,
    case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest,
    translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low
  from pages),
p as (
  select page_id, low,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from u),
r as (
  select * from (values ('com','/en/','block'), ('example.com','/en/7','allow'), ('net','/de/','allow'),
                        ('example.net','/de/8','block'), ('org','/es/','block')) t(rhost, rpath, rverdict)),
m as (
  select p.*, r.rhost || r.rpath as rule, r.rverdict,
    row_number() over (partition by page_id order by length(r.rhost || r.rpath) desc nulls last) as k
  from p left join r on (p.host = r.rhost or ends_with(p.host, '.' || r.rhost)) and starts_with(p.path, r.rpath))
select page_id, host, path, rule, coalesce(rverdict, case when pattern is null then 'allow' else 'block' end) as verdict,
  case when rule is null then pattern end as pattern
from (
  select *, case PATTERNS end as pattern
  from m where k = 1)
""".replace("PATTERNS", " ".join(f"when regexp_matches(low, '{p.regex}') then '{p.name}'" for p in URL_PATTERNS))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("spans").alias("n_spans"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item met in it; clean documents have none."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("digest")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs)).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_score.score(docs, lm_score.fit(docs))


SHARDS = 24


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_url_filter": op2_url_filter,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_minhash": op4_minhash,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_decontam": op6_decontam,
    "op7_langid": op7_langid,
    "op8_packing": op8_packing,
    "op9_sharding": op9_sharding,
    "op10_lm_score": op10_lm_score,
}

ORACLES: dict[str, str] = {"op2_url_filter": OP2_SQL}
