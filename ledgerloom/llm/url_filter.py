"""URL filters from DataFrame functions only.

Two kinds of rules are matched:

* ``HostRule``: a host with all its subdomains and a path prefix;
* ``PatternRule``: a regular expression with the literal tokens any match must
  contain (given, or read from its literal part).

Both are indexed by their rarest literal token in the given URLs.  A URL's
distinct tokens fetch candidate rules from that index, and only candidates run
their regular expression.  Among fitting host rules the longest wins; pattern
rules decide only where no host rule fits (block wins over allow), and a URL
that fits nothing gets the default verdict.

Up to ``INLINE_RULES`` rules the index is a literal in the plan: no join and no
shuffle.  Beyond, URL tokens are exploded and joined to the index table, which
Spark broadcasts only if its measured size is under the session's threshold.

Null URL or URL without ``://``: host and path are empty, no rule fits and the
default verdict holds.  Repeated rows are each judged; an empty table gives an
empty result.  Columns of the input other than the id and the URL are dropped.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
INLINE_RULES = 256


def _tokens(text: str) -> list[str]:
    return [t for t in re.split(r"[^0-9a-z]+", text.lower()) if t]


@dataclass(frozen=True)
class HostRule:
    """``host`` and its subdomains, paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        """Over ``host + path``; a host has no slash."""
        return rf"^(?:[^/?#]*\.)?{_quote(self.host)}{_quote(self.path) if self.path else '(?:/|$)'}"

    @property
    def tokens(self) -> list[str]:
        """Only tokens that no longer word can hide: the path's last may be cut short."""
        cut = _tokens(self.path)
        whole = cut if self.path.endswith("/") or not cut else cut[:-1]
        return _tokens(self.host) + whole


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over the lower-cased URL; ``literals`` are whole tokens of every match."""

    name: str
    regex: str
    verdict: str
    literals: tuple[str, ...] = field(default=())

    @property
    def tokens(self) -> list[str]:
        if not self.literals:
            raise ValueError(f"pattern rule {self.name} needs at least one literal token")
        return [t.lower() for t in self.literals]


def _quote(text: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|#&~-])", r"\\\1", text)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _AZ, _AZ.lower())


def url_host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def token_counts(urls: DataFrame, wanted: list[str], url: str = "url") -> dict[str, int]:
    """How many URLs hold each wanted token; at most one row per wanted token comes back."""
    rows = (
        urls.select(F.explode(F.array_intersect(_url_tokens(F.col(url)), F.array(*map(F.lit, wanted)))).alias("token"))
        .groupBy("token")
        .count()
        .collect()
    )
    return {r["token"]: r["count"] for r in rows}


def _url_tokens(url: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.coalesce(ascii_lower(url), F.lit("")), "[^0-9a-z]+")), lambda t: t != "")


def filter_urls(
    urls: DataFrame,
    host_rules: list[HostRule],
    pattern_rules: list[PatternRule] = (),
    *,
    key: str = "page_id",
    url: str = "url",
    default: str = "allow",
    inline_rules: int = INLINE_RULES,
) -> DataFrame:
    """(key, host, path, rule, verdict, pattern) for every row; ``rule`` is a host rule, ``pattern`` the pattern rule that decided."""
    rules = [*host_rules, *pattern_rules]
    base = urls.select(F.col(key).alias(key), F.col(url).alias("_url"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    if not rules:
        return base.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(None).cast("string").alias("pattern"))
    if any(not r.tokens for r in rules):
        raise ValueError("every rule needs a literal token")
    seen = token_counts(urls, sorted({t for r in rules for t in r.tokens}), url)
    keyed: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        keyed.setdefault(min(r.tokens, key=lambda t: (seen.get(t, 0), t)), []).append(i)
    tokens = _url_tokens(F.col("_url"))
    if len(rules) <= inline_rules:
        return _inline(base, tokens, rules, keyed, len(host_rules), key, default)
    return _joined(base, tokens, rules, keyed, len(host_rules), key, default)


def _rank(i: int, rule: HostRule | PatternRule, hosts: int) -> int:
    """Larger wins: host rules by length, then patterns, block first; the earlier of equals."""
    if i < hosts:
        return (1 << 40) + (len(rule.name) << 20) - i
    return ((1 << 30) if rule.verdict == "block" else 0) + (1 << 20) - i


def _outcome(default: str) -> list[Column]:
    on_host = F.col("_best.rank") >= 1 << 40
    return [
        F.when(on_host, F.col("_best.rule")).alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
        F.when(~on_host, F.col("_best.rule")).alias("pattern"),
    ]


def _target(on_host: bool) -> Column:
    return F.concat("host", "path") if on_host else ascii_lower(F.col("_url"))


def _inline(base, tokens, rules, keyed, hosts, key, default) -> DataFrame:
    """One array of fitting rules a row; a regular expression runs only behind its token."""

    def fitting(i):
        rule = rules[i]
        found = F.struct(F.lit(_rank(i, rule, hosts)).alias("rank"), F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        return F.when(_target(i < hosts).rlike(rule.regex), found)

    fetched = [F.when(F.array_contains("_tokens", token), F.array_max(F.array(*map(fitting, found)))) for token, found in keyed.items()]
    return (
        base.withColumn("_tokens", tokens)
        .withColumn("_best", F.array_max(F.array(*fetched)))
        .select(key, "host", "path", *_outcome(default))
    )


def _joined(base, tokens, rules, keyed, hosts, key, default) -> DataFrame:
    """URLs meet candidates by token, once per distinct (host, path, url); rows without a candidate pass by."""
    spark = base.sparkSession
    index = spark.createDataFrame(
        [(t, _rank(i, rules[i], hosts), rules[i].name, rules[i].verdict, rules[i].regex, i < hosts) for t, found in keyed.items() for i in found],
        "token string, rank long, rule string, verdict string, regex string, on_host boolean",
    )
    distinct = base.where(F.col("_url").isNotNull()).select("_url", "host", "path").distinct()
    hits = distinct.withColumn("token", F.explode(tokens)).join(index, "token").where(F.when(F.col("on_host"), F.rlike(_target(True), F.col("regex"))).otherwise(F.rlike(_target(False), F.col("regex"))))
    best = hits.groupBy("_url").agg(F.max(F.struct("rank", "rule", "verdict")).alias("_best"))
    return base.join(best, "_url", "left").select(
        key, "host", "path", *_outcome(default)
    )
