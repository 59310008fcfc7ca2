"""Aggregating scalars over packed cells, and typed parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.normalize import OUTPUT_BLANK, digits, is_blank, text


def longest(values: Column) -> Column:
    """A2: the longest, the first of equals; empty if none."""
    best = F.aggregate(values, F.lit(""), lambda acc, v: F.when(F.length(F.trim(text(v))) > F.length(acc), F.trim(text(v))).otherwise(acc))
    return best


def first_filled(*columns: Column) -> Column:
    """A3: the first that is not blank, else empty."""
    return F.coalesce(*(F.when(~is_blank(c, OUTPUT_BLANK, fold=True), F.trim(text(c))) for c in columns), F.lit(""))


def merged_phones(values: Column) -> Column:
    """A4: spellings joined by comma; a number that ends another seen is left out, first spelling wins."""

    def same(seen, p):
        a, b = digits(seen), digits(p)
        return F.when(F.length(a) >= F.length(b), F.endswith(a, b)).otherwise(F.endswith(b, a))

    none = F.array().cast("array<string>")
    kept = F.aggregate(
        F.filter(values, lambda p: digits(p) != ""), none,
        lambda acc, p: F.when(F.exists(acc, lambda s: same(s, p)), acc).otherwise(F.array_append(acc, p)),
    )
    return F.array_join(kept, ", ")


def distinct_phones(values: Column) -> Column:
    """L-A5: by digits, first spelling wins."""
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        F.filter(values, lambda p: digits(p) != ""), none,
        lambda acc, p: F.when(F.exists(acc, lambda s: digits(s) == digits(p)), acc).otherwise(F.array_append(acc, p)),
    )
    return F.array_join(kept, ";")


def distinct_joined(values: Column, sep: str = ";") -> Column:
    """A6, in sorted order."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(text(v))), lambda v: v != ""))), sep)


def joined(*columns: Column, sep: str = ";") -> Column:
    """L-A23."""
    return F.array_join(F.filter(F.array(*(F.trim(text(c)) for c in columns)), lambda v: v != ""), sep)


def _as_text(number: Column) -> Column:
    return F.coalesce(number.cast("decimal(38,0)").cast("string"), F.lit(""))


def largest_number(c: Column) -> Column:
    """Whole tokens, decimals rounded up, digits of mixed tokens; empty if none."""
    tokens = F.split(F.translate(text(c), ";", " "), " ")

    def value(t):
        plain = F.when(t.rlike(r"^\d+$"), t.try_cast("decimal(38,0)"))
        decimal = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.ceil(t.try_cast("double")).cast("decimal(38,0)"))
        mixed = F.when(~t.rlike(r"^\p{L}*$"), F.nullif(digits(t), F.lit("")).try_cast("decimal(38,0)"))
        return F.coalesce(plain, decimal, mixed)

    return _as_text(F.array_max(F.transform(tokens, value)))


def earliest_year(c: Column) -> Column:
    """Of four-digit tokens from 1000 on."""
    tokens = F.split(F.translate(text(c), ",-/:;", "     "), " ")
    return F.coalesce(F.array_min(F.filter(tokens, lambda t: t.rlike(r"^0*[1-9]\d{3}$"))), F.lit(""))


def parsed_date(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(c, F.lit("M/d/yyyy")))


def earliest_date(c: Column) -> Column:
    """MM/DD/YYYY, tokens that are no date ignored."""
    first = F.array_min(F.transform(F.split(F.translate(text(c), ";", " "), " "), parsed_date))
    return F.coalesce(F.date_format(first, "MM/dd/yyyy"), F.lit(""))


def date_text(c: Column) -> Column:
    """F23 for a timestamp column."""
    return F.coalesce(F.date_format(c, "MM/dd/yyyy"), F.lit(""))


def is_float(c: Column) -> Column:
    """what parses as a float."""
    v = F.lower(F.trim(text(c)))
    return v.rlike(r"^[+-]?(nan|inf|infinity|(\d+(_\d+)*\.?\d*|\.\d+)(e[+-]?\d+)?)$")
