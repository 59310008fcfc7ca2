"""Normalisers of names, addresses, phones and columns, as native expressions.

Java's ``\\w`` is ASCII unless ``(?U)`` is given; Unicode is meant throughout.
The order of the steps is part of each function's meaning.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings removed from names, in this order, wherever they stand.
MATCH_SUFFIXES = [" llc", " inc", " corporation", " corp", " company", " co", " ltd", " limited", " pllc", " group", " associates"]
DEDUP_SUFFIXES = [
    " llc", " inc", " corporation", " corp", " company", " co", " ltd", " limited", " pllc", " office", " group", " associates",
    " consulting", " joint venture",
]
SIMPLE_SUFFIXES = [" llc", " inc", " corp", " ltd", " co", " pllc"]
DEDUP_PREFIXES = ["mr ", "mrs ", "ms ", "dr ", "prof ", "miss "]
DEDUP_ENDINGS = [" jr", " sr", " ii", " iii", " iv"]
# Words of addresses and their short forms.
MATCH_STREETS = {
    "street": "st", "avenue": "ave", "boulevard": "blvd", "drive": "dr", "highway": "hwy", "lane": "ln", "parkway": "pkwy",
    "place": "pl", "road": "rd", "suite": "ste", "north": "n", "south": "s", "east": "e", "west": "w",
}
DEDUP_STREETS = {
    "STREET": "ST", "AVENUE": "AVE", "BOULEVARD": "BLVD", "DRIVE": "DR", "ROAD": "RD", "LANE": "LN", "COURT": "CT", "PLACE": "PL",
    "CIRCLE": "CIR", "TERRACE": "TER", "PARKWAY": "PKWY", "HIGHWAY": "HWY", "SQUARE": "SQ", "SUITE": "STE", "NORTH": "N",
    "SOUTH": "S", "EAST": "E", "WEST": "W", "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW",
}
# Words that begin the unit part of an address.
UNIT_WORDS = "STE|SUITE|APT|APARTMENT|UNIT|FL|FLOOR|BLDG|BUILDING|RM|ROOM|LOT|TRLR|TRAILER|PMB|BOX|DEPT|MSC"
NEAR_UNIT_WORDS = "STE|APT|UNIT|FL|BLDG|PMB|SUITE"
#: Blank tokens differ from site to site.
BLANK = ("", "-", "nan")
OUTPUT_BLANK = ("", "-", "nan", "none")
CONTACT_BLANK = ("", "nan", "nat", "none", "-")


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def is_blank(c: Column, tokens: tuple[str, ...] = BLANK, *, fold: bool = False) -> Column:
    v = F.trim(text(c))
    return (F.lower(v) if fold else v).isin(*tokens)


def _without(c: Column, parts: list[str]) -> Column:
    return reduce(lambda acc, p: F.replace(acc, F.lit(p), F.lit("")), parts, c)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def expand_words(c: Column, words: dict[str, str]) -> Column:
    """Each word replaced by its expansion, if it has one."""
    if not words:
        return c
    table = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.coalesce(F.element_at(table, w), w)), " ")


def match_name(c: Column, abbreviations: dict[str, str] | None = None) -> Column:
    """suffixes go as raw substrings, marks become spaces."""
    v = F.replace(_without(F.lower(text(c)), MATCH_SUFFIXES), F.lit("&"), F.lit("and"))
    return F.trim(expand_words(collapse(F.regexp_replace(v, r"(?U)[^\w\s]", " ")), abbreviations or {}))


def dedup_name(c: Column) -> Column:
    """marks are deleted; titles in front and generations behind go one after the other."""
    v = F.replace(_without(F.lower(text(c)), DEDUP_SUFFIXES), F.lit("&"), F.lit("and"))
    v = F.regexp_replace(F.regexp_replace(v, r"(?U)\s+", " "), r"(?U)[^\w\s]", "")
    v = reduce(lambda acc, p: F.regexp_replace(acc, f"^{p}", ""), DEDUP_PREFIXES, v)
    v = reduce(lambda acc, p: F.regexp_replace(acc, f"{p}$", ""), DEDUP_ENDINGS, v)
    return F.when(text(c) == "-", "").otherwise(F.trim(v))


def simple_name(c: Column) -> Column:
    """F3."""
    return collapse(F.regexp_replace(_without(F.lower(text(c)), SIMPLE_SUFFIXES), r"(?U)[^\w\s]", ""))


def match_address(c: Column) -> Column:
    """F4."""
    v = reduce(lambda acc, kv: F.regexp_replace(acc, rf"(?U)\b{kv[0]}\b", kv[1]), MATCH_STREETS.items(), F.lower(text(c)))
    return collapse(F.regexp_replace(v, r"(?U)[^\w\s\-#]", " "))


def dedup_address(c: Column) -> Column:
    """unit part and a trailing bare number go, ranges keep their first number."""
    v = F.trim(F.upper(text(c)))
    v = reduce(lambda acc, kv: F.regexp_replace(acc, rf"(?U)\b{kv[0]}\b", kv[1]), DEDUP_STREETS.items(), v)
    v = F.trim(F.regexp_replace(v, rf"(?U)(?i)(\s+#\s*\S+.*|\s+#$|\s+(?:{UNIT_WORDS})\b.*)$", ""))
    v = F.trim(F.regexp_replace(v, r"(?U)\s+\d+(?:-\d+)?$", ""))
    v = F.regexp_replace(v, r"(?U)[^\w\s-]", " ")
    v = F.regexp_replace(v, r"(?U)\b(\d+)-\d+\b", "$1")
    return F.when(text(c) == "-", "").otherwise(F.lower(collapse(v)))


def near_address(c: Column) -> Column:
    """F6."""
    v = F.trim(F.regexp_replace(F.upper(text(c)), rf"(?U)(?i)(\s+#\s*\S+.*|\s+(?:{NEAR_UNIT_WORDS})\b.*)$", ""))
    return F.lower(collapse(F.regexp_replace(v, r"(?U)[^\w\s]", " ")))


def street_number(c: Column) -> Column:
    """F7, leading digits."""
    return F.regexp_extract(text(c), r"^\s*(\d+)", 1)


def street_number_wide(c: Column) -> Column:
    """F7 of the rule filter: one word character or hyphen may follow."""
    return F.regexp_extract(F.trim(text(c)), r"(?U)^(\d+[\w\-]?)", 1)


def street_name(c: Column) -> Column:
    """F8."""
    return F.trim(F.regexp_replace(dedup_address(c), r"^\s*\d+\s*", ""))


def is_po_box(c: Column) -> Column:
    """F9, anywhere in the address."""
    return text(c).rlike(r"(?i)p\.?\s*o\.?\s*box")


def is_po_box_start(c: Column) -> Column:
    return F.lower(F.trim(text(c))).rlike(r"^p\.?o\.?\s*box")


def po_box_number(c: Column) -> Column:
    return F.regexp_extract(text(c), r"(?i)p\.?\s*o\.?\s*box\s*#?\s*(\d+)", 1)


# Marks that become spaces and marks that go.
LEGACY_SPACES, LEGACY_DROPPED = "{}()[],+/&|_", ".:;-*<>=~$#%!"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def legacy_marks(c: Column) -> Column:
    """L-F10's first half: some marks become spaces, others go; inner spaces stay as they are."""
    return F.trim(F.translate(F.translate(F.lower(text(c)), LEGACY_SPACES, " " * len(LEGACY_SPACES)), LEGACY_DROPPED, ""))


def legacy_text(c: Column, abbreviations: dict[str, str] | None = None) -> Column:
    """L-F10: marks, spaces and abbreviations."""
    return F.trim(expand_words(collapse(legacy_marks(c)), abbreviations or {}))


def legacy_joined(c: Column, abbreviations: dict[str, str] | None = None) -> Column:
    """L-F10 without spaces."""
    return F.replace(legacy_text(c, abbreviations), F.lit(" "), F.lit(""))


def plain_text(c: Column) -> Column:
    """every ASCII mark is a space."""
    return collapse(F.translate(F.lower(text(c)), PUNCTUATION, " " * len(PUNCTUATION)))


def head_and_tail(c: Column, abbreviations: dict[str, str] | None = None) -> tuple[Column, Column]:
    """L-F27: up to the first space, and what follows it."""
    v = legacy_text(c, abbreviations)
    head = F.substring_index(v, " ", 1)
    return head, F.when(F.instr(v, " ") > 0, F.substring(v, F.length(head) + 2, F.length(v))).otherwise("")


def digits(c: Column) -> Column:
    """F12."""
    return F.regexp_replace(text(c), r"\D", "")


def phone(c: Column) -> Column:
    """national digits, or the input where they are too many."""
    d = digits(F.regexp_replace(text(c), r"\.0$", ""))
    d = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 20)).when((F.length(d) == 12) & d.startswith("01"), F.substring(d, 3, 20)).otherwise(d)
    return F.when(F.length(d) <= 10, d).otherwise(text(c))


def cell(c: Column) -> Column:
    """trimmed, blank tokens emptied."""
    v = F.trim(text(c))
    return F.when(F.lower(v).isin(*CONTACT_BLANK), "").otherwise(v)


def full_name(*parts: Column) -> Column:
    """F16."""
    return F.concat_ws(" ", F.filter(F.array(*map(cell, parts)), lambda p: p != ""))


def better_name(a: Column, b: Column) -> Column:
    """more words, else the lexicographically smaller."""
    na, nb = (F.size(F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")) for x in (a, b))
    return F.when(na > nb, a).when(nb > na, b).otherwise(F.least(a, b))


def prompt_field(c: Column) -> Column:
    """F20."""
    v = F.replace(F.left(text(c), F.lit(250)), F.lit("\n"), F.lit(" "))
    return F.when(F.trim(v) == "", "(blank)").otherwise(v)


def id_prefix(name: str, year: int, month: int, day: int) -> str:
    """F19, padded: three letters and the date."""
    return f"{name[:3].upper()}{year:04d}{month:02d}{day:02d}"


def city_date(c: Column) -> Column:
    """``name_D_M_YYYY`` or ``..._D_M_YYYY_x`` (a number before the last three parts) as YYYYMMDD, else null."""
    parts = F.split(text(c), "_")
    part = lambda i: F.try_element_at(parts, F.lit(i))
    padded = lambda v: F.when(F.length(v) < 2, F.lpad(v, 2, "0")).otherwise(v)
    shift = part(-4).rlike(r"^\d+$")
    day, month, year = (F.when(shift, part(i - 1)).otherwise(part(i)) for i in (-3, -2, -1))
    day, month = padded(day), padded(month)
    ok = (F.size(parts) >= 4) & day.rlike(r"^\d\d$") & month.rlike(r"^\d\d$") & year.rlike(r"^\d{4}$")
    return F.when(ok, F.concat(year, month, day))


def email_matches_name(email: Column, name: Column) -> Column:
    """the local part without ``._-`` holds the name without those and spaces, or the other way round."""
    local = F.regexp_replace(F.substring_index(F.lower(F.trim(text(email))), "@", 1), r"[._\-]", "")
    whole = F.regexp_replace(F.lower(F.trim(text(name))), r"(?U)[._\-\s]", "")
    return (text(email) != "") & (text(name) != "") & (F.contains(whole, local) | F.contains(local, whole))


def column_letter(index: int) -> str:
    """0 is A, 26 is AA."""
    out = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def column_index(letters: str) -> int:
    return reduce(lambda n, ch: n * 26 + ord(ch) - 64, letters.upper(), 0) - 1


def base_and_suffix(column: str) -> tuple[str, int | None]:
    """``Phone_2`` is the second of ``Phone``."""
    m = re.match(r"^(.+?)_(\d+)$", column)
    return (m[1], int(m[2])) if m else (column, None)


def literal(value: str) -> str | None:
    """the content of ``[value]``."""
    return value[1:-1] if isinstance(value, str) and len(value) > 1 and value[0] == "[" and value[-1] == "]" else None
