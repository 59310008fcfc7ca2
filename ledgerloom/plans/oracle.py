"""SQL fragments that state the functions independently of the Spark expressions (DuckDB dialect)."""

from __future__ import annotations

from ledgerloom.functions import normalize as N
from ledgerloom.plans import fixtures as X


def lcs(a: str, b: str) -> str:
    full = f"((1::hugeint << length({a})::hugeint) - 1)"
    masks = (
        f"list_transform(string_split({b}, ''), lambda c: (list_sum(list_transform(range(length({a})), lambda i: "
        f"case when substr({a}, (i + 1)::bigint, 1) = c then 1::hugeint << i::hugeint else 0::hugeint end)))::hugeint)"
    )
    return (
        f"(case when {a} = '' or {b} = '' then 0 else length({a}) - "
        f"bit_count(list_reduce(list_prepend({full}, {masks}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})) end)"
    )


def ratio(a: str, b: str) -> str:
    return f"(case when length({a}) + length({b}) = 0 then 100.0::double else 200.0::double * {lcs(a, b)} / (length({a}) + length({b})) end)"


def ratio_of(common: str, a: str, b: str) -> str:
    return f"(case when length({a}) + length({b}) = 0 then 100.0::double else 200.0::double * {common} / (length({a}) + length({b})) end)"


def tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda t: t <> '')"


def sorted_tokens(c: str) -> str:
    return f"coalesce(array_to_string(list_sort({tokens(c)}), ' '), '')"


def collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def _without(c: str, parts: list[str]) -> str:
    for p in parts:
        c = f"replace({c}, '{p}', '')"
    return c


def match_name(c: str) -> str:
    return collapse(f"regexp_replace(replace({_without(f'lower({c})', N.MATCH_SUFFIXES)}, '&', 'and'), '[^\\w\\s]', ' ', 'g')")


def simple_name(c: str) -> str:
    return collapse(f"regexp_replace({_without(f'lower({c})', N.SIMPLE_SUFFIXES)}, '[^\\w\\s]', '', 'g')")


def dedup_name(c: str) -> str:
    v = f"replace({_without(f'lower({c})', N.DEDUP_SUFFIXES)}, '&', 'and')"
    v = f"regexp_replace(regexp_replace({v}, '\\s+', ' ', 'g'), '[^\\w\\s]', '', 'g')"
    for p in N.DEDUP_PREFIXES:
        v = f"regexp_replace({v}, '^{p}', '')"
    for p in N.DEDUP_ENDINGS:
        v = f"regexp_replace({v}, '{p}$', '')"
    return f"case when {c} = '-' then '' else trim({v}) end"


def match_address(c: str) -> str:
    v = f"lower({c})"
    for full, short in N.MATCH_STREETS.items():
        v = f"regexp_replace({v}, '\\b{full}\\b', '{short}', 'g')"
    return collapse(f"regexp_replace({v}, '[^\\w\\s\\-#]', ' ', 'g')")


def dedup_address(c: str) -> str:
    v = f"trim(upper({c}))"
    for full, short in N.DEDUP_STREETS.items():
        v = f"regexp_replace({v}, '\\b{full}\\b', '{short}', 'g')"
    v = f"trim(regexp_replace({v}, '(?i)(\\s+#\\s*\\S+.*|\\s+#$|\\s+(?:{N.UNIT_WORDS})\\b.*)$', ''))"
    v = f"trim(regexp_replace({v}, '\\s+\\d+(?:-\\d+)?$', ''))"
    v = f"regexp_replace(regexp_replace({v}, '[^\\w\\s-]', ' ', 'g'), '\\b(\\d+)-\\d+\\b', '\\1', 'g')"
    return f"case when {c} = '-' then '' else lower({collapse(v)}) end"


def near_address(c: str) -> str:
    v = f"trim(regexp_replace(upper({c}), '(?i)(\\s+#\\s*\\S+.*|\\s+(?:{N.NEAR_UNIT_WORDS})\\b.*)$', ''))"
    return f"lower({collapse(f"regexp_replace({v}, '[^\\w\\s]', ' ', 'g')")})"


def street_number(c: str) -> str:
    return f"regexp_extract({c}, '^\\s*(\\d+)', 1)"


def street_number_wide(c: str) -> str:
    return f"regexp_extract(trim({c}), '^(\\d+[\\w\\-]?)', 1)"


def street_name(c: str) -> str:
    return f"trim(regexp_replace({dedup_address(c)}, '^\\s*\\d+\\s*', ''))"


BLANK = "('', '-', 'nan')"

#: Both sides in normal form, and their blocked pairs.
SIDES = f"""registry as ({X.REGISTRY}), master as ({X.MASTER}),
a1 as (select registry_index, business_name as a_name, address1 as a_address, {match_name('business_name')} as a_norm,
  {match_address('address1')} as a_street0, {street_number_wide('address1')} as a_num, trim(address1) in {BLANK} as a_blank from registry),
b1 as (select master_index, name as b_name, address1 as b_address, {match_name('name')} as b_norm,
  {match_address('address1')} as b_street0, {street_number_wide('address1')} as b_num, trim(address1) in {BLANK} as b_blank from master),
a as (select *, {sorted_tokens('a_norm')} as a_sorted, {sorted_tokens("regexp_replace(a_street0, '^\\d+[\\w\\-]?\\s*', '')")} as a_street from a1),
b as (select *, {sorted_tokens('b_norm')} as b_sorted, {sorted_tokens("regexp_replace(b_street0, '^\\d+[\\w\\-]?\\s*', '')")} as b_street from b1),
pairs as (select * from a join b on substr(a_norm, 1, 2) = substr(b_norm, 1, 2))"""

#: Scores over distinct strings only.
SCORED = f"""{SIDES},
possible as (select * from pairs where a_num = '' or b_num = '' or a_num = b_num),
names as (select a_norm, b_norm, case when a_norm = '' or b_norm = '' then 0.0::double else greatest({ratio('a_norm', 'b_norm')}, {ratio('a_sorted', 'b_sorted')}) end as name_score,
  a_norm <> '' and b_norm <> '' and (case when length(a_norm) <= length(b_norm) then contains(b_norm, a_norm) else contains(a_norm, b_norm) end) as inside
  from (select distinct a_norm, b_norm, a_sorted, b_sorted from possible)),
streets as (select a_street, b_street, case when a_street = '' or b_street = '' then 0.0::double else {ratio('a_street', 'b_street')} end as address_score
  from (select distinct a_street, b_street from possible)),
scored as (select * from possible join names using (a_norm, b_norm) join streets using (a_street, b_street)),
ruled as (select *, case when a_num <> '' and b_num <> '' and a_num <> b_num then 'DEFINITE_NO_MATCH'
   when name_score < 35 and address_score < 35 and not inside then 'DEFINITE_NO_MATCH'
   when a_blank and b_blank then case when name_score >= 83 or inside then 'CANDIDATE' else 'DEFINITE_NO_MATCH' end
   when a_blank or b_blank then case when name_score >= 60 or inside then 'CANDIDATE' else 'DEFINITE_NO_MATCH' end
   when a_num = '' or b_num = '' then case when name_score >= 55 or inside then 'CANDIDATE' else 'DEFINITE_NO_MATCH' end
   else 'CANDIDATE' end as verdict from scored),
candidates as (select * from ruled where verdict = 'CANDIDATE')"""


def _token_set(a: str, b: str) -> str:
    """Over columns both, da, db, na, nb, lc of a prepared row."""
    return """case when na = 0 or nb = 0 then 0.0::double when both_ <> '' and (da = '' or db = '') then 100.0::double
      when both_ = '' then 100.0::double * (1 - (length(da) + length(db) - 2 * lc)::double / (length(da) + length(db)))
      else greatest(100.0::double * (1 - (length(da) + length(db) - 2 * lc)::double / (2 * length(both_) + 2 + length(da) + length(db))),
        100.0::double * (1 - (1 + length(da))::double / (2 * length(both_) + 1 + length(da))),
        100.0::double * (1 - (1 + length(db))::double / (2 * length(both_) + 1 + length(db)))) end"""


def token_sets(source: str, a: str, b: str) -> str:
    """CTE body: distinct (a, b) of ``source`` with their token set ratio."""
    return f"""select {a}, {b}, {_token_set(a, b)} as set_score from (
  select *, {lcs('da', 'db')} as lc from (
   select {a}, {b}, len(ta) as na, len(tb) as nb,
     coalesce(array_to_string(list_sort(list_filter(ta, lambda x: list_contains(tb, x))), ' '), '') as both_,
     coalesce(array_to_string(list_sort(list_filter(ta, lambda x: not list_contains(tb, x))), ' '), '') as da,
     coalesce(array_to_string(list_sort(list_filter(tb, lambda x: not list_contains(ta, x))), ' '), '') as db
   from (select {a}, {b}, list_distinct({tokens(a)}) as ta, list_distinct({tokens(b)}) as tb from (select distinct {a}, {b} from {source}))))"""


JUDGED = f"""{SCORED},
named as (select *, {simple_name('a_name')} as sa, {simple_name('b_name')} as sb, {sorted_tokens('lower(a_address)')} as la, {sorted_tokens('lower(b_address)')} as lb,
  {street_number('a_address')} as na_, {street_number('b_address')} as nb_ from candidates),
sets as ({token_sets('named', 'sa', 'sb')}),
addresses as (select la, lb, {ratio('la', 'lb')} as addr from (select distinct la, lb from named)),
judged as (select *, case when na_ <> '' and nb_ <> '' and na_ <> nb_ then 'AUTO_REJECT' when set_score < 50 then 'AUTO_REJECT'
   when a_blank and b_blank and set_score >= 90 then 'AUTO_MATCH' when na_ <> '' and na_ = nb_ and set_score >= 88 and addr >= 75 then 'AUTO_MATCH'
   when sa <> '' and sa = sb and (a_blank or b_blank) then 'AUTO_MATCH' end as decision
  from named join sets using (sa, sb) join addresses using (la, lb)),
final as (select *, coalesce(decision, 'NEEDS_REVIEW') as final_decision from judged)"""

#: Dedup forms, accepted links and clusters of the registry.
DEDUP = f"""registry as ({X.REGISTRY}),
p0 as (select registry_index as idx, lower(business_name) as raw, {dedup_name('business_name')} as norm, {dedup_address('address1')} as address, {street_name('address1')} as street0,
  {street_number('address1')} as number, regexp_extract(address1, '(?i)p\\.?\\s*o\\.?\\s*box\\s*#?\\s*(\\d+)', 1) as box,
  case when address1 in ('', '-') then 'blank' when regexp_matches(address1, '(?i)p\\.?\\s*o\\.?\\s*box') then 'box' when {street_number('address1')} <> '' then 'numbered' else 'plain' end as kind from registry),
p as (select *, {sorted_tokens('norm')} as tokens, {sorted_tokens('street0')} as street from p0),
forms as (select raw, norm, tokens, address, street, number, box, kind, min(idx) as idx from p group by all),
fp as (select a.idx as a, b.idx as b, a.kind as ak, b.kind as bk, a.norm as an, b.norm as bn, a.tokens as at_, b.tokens as bt, a.street as as_, b.street as bs,
  a.number as anum, b.number as bnum, a.box as abox, b.box as bbox, a.raw = b.raw as exact
  from forms a join forms b on a.idx < b.idx where not (a.kind = 'numbered' and b.kind = 'numbered' and a.number <> b.number)
   and (a.raw = b.raw or 200 * least(length(a.norm), length(b.norm)) >= 83 * (length(a.norm) + length(b.norm)))),
ns as (select an, bn, at_, bt, greatest({ratio('an', 'bn')}, {ratio('at_', 'bt')}) as s from (select distinct an, bn, at_, bt from fp)),
ss as (select as_, bs, {ratio('as_', 'bs')} as st from (select distinct as_, bs from fp)),
links as (select a, b from fp join ns using (an, bn, at_, bt) join ss using (as_, bs) where
  case when ak = 'blank' or bk = 'blank' then s >= 83 or exact when (ak = 'box') <> (bk = 'box') then s >= 83 or exact
   when ak = 'box' then s >= 83 and (abox = '' or bbox = '' or abox = bbox)
   when ak = 'numbered' and bk = 'numbered' then anum = bnum and s >= 85 and st >= 80
   when ak = 'plain' and bk = 'plain' then s >= 90 and st >= 90 else s >= 85 and st >= 80 end)"""
