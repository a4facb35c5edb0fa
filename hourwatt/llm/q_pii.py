"""Registered query: personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourwatt.llm.pii import BASE_KINDS, KINDS, find_spans, span_text
from hourwatt.llm.registry import query, table


def _found(kind: str, pattern: str, good: str) -> str:
    """SQL for the spans of one kind: matches, and the gaps between them for their places."""
    return f"""
    select doc_id, '{kind}' as kind, {KINDS.index(kind)} as ord, s as start, s + length(v) as stop, before, after from (
      select doc_id, m[i] as v, g[i] as before, g[i + 1] as after,
             list_sum([length(x) for x in g[1:i]])::bigint + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0)::bigint as s
      from (select doc_id, m, g, unnest(generate_series(1, len(m))) as i from (
        select doc_id, regexp_extract_all(t, '{pattern}') as m, string_split_regex(t, '{pattern}') as g from d) where len(m) > 0))
    where {good}"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum([case when (length({_DIGITS}) - i) % 2 = 0 then {_DIGITS}[i]::int
  when {_DIGITS}[i]::int > 4 then {_DIGITS}[i]::int * 2 - 9 else {_DIGITS}[i]::int * 2 end for i in generate_series(1, length({_DIGITS}))]) % 10 = 0"""
_MOVED = "replace(v, ' ', '')[5:] || replace(v, ' ', '')[1:4]"
_MOD97 = f"""list_reduce(list_prepend(0, [ascii(({_MOVED})[i]) for i in generate_series(1, length({_MOVED}))]),
  lambda r, c: case when c < 58 then (r * 10 + c - 48) % 97 else (r * 100 + c - 55) % 97 end) = 1"""
# Word edges that this SQL engine's patterns cannot look at are tested on the gaps beside the match.
SQL = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
spans as (
  {_found('email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+', 'true')}
  union all {_found('ip', '[0-9]+(?:[.][0-9]+)(?:[.][0-9]+)(?:[.][0-9]+)', "list_bool_and([length(ltrim(x, '0')) <= 3 and coalesce(try_cast(ltrim(x, '0') as int), 0) <= 255 for x in string_split(v, '.')])")}
  union all {_found('card', '[0-9](?:[ -]?[0-9])+', f"length({_DIGITS}) between 12 and 19 and {_LUHN}")}
  union all {_found('phone', '[+][0-9][ ().0-9-]+[0-9]', f"length({_DIGITS}) between 9 and 15")}
  union all {_found('iban', '[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?', f"not regexp_matches(before, '[A-Za-z0-9]$') and not regexp_matches(after, '^[A-Za-z0-9]') and {_MOD97}")}
  union all {_found('ssn', '[0-9]{3}-[0-9]{2}-[0-9]{4}', "not regexp_matches(before, '[0-9-]$') and not regexp_matches(after, '^[0-9-]') and regexp_matches(right(before, 40) || ' ' || left(after, 40), '(?i)(?:^|[^\\pL])(?:ssn|social|security)')")}
),
per_doc as (
  select doc_id, count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip, count(*) filter (kind = 'card') as n_card,
         count(*) filter (kind = 'phone') as n_phone,
         coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord) filter (ord < {len(BASE_KINDS)}), '') as base,
         string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord) as spans
  from spans group by doc_id)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join per_doc using (doc_id)
"""


def _is_kind(order: int):
    return lambda span: span["order"] == order


@query("op10_pii", SQL)
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("pii_spans", _is_kind(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(BASE_KINDS)]
    base = F.filter("pii_spans", lambda s: s["order"] < len(BASE_KINDS))
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("pii_spans")).alias("spans"))
