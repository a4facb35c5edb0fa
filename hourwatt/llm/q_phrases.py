"""Registered query: phrase collocations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hourwatt.llm.phrase_mining import collocations
from hourwatt.llm.registry import query, table

LEAST, COVERED, TOP = 30, 80, 2000
SQL = f"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (select lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) as piece from d),
w as (select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') as ws from pieces),
grams as (
  select lang, k, unnest([array_to_string(ws[i:i + k - 1], ' ') for i in generate_series(1, len(ws) - k + 1)]) as phrase
  from w, (values (1), (2), (3), (4)) as sizes(k) where len(ws) >= k),
f as (select lang, phrase, k, count(*) as n from grams group by all),
totals as (select lang, sum(n)::bigint as n from f where k = 1 group by lang),
cand as (select lang, phrase, k as size, n as a, string_split(phrase, ' ') as ws from f where k > 1 and n >= {LEAST}),
cuts as (
  select c.lang, c.phrase, c.a, cut, x.n as l, y.n as r, (2000000::hugeint * c.a) // (x.n::hugeint + y.n) as score
  from (select *, unnest(generate_series(1, size - 1)) as cut from cand) c
  join f x on x.lang = c.lang and x.phrase = array_to_string(c.ws[1:cut], ' ')
  join f y on y.lang = c.lang and y.phrase = array_to_string(c.ws[cut + 1:], ' ')),
lowest as (select *, row_number() over (partition by lang, phrase order by score, cut) as o from cuts),
around as (
  select lang, array_to_string(ws[b:b + s - 1], ' ') as phrase, max(a) as longer
  from (select *, unnest(generate_series(1, size - s + 1)) as b from cand, (values (2), (3)) as inner_sizes(s) where s < size) group by 1, 2),
ranked as (
  select lowest.lang, phrase, a, l, r, score::bigint as score,
         row_number() over (partition by lowest.lang order by score desc, a desc, phrase) as rank
  from lowest left join around using (lang, phrase) where o = 1 and (longer is null or 100::hugeint * longer < {COVERED}::hugeint * a))
select lang, rank, phrase, a, l, r, totals.n as n, score from ranked join totals using (lang) where rank <= {TOP}
"""


@query("op13_phrase_mining", SQL)
def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"), LEAST, COVERED, TOP)
