"""Registered query: near-duplicate texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hourwatt.llm.ngram_join import ngram_join
from hourwatt.llm.registry import query, table

SQL = """
with recursive w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') as words from documents),
g as (select distinct doc_id, array_to_string(words[i:i + 4], ' ') as gram
  from (select doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) as i from w where len(words) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.gram = b.gram and a.doc_id <> b.doc_id group by all),
link as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 5 * c >= 4 * (x.n + y.n - c)),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join link l on l.a = r.b),
part as (select a as doc_id, min(b) as component_id from reach group by a),
deg as (select a as doc_id, count(*) as n_links from link group by a)
select doc_id, coalesce(n_links, 0) as n_links, component_id, doc_id = component_id as kept from part left join deg using (doc_id)
"""


@query("op9_ngram_join", SQL)
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
