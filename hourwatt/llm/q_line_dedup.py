"""Registered query: cross-site boilerplate lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourwatt.llm.line_dedup import MIN_SITES, remove_boilerplate
from hourwatt.llm.registry import query, table

SQL = f"""
with l as (select doc_id, source, pos, line from (
  select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)),
spread as (select line from l where line <> '' group by line having count(distinct coalesce(source, '<null>')) >= {MIN_SITES}),
marked as (select l.doc_id, pos, l.line, spread.line is not null as gone from l left join spread on l.line = spread.line),
per_doc as (select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed,
  coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as kept from marked group by doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join per_doc using (doc_id)
"""


@query("op6_line_dedup", SQL)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return remove_boilerplate(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
