"""Registered query: repeated word windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourwatt.llm.registry import query, table
from hourwatt.llm.substring_dedup import WINDOW, remove_repeated_windows

SQL = f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
p as (select doc_id, words, unnest(generate_series(1, len(words) - {WINDOW - 1})) as i from w where len(words) >= {WINDOW}),
h as (select doc_id, i, md5(array_to_string(words[i:i + {WINDOW - 1}], ' ')) as h from p),
r as (select doc_id, i from h where h in (select h from h group by h having count(*) > 1)),
gone as (select distinct doc_id, unnest(generate_series(i, i + {WINDOW - 1})) as i from r),
each as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i from w),
kept as (select e.doc_id, string_agg(word, ' ' order by e.i) filter (g.i is null) as kept, count(*) as n_words, count(g.i) as n_removed
  from each e left join gone g on e.doc_id = g.doc_id and e.i = g.i group by e.doc_id)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents left join kept using (doc_id)
"""


@query("op8_substring_dedup", SQL)
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
