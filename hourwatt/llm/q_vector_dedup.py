"""Registered query: near-duplicate vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hourwatt.llm.registry import query, table
from hourwatt.llm.vector_dedup import near_duplicates

SQL = """
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where embedding is not null and len(embedding) > 0 and not list_bool_or([x is null or not isfinite(x) for x in embedding]) and list_bool_or([x <> 0 for x in embedding])),
link as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join link l on l.a = r.b),
part as (select a as vec_id, min(b) as component_id from reach group by a)
select e.vec_id, (select count(*) from link where a = e.vec_id) as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join part using (vec_id)
"""


@query("op5_vector_dedup", SQL)
def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
