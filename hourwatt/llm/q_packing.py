"""Registered query: packing by lexical retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hourwatt.llm.q_bpe import vocabulary
from hourwatt.llm.registry import query, table
from hourwatt.llm.retrieval_packing import ids_crc32, pack


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids_crc32(pack(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.tiktoken")))
