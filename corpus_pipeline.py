"""From raw documents to packed training sequences, in five stages over all documents.

Each stage takes (spark, docs, sf_dir) and gives back what the next one reads; ``run`` writes every stage's result as
Parquet in the shared folder and reads it again, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourwatt.llm.line_dedup import remove_boilerplate
from hourwatt.llm.ngram_join import ngram_join
from hourwatt.llm.pii import find_spans, redacted
from hourwatt.llm.pu_quality import KEEP, score, train
from hourwatt.llm.q_bpe import vocabulary
from hourwatt.llm.registry import table
from hourwatt.llm.retrieval_packing import ids_crc32, pack
from hourwatt.llm.scratch import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; rows without a text are rejected or kept by the score of none."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, out="__quality").where(F.col("__quality") >= KEEP).drop("__quality")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sources share; their lengths follow."""
    whole = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    cut = remove_boilerplate(whole).withColumn("__changed", F.col("n_removed") > 0)
    rest = [F.col("__row")[c].alias(c) for c in docs.columns if c != "text"]
    return _resized(cut.select("text", "__changed", *rest)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the one with the smallest id, ids that are null last.

    Rows are told apart by a number, so an id on several texts loses only the rows that have a near duplicate, of copies
    without an id and of repeated rows one stays, and rows without a word, which link with nothing, all stay.
    """
    row = next(n for n in (f"__row{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-numbered")
    linked = ngram_join(rows.select(row, "text"), doc=row).where("n_links > 0").select(row, "component_id")
    known = linked.join(rows.select(row, "doc_id"), row).withColumn("__at", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row))
    best = known.groupBy("component_id").agg(F.min("__at")[row].alias("__best"))
    gone = known.join(best, "component_id").where(F.col(row) != F.col("__best")).select(row)
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    found = find_spans(docs, out="__spans")
    hidden = found.withColumn("__changed", F.size("__spans") > 0).withColumn("text", redacted(F.col("text"), F.col("__spans")))
    return _resized(hidden).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return ids_crc32(pack(docs.select("doc_id", "text"), vocabulary("byte_bpe_50k.tiktoken")))


def _resized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.when(F.col("__changed"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop("__changed")


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]
# A learnt classifier has no SQL; the stages are tested one by one in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; rows pass between the JVM and Python a thousand at a time, as texts are long."""
    docs, before = table(spark, sf_dir, "documents"), spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, "1000")
    try:
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return docs
