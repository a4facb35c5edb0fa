"""From contexts to repeated windows, in joins and aggregations.

A table of contexts has: k1, k2 (the document's id and a hash of its text), first (its first window), count,
anchor and context (hashes), and whatever else its maker adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["anchor", "context"]


def document_key(doc: str, text: str) -> list[Column]:
    """Two columns that tell documents apart; rows alike in both are exact repeats and share their result."""
    return [F.col(f"`{doc}`").alias("k1"), F.xxhash64(F.col(f"`{text}`")).alias("k2")]


def counted(found: DataFrame, *keep: Column) -> DataFrame:
    """Distinct contexts with their number of rows ``n`` and of distinct contexts per anchor ``kinds``.

    Counting combines before the shuffle, so a passage in a third of all documents is one row a task.
    """
    distinct = found.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), *keep)
    kinds = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("rows")).where("rows > 1").drop("rows")
    return distinct.join(kinds, "anchor")


def repeated_by_hash(shared: DataFrame) -> DataFrame:
    """Places of repeated windows of contexts that share an anchor with other contexts.

    ``shared`` has anchor, context, n, lead (windows before the anchor's place) and hashes (one per window). Returns
    anchor, context and ``runs`` (place, count) of repeated windows, for contexts that stand once and hold some.
    """
    windows = shared.select(*KEY, "n", F.posexplode("hashes").alias("place", "hash"), "lead").withColumn("offset", F.col("lead") - F.col("place"))
    same = ["anchor", "offset", "hash"]
    repeated = windows.groupBy(*same).agg(F.sum("n").alias("rows")).where("rows > 1").select(*same)
    # Estimates do not see how many windows a context has, so the repeated ones are not broadcast.
    return windows.where("n = 1").join(repeated.hint("merge"), same, "left_semi").groupBy(*KEY).agg(F.collect_list(F.struct("place", F.lit(1).alias("count"))).alias("runs"))


def runs_by_document(found: DataFrame, contexts: DataFrame, partial: DataFrame) -> DataFrame:
    """Per document: starts and lengths of its runs of repeated windows."""
    whole = contexts.where("n > 1").select(*KEY, F.lit(None).cast("array<struct<place:int,count:int>>").alias("part"))
    facts = whole.unionByName(partial.select(*KEY, F.col("runs").alias("part")))
    hit = found.select("k1", "k2", *KEY, "first", "count").join(facts, KEY)
    run = lambda start, count: F.struct(start.alias("start"), count.alias("count"))
    starts = F.when(F.col("part").isNull(), F.array(run(F.col("first"), F.col("count")))).otherwise(
        F.transform("part", lambda p: run(F.col("first") + p["place"], p["count"]))
    )
    runs = hit.select("k1", "k2", starts.alias("runs")).groupBy("k1", "k2").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return runs.select("k1", "k2", "runs.start", "runs.count")


def with_runs(docs: DataFrame, doc: str, text: str, runs: DataFrame) -> DataFrame:
    """``docs`` with the columns ``__start`` and ``__count`` of its document's runs; null where it has none."""
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(document_key(doc, text), ("__k1", "__k2"))])
    named = runs.select(F.col("k1").alias("__r1"), F.col("k2").alias("__r2"), F.col("start").alias("__start"), F.col("count").alias("__count"))
    return keyed.join(named, F.col("__k1").eqNullSafe(F.col("__r1")) & (F.col("__k2") == F.col("__r2")), "left").drop("__k1", "__k2", "__r1", "__r2")
