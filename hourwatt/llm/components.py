"""Connected components over link tables, by alternating star contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwatt.llm.scratch import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), root being the smallest node it reaches.

    Each round is a few joins and a count; rounds grow with the logarithm of a component's size. No link, node or
    component passes through the driver, and a hub's rows are combined before the shuffle.
    """
    current = stored(edges.where("a != b").select("a", "b").distinct(), "links")
    mark = None
    while True:
        current = stored(_small_star(_large_star(current)), "links")
        seen = current.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b") % (1 << 40)), F.lit(0))).first()
        if seen == mark:
            break
        mark = seen
    leaves = current.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())


def linked_groups(members: DataFrame, distinct: DataFrame, links: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """One row per member: id, n_links, component_id (the smallest id it reaches) and kept.

    ``members`` has id and key (null: links with nothing), ``distinct`` key, copies and least (the key's smallest id),
    ``links`` key and the number of members linked from other keys, ``edges`` the links (a, b) between keys, or enough
    of them to connect what is connected.
    """
    roots = components(edges).withColumnRenamed("node", "key")
    grouped = distinct.select("key", "copies", "least").join(links, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    names = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = grouped.join(names, "root").select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = members.select("id", "key").join(facts, "key", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def spanning_links(n: int, a, b) -> list[tuple[int, int]]:
    """Those of the links (a, b) over n nodes that connect what is connected: at most n - 1."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = find(x), find(y)
        if rx != ry:
            parent[ry] = rx
            out.append((x, y))
    return out
