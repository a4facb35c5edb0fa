from pyspark.sql import functions as F

from hourwatt.operators.ranking import rank_across_ranges


def test_ranks_equal_one_window(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2500, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"), (F.col("id") * 37 % 101).alias("v"), "id")
    got = {r.id: r["rank"] for r in rank_across_ranges(rows, ["g"], [F.desc("v"), F.col("id")]).collect()}
    seen: dict = {}
    for r in sorted(rows.collect(), key=lambda r: (r.g, -r.v, r.id)):
        seen[r.g] = seen.get(r.g, 0) + 1
        assert got[r.id] == seen[r.g]
