"""Ranks inside decision groups and price rankings.

A decision group is one day of one (window, model): at most 24 candidate hours, because the inputs
hold one row per hour.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourwatt.functions.numeric import safe_divide
from hourwatt.operators.calendar import TS
from hourwatt.operators.quantiles import exact_quantiles
from hourwatt.session import cut_lineage


def first_rank(value: str, group: Sequence[str], *ties: str) -> Column:
    """1..n ascending; equal values keep the order of the tie columns."""
    return F.row_number().over(Window.partitionBy(*group).orderBy(value, *ties))


def normalized_rank(rank: Column, count: Column) -> Column:
    """(rank-1)/(n-1), zero for a single candidate."""
    return F.coalesce(safe_divide((rank - 1).cast("double"), (count - 1).cast("double")), F.lit(0.0))


def average_rank(value: str, group: Sequence[str]) -> Column:
    """Rank with ties sharing their mean position."""
    ties = F.count("*").over(Window.partitionBy(*group, value))
    return F.rank().over(Window.partitionBy(*group).orderBy(value)) + (ties - 1) / F.lit(2.0)


def rank_across_ranges(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1..n inside every group, however large a group is; ``order`` has to be total.

    Rows are dealt to ranges of (group, order), so a group with many rows spans several ranges. A row's rank is its place in
    its range plus the rows of the group in earlier ranges, of which there is one count per range. The dealt rows are
    stored, as both steps have to see the same ranges.
    """
    placed = cut_lineage(df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_range", F.spark_partition_id()))
    in_range = Window.partitionBy(*group, "_range").orderBy(*order)
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*group, "_range").agg(F.count("*").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    ranked = placed.withColumn("_place", F.row_number().over(in_range)).join(offsets.drop("_n"), [*group, "_range"])
    return ranked.withColumn(name, F.col("_place") + F.col("_offset")).drop("_range", "_place", "_offset")


def decision_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def price_decision_rankings(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rank the hours of each day by predicted and by actual price, with regret against the best hour."""
    group = [*keys, "window", "model", "decision_date"]
    by_actual = Window.partitionBy(*group).orderBy("actual_price_eur_mwh", TS)
    whole = by_actual.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = predictions.withColumn("decision_date", decision_date(F.col(TS))).withColumns(
        {
            "predicted_price_rank": first_rank("predicted_price_eur_mwh", group, TS),
            "actual_price_rank": first_rank("actual_price_eur_mwh", group, TS),
            "candidate_count": F.count("*").over(whole),
            "actual_best_price_eur_mwh": F.min("actual_price_eur_mwh").over(whole),
        }
    )
    return ranked.withColumns(
        {
            "regret_vs_best_eur_mwh": F.col("actual_price_eur_mwh") - F.col("actual_best_price_eur_mwh"),
            "is_predicted_best": F.col("predicted_price_rank") == 1,
            "is_actual_best": F.col("actual_price_rank") == 1,
            "is_predicted_top_3": F.col("predicted_price_rank") <= 3,
            "is_actual_top_3": F.col("actual_price_rank") <= 3,
        }
    )


def group_spearman(rankings: DataFrame, group: Sequence[str], left: str, right: str) -> DataFrame:
    """Spearman correlation per group; null where one side is constant."""
    ranked = rankings.select(
        *group, average_rank(left, group).alias("_left"), average_rank(right, group).alias("_right")
    )
    spread = F.stddev_pop("_left") * F.stddev_pop("_right")
    return ranked.groupBy(*group).agg(safe_divide(F.covar_pop("_left", "_right"), spread).alias("spearman"))


def price_ranking_summary(rankings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Hit rates, regret and rank quality per model over all decision days."""
    by_model = [*keys, "model"]
    group = [*by_model, "window", "decision_date"]
    top_1 = F.col("predicted_price_rank") == 1
    regret = F.when(top_1, F.col("regret_vs_best_eur_mwh"))
    base = rankings.groupBy(*by_model).agg(
        F.count_if(top_1).alias("decision_groups"),
        F.avg(F.when(top_1, F.col("is_actual_best").cast("double"))).alias("top_1_hit_rate"),
        F.avg(F.when(F.col("actual_price_rank") == 1, F.col("is_predicted_top_3").cast("double"))).alias("top_3_capture_rate"),
        F.avg(regret).alias("mean_top_1_regret_eur_mwh"),
        F.avg(F.when(top_1, F.col("actual_price_rank"))).alias("mean_actual_rank_of_predicted_best"),
        F.avg(F.when(F.col("predicted_price_rank") <= 3, F.col("actual_price_rank"))).alias("top_3_average_actual_rank"),
    )
    medians = exact_quantiles(rankings.filter(top_1), "regret_vs_best_eur_mwh", [0.5], by_model, "_median").select(
        *by_model, F.col("_median")[0].alias("median_top_1_regret_eur_mwh")
    )
    spearman = (
        group_spearman(rankings, group, "predicted_price_eur_mwh", "actual_price_eur_mwh")
        .groupBy(*by_model)
        .agg(F.avg("spearman").alias("mean_spearman_rank_corr"))
    )
    return base.join(medians, by_model).join(spearman, by_model)
