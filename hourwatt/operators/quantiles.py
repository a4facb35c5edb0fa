"""Exact quantiles without gathering the values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourwatt.session import cut_lineage

# The most values that a target's last range may hold.
FEW = 4096
SPLITS = 255
_ALL = "_all"


def _search(counted: DataFrame, targets: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Counted values that may still hold a target's rank.

    A key has two targets per fraction; they travel as one array, so a value meets them in its own row.
    """
    columns = [c for c in targets.columns if c not in keys]
    packed = targets.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("_targets"))
    few = F.broadcast(packed) if list(keys) == [_ALL] else packed  # without keys: one row
    rows = counted.join(few, keys).select(*keys, value, "_n", F.inline("_targets"))
    return rows.filter(F.col(value).between(F.col("_lo"), F.col("_hi")))


def exact_quantiles(df: DataFrame, value: str, fractions: Sequence[float], keys: Sequence[str] = (), name: str = "quantiles") -> DataFrame:
    """Linearly interpolated quantiles per key as one array column.

    Equal values are counted first and stored. While a target rank's range holds more than ``FEW`` different values, its
    percentile sketch splits it into 256 ranges of about equally many values, which are counted, and the range that
    holds the rank is kept. Splits follow the values, so values of very different size narrow as fast as others; the
    counts are exact whatever the sketch's error. A thousand million different values take three rounds, a few
    thousand none, and no window sees more than ``FEW`` rows. Runs jobs while it is built. No values: null quantiles
    of a key, no row without keys.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    group = list(keys)
    if not group:
        # Always 0, yet no literal: the optimiser would fold one and be left with a join without a key.
        counted, group = counted.withColumn(_ALL, F.pmod(F.hash(value), F.lit(1))), [_ALL]
    counted = cut_lineage(counted)
    bounds = counted.groupBy(*group).agg(F.sum("_n").alias("_total"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_left"))
    entries = ", ".join(f"named_struct('_f', {i}, '_position', {float(q)!r}D * (_total - 1))" for i, q in enumerate(fractions))
    ranks = bounds.selectExpr("*", f"inline(array({entries}))").withColumn("_part", F.col("_position") - F.floor("_position"))
    both = F.explode(F.array(F.floor("_position"), F.ceil("_position"))).alias("_rank")
    target = [*group, "_f", "_part", "_rank"]
    targets = ranks.select(*group, "_f", "_part", "_lo", "_hi", "_left", F.lit(0).cast("bigint").alias("_below"), both).distinct()
    most = bounds.agg(F.max("_left")).first()[0] or 0
    while most > FEW:
        targets = cut_lineage(_narrowed(counted, targets, value, group, target))
        most = targets.agg(F.max("_left")).first()[0]
    found = _at_rank(_search(counted, targets, value, group), target, value)
    ends = found.groupBy(*group, "_f", "_part").agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    result = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")
    columns = [F.max(F.when(F.col("_f") == i, result)) for i in range(len(fractions))]
    return ends.groupBy(*group).agg(F.array(*columns).alias(name)).drop(_ALL)


def _narrowed(counted: DataFrame, targets: DataFrame, value: str, group: Sequence[str], target: Sequence[str]) -> DataFrame:
    """Targets with the part of their range that holds the rank; ranges that are small already stay."""
    wide, small = targets.filter(F.col("_left") > FEW), targets.filter(F.col("_left") <= FEW)
    marks = [(i + 1) / (SPLITS + 1) for i in range(SPLITS)]
    splits = _search(counted, wide, value, group).groupBy(*target).agg(
        F.array_distinct(F.percentile_approx(value, marks, 16 * SPLITS)).alias("_splits")
    )
    split = wide.join(splits, list(target))
    bucket = F.size(F.filter("_splits", lambda v: v < F.col(value)))
    histogram = _search(counted, split, value, group).groupBy(*target, "_below", bucket.alias("_bucket")).agg(
        F.sum("_n").alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_left")
    )
    kept = _at_rank(histogram, target, "_bucket").select(*target, "_lo", "_hi", "_left", F.col("_start").alias("_below"))
    return kept.unionByName(small)


def _at_rank(rows: DataFrame, target: Sequence[str], order: str) -> DataFrame:
    """The row of each target whose cumulative counts span the target's rank."""
    before = Window.partitionBy(*target).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_below") + F.coalesce(F.sum("_n").over(before), F.lit(0))
    placed = rows.withColumn("_start", start)
    return placed.filter((F.col("_start") <= F.col("_rank")) & (F.col("_rank") < F.col("_start") + F.col("_n")))
