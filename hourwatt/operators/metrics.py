"""Forecast error metrics, diagnostics and largest misses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourwatt.functions import numeric as N
from hourwatt.functions.text import regime_label
from hourwatt.operators.calendar import TS, calendar_expressions
from hourwatt.operators.quantiles import exact_quantiles

REGRESSION_METRICS = ("mae", "rmse", "smape", "directional_accuracy")


def with_direction_match(df: DataFrame, actual: str, predicted: str, group: Sequence[str], ts: str = TS) -> DataFrame:
    """1.0 where both sides moved the same way since the previous row, null on the first row.

    A group is one walk-forward test window of one series, a few months of hours.
    """
    order = Window.partitionBy(*group).orderBy(ts)
    moved = F.signum(F.col(actual) - F.lag(actual).over(order)) == F.signum(F.col(predicted) - F.lag(predicted).over(order))
    return df.withColumn("direction_match", F.when(F.lag(F.lit(1)).over(order).isNotNull(), F.coalesce(moved, F.lit(False)).cast("double")))


def regression_metrics(df: DataFrame, actual: str, predicted: str, group: Sequence[str], ts: str = TS) -> DataFrame:
    """MAE, RMSE, sMAPE (0..2) and directional accuracy per group."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    matched = with_direction_match(df, actual, predicted, group, ts)
    return matched.groupBy(*group).agg(
        F.count("*").alias("test_rows"),
        F.avg(N.absolute_error(a, p)).alias("mae"),
        F.sqrt(F.avg(N.squared_error(a, p))).alias("rmse"),
        F.avg(N.smape_term(a, p)).alias("smape"),
        F.avg("direction_match").alias("directional_accuracy"),
    )


def evaluate_forecast(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row of MAE, RMSE and sMAPE over a whole table; zeros when it is empty."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    zero = F.lit(0.0)
    return df.agg(
        F.coalesce(F.avg(N.absolute_error(a, p)), zero).alias("mae"),
        F.coalesce(F.sqrt(F.avg(N.squared_error(a, p))), zero).alias("rmse"),
        F.coalesce(F.avg(N.smape_term(a, p)), zero).alias("smape"),
    )


def mean_over_windows(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Unweighted mean of the per-window metrics."""
    return metrics.groupBy(*by).agg(*[F.avg(m).alias(m) for m in REGRESSION_METRICS])


def add_errors(df: DataFrame, actual: str = "actual_price_eur_mwh", predicted: str = "predicted_price_eur_mwh") -> DataFrame:
    a, p = F.col(actual), F.col(predicted)
    relative = N.smape_term(a, p)
    return df.withColumns(
        {
            "error": N.error(a, p),
            "absolute_error": N.absolute_error(a, p),
            "squared_error": N.squared_error(a, p),
            "symmetric_absolute_percentage_error": relative,
            "smape_pct": F.lit(100.0) * relative,
        }
    )


def add_price_regime(df: DataFrame, value: str = "actual_price_eur_mwh") -> DataFrame:
    """Label each row with its quartile over all rows (all models pooled)."""
    quartiles = exact_quantiles(df, value, [0.25, 0.5, 0.75], name="q")
    # One row of three numbers, read as a scalar subquery.
    marked = df.withColumn("_q", quartiles.scalar())
    q = F.col("_q")
    return marked.withColumn("price_regime", regime_label(F.col(value), q[0], q[1], q[2])).drop("_q")


# Diagnostic group name -> column that holds its buckets.
DIAGNOSTIC_GROUPS = {
    "window": "window",
    "hour": "hour",
    "day_of_week": "day_of_week",
    "month": "month",
    "weekend": "is_weekend",
    "peak_hour": "is_peak_hour",
    "morning_ramp": "is_morning_ramp",
    "evening_peak": "is_evening_peak",
    "price_regime": "price_regime",
}


def error_diagnostics(predictions: DataFrame) -> DataFrame:
    """Error statistics per model for nine groupings, in one pass with grouping sets."""
    calendar = calendar_expressions(F.col(TS))
    buckets = list(DIAGNOSTIC_GROUPS.values())
    frame = add_price_regime(add_errors(predictions)).withColumns({b: calendar[b] for b in buckets if b in calendar})
    frame = frame.select(
        "model", *[F.col(b).cast("string").alias(b) for b in buckets], "error", "absolute_error", "squared_error",
        "symmetric_absolute_percentage_error",
    )
    grouped = frame.groupingSets([["model", b] for b in buckets], "model", *buckets)
    name = F.coalesce(*[F.when(F.grouping(b) == 0, F.lit(g)) for g, b in DIAGNOSTIC_GROUPS.items()])
    return grouped.agg(
        name.alias("diagnostic_group"),
        F.count("*").alias("rows"),
        F.avg("error").alias("mean_error"),
        F.avg("absolute_error").alias("mae"),
        F.sqrt(F.avg("squared_error")).alias("rmse"),
        F.avg("symmetric_absolute_percentage_error").alias("smape"),
        F.max("absolute_error").alias("max_abs_error"),
        F.max("symmetric_absolute_percentage_error").alias("max_smape"),
    )


def top_error_periods(predictions: DataFrame, rows_per_model: int = 25) -> DataFrame:
    """Largest absolute misses of each model; the rank filter is applied before the shuffle as well."""
    calendar = calendar_expressions(F.col(TS))
    wanted = ("hour", "day_of_week", "is_peak_hour", "is_evening_peak")
    frame = add_errors(predictions)
    order = Window.partitionBy("model").orderBy(F.desc("absolute_error"), TS, "window")
    kept = frame.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= rows_per_model)
    return kept.drop("_rank").withColumns({c: calendar[c] for c in wanted})


def flatten_metrics(summary: DataFrame, prefix_columns: Sequence[str] = ("target", "model")) -> DataFrame:
    """Wide summary rows to (metric_name, value), numeric columns only."""
    from hourwatt.functions.text import metric_name

    numeric = [f.name for f in summary.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "boolean")]
    parts = [F.col(c).cast("string") for c in prefix_columns if c in summary.columns]
    present = F.concat_ws(".", *[F.nullif(p, F.lit("")) for p in parts]) if parts else F.lit("")
    prefix = metric_name(F.when(present == "", "summary").otherwise(present))
    entries = [
        F.struct(metric_name(F.lit(c)).alias("metric"), F.col(c).cast("double").alias("value"))
        for c in numeric
        if c not in prefix_columns
    ]
    rows = summary.select(prefix.alias("_prefix"), F.inline(F.array(*entries)))
    return rows.select(F.concat_ws(".", "_prefix", "metric").alias("metric_name"), "value")
