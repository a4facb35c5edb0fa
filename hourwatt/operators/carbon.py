"""Emissions and carbon intensity from source-level generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourwatt import constants as C
from hourwatt.functions.numeric import absolute_error, clip, safe_divide, smape_term, squared_error
from hourwatt.operators.calendar import TS

Factors = Mapping[str, Mapping[str, float]]
SIDES = ("actual", "predicted")
FOUND = "_found_sources"
REQUIRED_COLUMNS = {TS, "window", "target", "model", "actual_mwh", "predicted_mwh"}
METRIC_COLUMNS = [
    f"{subject}_{stat}"
    for subject, stats in (
        ("emissions", ("mae_kg_co2e", "rmse_kg_co2e", "bias_kg_co2e", "smape")),
        ("carbon_intensity", ("mae_g_co2e_per_kwh", "rmse_g_co2e_per_kwh", "bias_g_co2e_per_kwh", "smape")),
    )
    for stat in stats
]


def require_columns(df: DataFrame, required: set[str], what: str = "input") -> DataFrame:
    """Fail on the driver, before any job, when a column is missing."""
    missing = sorted(required - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


def missing_targets(predictions: DataFrame, sources: Sequence[str]) -> DataFrame:
    """(window, model, target) for every source a window and model has no rows for."""
    wanted = F.array(*[F.lit(s) for s in sources])
    # The collected set holds at most the listed sources.
    found = predictions.filter(F.col("target").isin(list(sources))).groupBy("window", "model").agg(F.collect_set("target").alias("_found"))
    return found.select("window", "model", F.explode(F.array_except(wanted, "_found")).alias("target"))


def require_targets(predictions: DataFrame, sources: Sequence[str]) -> DataFrame:
    gap = missing_targets(predictions, sources).first()
    if gap is not None:
        raise ValueError(f"no generation values for source {gap.target!r} in {gap.window!r} / {gap.model!r}")
    return predictions


def require_factors(factors: Factors, sources: Sequence[str]) -> None:
    for methodology, by_source in factors.items():
        absent = sorted(set(sources) - set(by_source))
        if absent:
            raise ValueError(f"methodology {methodology!r} is missing factors for {absent}")


def require_found(wide: DataFrame, sources: Sequence[str]) -> DataFrame:
    """``require_targets`` on pivoted rows with ``FOUND``: hourly rows are read, not the predictions."""
    groups = wide.groupBy("window", "model").agg(F.expr(f"bit_or({FOUND})").alias("_bits"))
    absent = F.array_compact(F.array(*[F.when(F.expr(f"_bits & {1 << i}L = 0"), F.lit(s)) for i, s in enumerate(sources)]))
    gap = groups.select("window", "model", F.explode(absent).alias("target")).first()
    if gap is not None:
        raise ValueError(f"no generation values for source {gap.target!r} in {gap.window!r} / {gap.model!r}")
    return wide


def pivot_generation(predictions: DataFrame, sources: Sequence[str], keys: Sequence[str] = (), found: bool = False) -> DataFrame:
    """One row per (keys, hour, window, model): the value per source, both sides at once.

    Where a source has several rows the largest value counts, whatever their order. With ``found`` the column ``FOUND`` has
    a bit for every source, by its place in ``sources``, that has a row, with a value or without.
    """
    aggs = [
        F.expr(
            f"max(case when target = '{s}' then cast({side}_mwh as double) end) as {side}_{s}_generation_mwh"
        )
        for s in sources
        for side in SIDES
    ]
    rows = predictions.filter(F.col("target").isin(list(sources)))
    if found:
        if len(sources) > 62:
            raise ValueError("at most 62 sources fit the bits of one long")
        bits = " ".join(f"when target = '{s}' then {1 << i}L" for i, s in enumerate(sources))
        aggs.append(F.expr(f"bit_or(case {bits} end)").alias(FOUND))
    return rows.groupBy(*keys, TS, "window", "model").agg(*aggs)


def hourly_carbon(
    predictions: DataFrame, factors: Factors, sources: Sequence[str] = C.GENERATION_SOURCES, keys: Sequence[str] = ()
) -> DataFrame:
    """Hourly generation, emissions and intensity per methodology, window and model (wide output).

    One shuffle for the pivot; the methodologies come from a literal array, so they need no join.
    """
    require_columns(predictions, REQUIRED_COLUMNS, "prediction data")
    require_factors(factors, sources)
    return hourly_intensity(pivot_generation(predictions, sources, keys), factors, sources, keys)


def hourly_intensity(wide: DataFrame, factors: Factors, sources: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``hourly_carbon`` from rows that are pivoted already; no shuffle."""
    shared = [*keys, TS, "window", "model"]
    # Generation below zero counts as zero; a missing source stays null.
    clipped = [
        f"case when {side}_{s}_generation_mwh < 0 then 0D else {side}_{s}_generation_mwh end as {side}_{s}_generation_mwh"
        for side in SIDES
        for s in sources
    ]
    rows = ", ".join(
        "named_struct('methodology', '{}', {})".format(m, ", ".join(f"'_factor_{s}', {float(by_source[s])!r}D" for s in sources))
        for m, by_source in factors.items()
    )
    wide = wide.selectExpr(*shared, *clipped, f"inline(array({rows}))")
    wide = wide.selectExpr(
        "*",
        *[f"{side}_{s}_generation_mwh * _factor_{s} as {side}_{s}_emissions_kg_co2e" for side in SIDES for s in sources],
    )

    def total(side: str, measure: str) -> str:
        parts = " + ".join(f"coalesce({side}_{s}_{measure}, 0D)" for s in sources)
        return f"{parts} as {side}_total_{measure}"

    wide = wide.selectExpr("*", *[total(side, m) for side in SIDES for m in ("generation_mwh", "emissions_kg_co2e")])
    wide = wide.selectExpr(
        "*",
        *[
            f"try_divide({side}_total_emissions_kg_co2e, {side}_total_generation_mwh) as {side}_carbon_intensity_g_co2e_per_kwh"
            for side in SIDES
        ],
    )
    measures = [
        *[f"{side}_{m}" for m in ("total_generation_mwh", "total_emissions_kg_co2e", "carbon_intensity_g_co2e_per_kwh") for side in SIDES],
        *[f"{side}_{s}_{m}" for s in sources for m in ("generation_mwh", "emissions_kg_co2e") for side in SIDES],
    ]
    return wide.select(*keys, TS, "methodology", "window", "model", *measures)


def contributions(hourly: DataFrame, sources: Sequence[str] = C.GENERATION_SOURCES, keys: Sequence[str] = ()) -> DataFrame:
    """Long rows per source with its share of the hour's emissions; a row-wise unpivot, no shuffle."""
    entries = []
    for s in sources:
        fields = [f"'source', '{s}'"]
        fields += [f"'{side}_{m}', {side}_{s}_{m}" for m in ("generation_mwh", "emissions_kg_co2e") for side in SIDES]
        fields += [
            f"'{side}_emissions_share', try_divide({side}_{s}_emissions_kg_co2e, {side}_total_emissions_kg_co2e)" for side in SIDES
        ]
        entries.append(f"named_struct({', '.join(fields)})")
    return hourly.selectExpr(*keys, TS, "methodology", "window", "model", f"inline(array({', '.join(entries)}))")


def hourly_intensity_long(generation: DataFrame, factors: DataFrame, keys: Sequence[str] = (), value: str = "mwh", source: str = "target") -> DataFrame:
    """Intensity straight from long generation: join the factor rows (at most a few dozen), then sum."""
    clipped = generation.withColumn("_mwh", clip(F.col(value), lower=0.0))
    priced = clipped.join(F.broadcast(factors), clipped[source] == factors["source"])
    sums = priced.groupBy(*keys, TS, "methodology").agg(
        F.coalesce(F.sum("_mwh"), F.lit(0.0)).alias("generation_mwh"),
        F.coalesce(F.sum(F.col("_mwh") * F.col("factor_kg_co2e_per_mwh")), F.lit(0.0)).alias("emissions_kg_co2e"),
    )
    return sums.withColumn(
        "carbon_intensity_g_co2e_per_kwh", safe_divide(F.col("emissions_kg_co2e"), F.col("generation_mwh"))
    )


def long_shares(priced: DataFrame, group: Sequence[str], emissions: str = "emissions_kg_co2e") -> DataFrame:
    """Share of each row in its hour's emissions; a group is one hour's handful of sources."""
    total = F.sum(emissions).over(Window.partitionBy(*group))
    return priced.withColumn("emissions_share", safe_divide(F.col(emissions), total))


def carbon_metrics(hourly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Error metrics of emissions and intensity per methodology, window and model (nulls skipped)."""
    aggs = [F.count("*").alias("rows")]
    for subject, column, unit in (
        ("emissions", "total_emissions_kg_co2e", "kg_co2e"),
        ("carbon_intensity", "carbon_intensity_g_co2e_per_kwh", "g_co2e_per_kwh"),
    ):
        actual, predicted = F.col(f"actual_{column}"), F.col(f"predicted_{column}")
        aggs += [
            F.avg(absolute_error(actual, predicted)).alias(f"{subject}_mae_{unit}"),
            F.sqrt(F.avg(squared_error(actual, predicted))).alias(f"{subject}_rmse_{unit}"),
            F.avg(predicted - actual).alias(f"{subject}_bias_{unit}"),
            F.avg(smape_term(actual, predicted)).alias(f"{subject}_smape"),
        ]
    return hourly.groupBy(*keys, "methodology", "window", "model").agg(*aggs)


def carbon_summary(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean of the window metrics per methodology and model."""
    return metrics.groupBy(*keys, "methodology", "model").agg(*[F.avg(c).alias(c) for c in METRIC_COLUMNS])
