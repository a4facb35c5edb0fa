"""The dashboard document and its filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from hourwatt import constants as C
from hourwatt.functions.numeric import half_even
from hourwatt.functions.text import scenario_title
from hourwatt.operators.calendar import TS
from hourwatt.operators.decision import champion, champion_recommendations
from hourwatt.plans.decision import DecisionOutputs

# Fixed value: the name under which the champion is shown.
DISPLAY_NAME = "Production Model V1"
WHOLE = {"ignoreNullFields": "false"}


def summary_numbers(recommendations: DataFrame) -> DataFrame:
    """Dates, rows, mean confidence and the share of high confidence (4 digits)."""
    return recommendations.agg(
        F.count_distinct("decision_group").alias("date_count"),
        F.count("*").alias("recommendation_count"),
        half_even(F.avg("confidence_score"), 4).alias("average_confidence_score"),
        half_even(F.avg((F.col("confidence_level") == "high").cast("double")), 4).alias("high_confidence_share"),
    )


def filter_values(recommendations: DataFrame, scenario_recommendations: DataFrame) -> DataFrame:
    """Sorted distinct dates and scenarios, one row each."""
    dates = recommendations.select(F.lit("date").alias("filter"), F.col("decision_group").alias("value"))
    scenarios = scenario_recommendations.select(F.lit("scenario").alias("filter"), F.col("scenario").alias("value"))
    return dates.unionByName(scenarios).filter(F.col("value").isNotNull()).distinct()


def champion_scenarios(scenario_recommendations: DataFrame, champion: DataFrame) -> DataFrame:
    """Scenario rows of the champion model."""
    return champion_recommendations(scenario_recommendations, champion)


def _record(rows: DataFrame) -> Column:
    """A row as the document holds it: numbers with 4 digits, NaN as null."""
    fields = []
    for f in rows.schema.fields:
        column = F.col(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)):
            column = F.when(~F.isnan(column), half_even(column, 4))
        fields.append(column.alias(f.name))
    return F.struct(*fields)


def date_documents(recommendations: DataFrame, scenario_rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One JSON document per (keys, window, decision date) with its recommendations and scenario rows.

    Sharded so, a document holds the top rows of one day's candidates per model and scenario; no task or driver ever
    gathers the whole table.
    """
    shard, parts = [*keys, "window", "decision_group"], []
    for kind, rows in (("recommendations", recommendations), ("scenario_recommendations", scenario_rows)):
        entry = F.struct(F.col("recommendation_rank"), F.col(TS), F.col("model"), _record(rows).alias("row"))
        parts.append(rows.groupBy(*shard).agg(F.to_json(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["row"]), WHOLE).alias(kind)))
    return parts[0].join(parts[1], shard, "full_outer")


def _block(rows: DataFrame, *order: str) -> DataFrame:
    """All rows of a summary table as one array of records; such a table has a row per model or scenario and model."""
    entry = F.struct(*[F.col(c) for c in order], _record(rows).alias("record"))
    return rows.agg(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["record"]).alias("block"))


def champion_section(models: DataFrame) -> DataFrame:
    """The champion's name, the weights it was chosen by and every model with its score; no champion without models."""
    weights = F.struct(*[F.lit(weight).alias(name) for name, weight in C.CHAMPION_WEIGHTS.items()])
    named = models.agg(F.min_by("model", "champion_rank").alias("model")).withColumn("models", _block(models, "champion_rank", "model").scalar())
    fields = F.struct("model", F.lit(DISPLAY_NAME).alias("display_model_name"), weights.alias("weights"), "models")
    return named.select(F.lit("champion").alias("section"), F.to_json(fields, WHOLE).alias("document"))


def summary_section(run: DecisionOutputs) -> DataFrame:
    """Counts and confidence of the champion's recommendations, and the three summary tables."""
    numbers = summary_numbers(run.champion_recommendations)
    blocks = {
        "decision_metrics": _block(run.decision_summary, "model"),
        "ranking_metrics": _block(run.ranking_quality, "model"),
        "scenario_metrics": _block(run.scenario_summary, "scenario", "model"),
    }
    numbers = numbers.withColumns({name: block.scalar() for name, block in blocks.items()})
    return numbers.select(F.lit("summary").alias("section"), F.to_json(F.struct(*blocks, *[c for c in numbers.columns if c not in blocks]), WHOLE).alias("document"))


def filter_section(run: DecisionOutputs) -> DataFrame:
    """Sorted dates of the champion's recommendations and sorted scenarios: as many as there are days and scenarios."""
    values = filter_values(run.champion_recommendations, run.scenario_recommendations)
    lists = [F.sort_array(F.collect_list(F.when(F.col("filter") == kind, F.col("value")))).alias(f"{kind}s") for kind in ("date", "scenario")]
    return values.agg(*lists).select(F.lit("filters").alias("section"), F.to_json(F.struct("dates", "scenarios"), WHOLE).alias("document"))


def dashboard_document(run: DecisionOutputs) -> DataFrame:
    """The dashboard's document in parts: champion, summary and filters once, then one part per window and date.

    A part per date holds the champion's recommendations and scenario rows. Numbers have 4 digits, NaN is null. A run
    without recommendations still has its first three parts, with empty lists.
    """
    dates = date_documents(run.champion_recommendations, champion_scenarios(run.scenario_recommendations, champion(run.champion_models)))
    text = F.concat(
        F.lit('{"recommendations":'), F.coalesce("recommendations", F.lit("[]")),
        F.lit(',"scenario_recommendations":'), F.coalesce("scenario_recommendations", F.lit("[]")), F.lit("}"),
    )
    parts = dates.select(F.lit("date").alias("section"), "window", "decision_group", text.alias("document"))
    for section in (filter_section(run), summary_section(run), champion_section(run.champion_models)):
        parts = parts.unionByName(section, allowMissingColumns=True)
    return parts


def recommendations_of_date(recommendations: DataFrame, date: str | None = None) -> DataFrame:
    """Rows of one date in rank order; the last date when none is given."""
    return _of_date(recommendations, date).orderBy("recommendation_rank", "window", "model", TS)


def _of_date(rows: DataFrame, date: str | None) -> DataFrame:
    if date is not None:
        return rows.filter(F.col("decision_group") == date)
    return rows.filter(F.col("decision_group") == rows.agg(F.max("decision_group")).scalar())


def scenario_recommendations_of_date(rows: DataFrame, scenario: str = "clean_first", date: str | None = None) -> DataFrame:
    kept = _of_date(rows, date).filter(F.col("scenario") == scenario)
    return kept.withColumn("scenario_title", scenario_title(F.col("scenario"))).orderBy("recommendation_rank", "window", "model", TS)


def model_scores(models: DataFrame, count: int = 6) -> DataFrame:
    """The best-scored models, for the score chart."""
    return models.select("model", "champion_score").orderBy("champion_score", "model").limit(count)


def carbon_chart(recommendations: DataFrame) -> DataFrame:
    """Start time, predicted intensity and confidence percent."""
    return recommendations.select(
        "window", "model", "decision_group", "recommendation_rank", F.date_format(TS, "HH:mm").alias("hour"),
        F.col("predicted_avg_carbon_intensity_g_co2e_per_kwh").alias("carbon"),
        F.floor(F.coalesce("confidence_score", F.lit(0.0)) * 100 + 0.5).alias("confidence"),
    )
