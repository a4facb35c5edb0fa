"""Carbon accounting from source-level predictions, end to end."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from hourwatt import constants as C
from hourwatt.operators import carbon
from hourwatt.session import cut_lineage


@dataclass(frozen=True)
class CarbonOutputs:
    hourly: DataFrame
    contributions: DataFrame
    metrics: DataFrame
    summary: DataFrame


def carbon_accounting(
    predictions: DataFrame, factors: carbon.Factors, sources: Sequence[str] = C.GENERATION_SOURCES,
    keys: Sequence[str] = (), validate: bool = True,
) -> CarbonOutputs:
    """Hourly intensity, technology contributions, error metrics and their summary.

    The predictions run once: their pivot, one row per hour, window and model, is checkpointed and feeds the four outputs.
    ``validate`` reads it too and fails when a (window, model) has no rows of a source.
    """
    carbon.require_columns(predictions, carbon.REQUIRED_COLUMNS, "prediction data")
    carbon.require_factors(factors, sources)
    wide = cut_lineage(carbon.pivot_generation(predictions, sources, keys, found=True))
    if validate:
        carbon.require_found(wide, sources)
    hourly = carbon.hourly_intensity(wide, factors, sources, keys)
    metrics = carbon.carbon_metrics(hourly, keys)
    return CarbonOutputs(hourly, carbon.contributions(hourly, sources, keys), metrics, carbon.carbon_summary(metrics, keys))
