"""The full decision run: rankings, recommendations, scenarios and the champion."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from hourwatt import constants as C
from hourwatt.operators import decision, workload
from hourwatt.operators.workload import WorkloadConstraints
from hourwatt.session import cut_lineage
from hourwatt.sources.tables import write_csv, write_json


@dataclass(frozen=True)
class DecisionOutputs:
    rankings: DataFrame
    recommendations: DataFrame
    champion_recommendations: DataFrame
    scenario_recommendations: DataFrame
    decision_summary: DataFrame
    ranking_quality: DataFrame
    scenario_summary: DataFrame
    champion_models: DataFrame


def workload_rankings(
    hourly: DataFrame, constraints: WorkloadConstraints | None = None, keys: Sequence[str] = (), filter_on: str = "hours"
) -> DataFrame:
    """Candidate windows of the hourly inputs, ranked and annotated."""
    constraints = constraints or WorkloadConstraints()
    candidates = workload.candidate_windows(hourly, constraints, keys, filter_on)
    return workload.rank_candidates(candidates, constraints, keys)


def decision_run(
    price_rankings: DataFrame, hourly_carbon: DataFrame, price_summary: DataFrame, carbon_summary: DataFrame,
    constraints: WorkloadConstraints | None = None, top_n: int = 5, keys: Sequence[str] = (), scenarios=C.SCENARIOS,
) -> DecisionOutputs:
    """Everything from joined signals to champion recommendations.

    The rankings feed six outputs, so they are checkpointed once instead of being recomputed.
    """
    constraints = constraints or WorkloadConstraints()
    hourly = workload.hourly_decision_inputs(price_rankings, hourly_carbon, constraints.methodology, keys)
    rankings = cut_lineage(workload_rankings(hourly, constraints, keys))
    if rankings.isEmpty():
        raise ValueError("the constraints leave no feasible start hour")
    recommendations = decision.recommendations_with_confidence(rankings, top_n, keys)
    quality = decision.ranking_quality_summary(decision.ranking_quality_by_group(rankings, keys), keys)
    models = decision.champion_table(price_summary, carbon_summary, quality, constraints.methodology, keys)
    scenario_ranks = decision.scenario_rankings(rankings, scenarios, keys)
    return DecisionOutputs(
        rankings=rankings,
        recommendations=recommendations,
        champion_recommendations=decision.champion_recommendations(recommendations, decision.champion(models), keys),
        scenario_recommendations=decision.top_scenario_recommendations(scenario_ranks, top_n, keys),
        decision_summary=workload.decision_summary(rankings, keys),
        ranking_quality=quality,
        scenario_summary=decision.scenario_summary(scenario_ranks, keys),
        champion_models=models,
    )


def write_decision_run(outputs: DecisionOutputs, root: str) -> None:
    """Tables as CSV, summaries as JSON, one folder each."""
    for name in ("rankings", "recommendations", "champion_recommendations", "scenario_recommendations"):
        write_csv(getattr(outputs, name), f"{root}/{name}")
    for name in ("decision_summary", "ranking_quality", "scenario_summary"):
        write_json(getattr(outputs, name), f"{root}/{name}")
    write_json(decision.round_doubles(outputs.champion_models, 6), f"{root}/champion_models")
