"""Queries: workload ranking, recommendations, scenarios and the champion model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwatt.catalog import adapters as A
from hourwatt.catalog import sql_views
from hourwatt.catalog.registry import query
from hourwatt.catalog.sql_views import G, H, R, T, candidate_sql, ranking_sql
from hourwatt.functions import text
from hourwatt.functions.numeric import half_even
from hourwatt.operators import carbon, decision, metrics, ranking, workload
from hourwatt.operators.calendar import TS
from hourwatt.operators.workload import WorkloadConstraints
from hourwatt.plans import dashboard
from hourwatt.plans.decision import decision_run, workload_rankings
from hourwatt.session import cut_lineage

DAY = WorkloadConstraints(earliest_start_utc="2024-01-16 08:00:00", latest_end_utc="2024-01-16 22:00:00", duration_hours=3)
DELAY = WorkloadConstraints(earliest_start_utc="2024-01-16 20:00:00", duration_hours=2, max_delay_hours=9)


def hourly(s, d):
    prices = ranking.price_decision_rankings(A.price_pred(s, d))
    intensity = carbon.hourly_carbon(A.pred_long(s, d), A.factors(), A.TECH_SOURCES)
    return workload.hourly_decision_inputs(prices, intensity)


def rankings(s, d):
    return workload_rankings(hourly(s, d))


KEYS = f"""{T('ts')} as timestamp_utc, "window", model"""

_inputs = {
    "actual_price": "actual_price_eur_mwh", "predicted_price": "predicted_price_eur_mwh", "actual_ci": "actual_carbon_intensity_g_co2e_per_kwh",
    "predicted_ci": "predicted_carbon_intensity_g_co2e_per_kwh", "actual_em": "actual_total_emissions_kg_co2e",
    "predicted_em": "predicted_total_emissions_kg_co2e",
}
_inputs_sql = ", ".join(f"{R(k)} as {v}" for k, v in _inputs.items())


@query("J04_price_carbon_join", f"select {KEYS}, decision_date, {_inputs_sql} from v_hourly")
def j04(s, d):
    return hourly(s, d).drop("previous_day_price_eur_mwh")


@query("W07_previous_day_price", f"select {KEYS}, {R('prev')} as previous_day_price_eur_mwh from v_hourly")
def w07(s, d):
    return hourly(s, d).select(TS, "window", "model", "previous_day_price_eur_mwh")


_candidate = {
    "a_price": "actual_avg_price_eur_mwh", "p_price": "predicted_avg_price_eur_mwh", "prev_price": "previous_day_avg_price_eur_mwh",
    "a_carbon": "actual_avg_carbon_intensity_g_co2e_per_kwh", "p_carbon": "predicted_avg_carbon_intensity_g_co2e_per_kwh",
    "a_em": "actual_total_emissions_kg_co2e", "p_em": "predicted_total_emissions_kg_co2e",
}
_candidate_sql = (
    f"{KEYS}, {T('end_ts')} as workload_end_utc, decision_date, decision_group, duration_hours, "
    + ", ".join(f"{R(k)} as {v}" for k, v in _candidate.items())
)


@query("W13_candidate_windows", f"select {_candidate_sql} from v_candidates3")
def w13(s, d):
    return workload.candidate_windows(hourly(s, d), WorkloadConstraints(duration_hours=3))


@query("W13b_constrained_windows", f"select {_candidate_sql} from ({candidate_sql('v_hourly', 3, True)}) c where ts >= timestamp '2024-01-16 08:00:00' and ts + interval 2 hours <= timestamp '2024-01-16 19:00:00'")
def w13b(s, d):
    return workload.candidate_windows(hourly(s, d), DAY)


@query("P08_feasible_hours", f"""select 'day' as workload, {KEYS} from v_hourly where ts between timestamp '2024-01-16 08:00:00' and timestamp '2024-01-16 19:00:00'
union all select 'delay', {T('ts')}, "window", model from v_hourly where ts between timestamp '2024-01-16 20:00:00' and timestamp '2024-01-17 05:00:00'""")
def p08(s, d):
    rows = hourly(s, d).select(TS, "window", "model")
    return workload.feasible_hours(rows, DAY).withColumn("workload", F.lit("day")).unionByName(
        workload.feasible_hours(rows, DELAY).withColumn("workload", F.lit("delay"))
    )


@query("P08b_feasible_starts", f"select {_candidate_sql} from ({candidate_sql('v_hourly', 3, True)}) c where ts between timestamp '2024-01-16 08:00:00' and timestamp '2024-01-16 19:00:00'")
def p08b(s, d):
    return workload.candidate_windows(hourly(s, d), DAY, filter_on="start")


_ranks = [f"{n}_rank" for n in ("predicted_price", "predicted_carbon", "actual_price", "actual_carbon", "predicted_decision", "actual_decision")]


@query("W08_first_rank", f"select {KEYS}, {', '.join(_ranks)} from v_rankings")
def w08(s, d):
    return rankings(s, d).select(TS, "window", "model", *_ranks)


@query("W09_normalized_rank", f"select {KEYS}, " + ", ".join(f"{R(f'{n}_rank_pct')} as {n}_rank_pct" for n in ("predicted_price", "predicted_carbon", "actual_price", "actual_carbon")) + " from v_rankings")
def w09(s, d):
    return rankings(s, d).select(TS, "window", "model", *[f"{n}_rank_pct" for n in workload.RANKED])


@query("W10_group_values", f"select {KEYS}, candidate_count, {R('best_score')} as actual_best_combined_score, {R('best_price')} as actual_best_price_eur_mwh, {R('best_carbon')} as actual_best_carbon_intensity_g_co2e_per_kwh from v_rankings")
def w10(s, d):
    return rankings(s, d).select(
        TS, "window", "model", "candidate_count", "actual_best_combined_score", "actual_best_price_eur_mwh", "actual_best_carbon_intensity_g_co2e_per_kwh"
    )


_regret = {
    "combined_regret": "combined_regret", "cost_regret": "cost_regret_eur_mwh", "carbon_regret": "carbon_regret_g_co2e_per_kwh",
    "cost_savings": "cost_savings_vs_run_now_eur_mwh", "carbon_savings": "carbon_savings_vs_run_now_g_co2e_per_kwh",
}
_flags = """predicted_decision_rank = 1 as is_predicted_best, actual_decision_rank = 1 as is_actual_best, predicted_decision_rank <= 3 as is_predicted_top_3,
  actual_decision_rank <= 3 as is_actual_top_3"""
_regret_sql = ", ".join(f"{R(k)} as {v}" for k, v in _regret.items())


@query("W11_regret_savings", f"select {KEYS}, {_regret_sql}, {_flags} from v_rankings")
def w11(s, d):
    return rankings(s, d).select(
        TS, "window", "model", *_regret.values(), "is_predicted_best", "is_actual_best", "is_predicted_top_3", "is_actual_top_3"
    )


@query("J08_run_now_baseline", f"select {KEYS}, {R('now_price')} as run_now_price_eur_mwh, {R('now_carbon')} as run_now_carbon_intensity_g_co2e_per_kwh from v_rankings")
def j08(s, d):
    return rankings(s, d).select(TS, "window", "model", "run_now_price_eur_mwh", "run_now_carbon_intensity_g_co2e_per_kwh")


@query("K05_earliest_candidate", f"""select "window", model, decision_group, {T('min(ts)')} as first_start, {R('arg_min(a_price, ts)')} as first_price from v_candidates group by 1, 2, 3""")
def k05(s, d):
    c = workload.candidate_windows(hourly(s, d), WorkloadConstraints())
    return c.groupBy("window", "model", "decision_group").agg(F.min(TS).alias("first_start"), F.min_by("actual_avg_price_eur_mwh", TS).alias("first_price"))


@query("F03_direction_labels", f"select {KEYS}, p_dir as predicted_price_direction_vs_previous_day, a_dir as actual_price_direction_vs_previous_day, {R('p_price - prev_price')} as predicted_price_change_vs_previous_day_eur_mwh, {R('a_price - prev_price')} as actual_price_change_vs_previous_day_eur_mwh from v_rankings")
def f03(s, d):
    return rankings(s, d).select(
        TS, "window", "model", *[f"{side}_price_direction_vs_previous_day" for side in ("predicted", "actual")],
        *[f"{side}_price_change_vs_previous_day_eur_mwh" for side in ("predicted", "actual")],
    )


@query("F04_direction_correct", f"select {KEYS}, dir_ok::double as price_direction_correct from v_rankings")
def f04(s, d):
    return rankings(s, d).select(TS, "window", "model", "price_direction_correct")


@query("F06_combined_score", f"select {KEYS}, {R('predicted_combined_score')} as predicted_combined_score, {R('actual_combined_score')} as actual_combined_score from ({ranking_sql('v_candidates', 0.3, 0.9)}) r")
def f06(s, d):
    return workload_rankings(hourly(s, d), WorkloadConstraints(price_weight=0.3, carbon_weight=0.9)).select(
        TS, "window", "model", "predicted_combined_score", "actual_combined_score"
    )


_ranking_sql = f"""{_candidate_sql}, {', '.join(_ranks)}, candidate_count, {R('predicted_combined_score')} as predicted_combined_score,
  {R('actual_combined_score')} as actual_combined_score, {_regret_sql}, {_flags}, p_dir as predicted_price_direction_vs_previous_day, dir_ok::double as price_direction_correct"""
_ranking_columns = [
    TS, "window", "model", "workload_end_utc", "decision_date", "decision_group", "duration_hours", *_candidate.values(), *_ranks, "candidate_count",
    "predicted_combined_score", "actual_combined_score", *_regret.values(), "is_predicted_best", "is_actual_best", "is_predicted_top_3", "is_actual_top_3",
    "predicted_price_direction_vs_previous_day", "price_direction_correct",
]


@query("C03_workload_ranking", f"select {_ranking_sql} from v_rankings")
def c03(s, d):
    return rankings(s, d).select(*_ranking_columns)


@query("C03b_workload_ranking_3h", f"select {_ranking_sql} from ({ranking_sql('v_candidates3')}) r")
def c03b(s, d):
    return workload_rankings(hourly(s, d), WorkloadConstraints(duration_hours=3)).select(*_ranking_columns)


_cons = f"(select * from ({candidate_sql('v_hourly', 2, True)}) c where ts between timestamp '2024-01-16 20:00:00' and timestamp '2024-01-17 04:00:00')"


@query("C03c_constrained_ranking", f"select {_ranking_sql} from ({ranking_sql(_cons)}) r")
def c03c(s, d):
    return workload_rankings(hourly(s, d), DELAY).select(*_ranking_columns)


@query("K06_ordered_rankings", f"""select "window", model, decision_group, predicted_decision_rank, {T('ts')} as timestamp_utc from v_rankings order by 1, 2, 3, 4, 5""")
def k06(s, d):
    rows = rankings(s, d).select("window", "model", "decision_group", "predicted_decision_rank", TS)
    return rows.orderBy("window", "model", "decision_group", "predicted_decision_rank", TS)


_decision_summary = """select model, count(*) filter (where predicted_decision_rank = 1) as decision_groups, {0} as top_1_hit_rate, {1} as top_3_capture_rate, {2} as mean_combined_regret,
  {3} as mean_cost_regret_eur_mwh, {4} as mean_carbon_regret_g_co2e_per_kwh, {5} as mean_cost_savings_vs_run_now_eur_mwh, {6} as mean_carbon_savings_vs_run_now_g_co2e_per_kwh,
  {7} as mean_actual_rank_of_recommendation from v_rankings group by 1"""


def _best(expr, cond="predicted_decision_rank = 1"):
    return R(f"avg({expr}) filter (where {cond})")


@query("G19_decision_summary", _decision_summary.format(
    _best("(actual_decision_rank = 1)::int"), _best("(predicted_decision_rank <= 3)::int", "actual_decision_rank = 1"), _best("combined_regret"),
    _best("cost_regret"), _best("carbon_regret"), _best("cost_savings"), _best("carbon_savings"), _best("actual_decision_rank")))
def g19(s, d):
    return workload.decision_summary(rankings(s, d))


_rec = {
    "predicted_combined_score": "predicted_combined_score", "p_carbon": "predicted_avg_carbon_intensity_g_co2e_per_kwh", "p_em": "predicted_total_emissions_kg_co2e", **_regret,
}
_rec_sql = f"""{KEYS}, decision_group, predicted_decision_rank as recommendation_rank, {T('end_ts')} as workload_end_utc, duration_hours,
  p_dir as predicted_price_direction_vs_previous_day, predicted_price_rank, predicted_carbon_rank, candidate_count, actual_decision_rank, """ + ", ".join(
    f"{R(H(k))} as {v}" for k, v in _rec.items()
)


@query("K02_top_recommendations", f"select {_rec_sql} from v_rankings where predicted_decision_rank <= 5")
def k02(s, d):
    return decision.top_recommendations(rankings(s, d))


@query("P12_rounded_output", f"""select {KEYS}, {R(H('p_carbon'))} as two_digits, {R(H('p_carbon', 4))} as four_digits, {R(H('p_carbon', 6))} as six_digits from v_rankings""")
def p12(s, d):
    value = F.col("predicted_avg_carbon_intensity_g_co2e_per_kwh")
    return rankings(s, d).select(
        TS, "window", "model", half_even(value, 2).alias("two_digits"), half_even(value, 4).alias("four_digits"), half_even(value, 6).alias("six_digits")
    )


@query("G23_agreement_counts", f"""select "window", decision_group, {T('ts')} as timestamp_utc, agreement_count, model_count from v_agreement join v_model_counts using ("window", decision_group)""")
def g23(s, d):
    ranked = rankings(s, d)
    agreement = decision.agreement_counts(decision.top_recommendations(ranked))
    return agreement.join(decision.model_counts(ranked), ["window", "decision_group"])


@query("W12_score_margin", f"select {KEYS}, {R('margin')} as score_margin_component from v_margin")
def w12(s, d):
    return decision.score_margins(rankings(s, d)).select(TS, "window", "model", "score_margin_component")


@query("J09_confidence_inputs", f"select {KEYS}, decision_group, agreement_count, model_count, {R('margin')} as score_margin_component from v_rec")
def j09(s, d):
    ranked = rankings(s, d)
    joined = decision.attach_confidence_inputs(decision.top_recommendations(ranked), ranked)
    return joined.select(TS, "window", "model", "decision_group", "agreement_count", "model_count", "score_margin_component")


_conf = f"""{R(H('agreement_rate'))} as model_agreement_rate, {R(H('rank_part'))} as rank_confidence_component, {R(H('margin'))} as score_margin_component,
  {R(H('confidence'))} as confidence_score, case when confidence >= 0.75 then 'high' when confidence >= 0.5 then 'medium' else 'low' end as confidence_level"""


@query("F05_confidence_score", f"select {KEYS}, {_conf} from v_rec")
def f05(s, d):
    out = decision.recommendations_with_confidence(rankings(s, d))
    return out.select(
        TS, "window", "model", "model_agreement_rate", "rank_confidence_component", "score_margin_component", "confidence_score", "confidence_level"
    )


@query("C04_recommendations", f"select {_rec_sql}, agreement_count, model_count, {_conf} from v_rec")
def c04(s, d):
    return decision.recommendations_with_confidence(rankings(s, d))


_scenario_rows = f"""scenario, {R('pw')} as scenario_price_weight, {R('cw')} as scenario_carbon_weight, {KEYS}, decision_group"""


@query("J11_scenario_rows", f"select {_scenario_rows}, {R('p_score')} as predicted_scenario_score, {R('a_score')} as actual_scenario_score, p_rank as predicted_scenario_rank, a_rank as actual_scenario_rank, {R('regret')} as scenario_regret from v_scenario")
def j11(s, d):
    return decision.scenario_rankings(rankings(s, d)).select(
        "scenario", "scenario_price_weight", "scenario_carbon_weight", TS, "window", "model", "decision_group", "predicted_scenario_score",
        "actual_scenario_score", "predicted_scenario_rank", "actual_scenario_rank", "scenario_regret",
    )


_scenario_rec = f"""select scenario, {R(H('pw'))} as scenario_price_weight, {R(H('cw'))} as scenario_carbon_weight, {KEYS}, decision_group, p_rank as recommendation_rank,
  {T('end_ts')} as workload_end_utc, duration_hours, p_dir as predicted_price_direction_vs_previous_day, predicted_carbon_rank, a_rank as actual_scenario_rank,
  {R(H('p_score'))} as predicted_scenario_score, {R(H('p_carbon'))} as predicted_avg_carbon_intensity_g_co2e_per_kwh, {R(H('p_em'))} as predicted_total_emissions_kg_co2e,
  {R(H('regret'))} as scenario_regret, {R(H('carbon_regret'))} as carbon_regret_g_co2e_per_kwh, {R(H('carbon_savings'))} as carbon_savings_vs_run_now_g_co2e_per_kwh
  from v_scenario where p_rank <= 5"""


@query("K03_top_scenario_rows", _scenario_rec)
def k03(s, d):
    return decision.top_scenario_recommendations(decision.scenario_rankings(rankings(s, d)))


def _first(expr, cond="p_rank = 1"):
    return R(f"avg({expr}) filter (where {cond})")


_scenario_summary = f"""select scenario, model, count(*) filter (where p_rank = 1) as decision_groups, {_first('(a_rank = 1)::int')} as top_1_hit_rate,
  {_first('(p_rank <= 3)::int', 'a_rank = 1')} as top_3_capture_rate, {_first('regret')} as mean_scenario_regret, {_first('carbon_regret')} as mean_carbon_regret_g_co2e_per_kwh,
  {_first('carbon_savings')} as mean_carbon_savings_vs_run_now_g_co2e_per_kwh from v_scenario group by 1, 2"""


@query("G20_scenario_summary", _scenario_summary)
def g20(s, d):
    return decision.scenario_summary(decision.scenario_rankings(rankings(s, d)))


@query("C05_scenario_reranking", _scenario_summary + " order by scenario, mean_scenario_regret")
def c05(s, d):
    return decision.scenario_summary(decision.scenario_rankings(rankings(s, d))).orderBy("scenario", "mean_scenario_regret")


@query("F13_scenario_titles", "select distinct scenario, case scenario when 'clean_first' then 'Clean First' when 'balanced' then 'Balanced' else 'Cost Aware Clean' end as scenario_title from v_scenario")
def f13(s, d):
    return decision.scenario_rankings(rankings(s, d)).select("scenario", text.scenario_title(F.col("scenario")).alias("scenario_title")).distinct()


@query("G14_pairwise_loss", f"""select {G}, {R('coalesce(loss, 0)')} as pairwise_ranking_loss from v_quality""")
def g14(s, d):
    return decision.pairwise_ranking_loss(rankings(s, d), decision.GROUP, "predicted_combined_score", "actual_combined_score")


@query("J13_pairwise_order", f"""select "window", model, {R('avg(loss)')} as mean_pairwise_loss, count(*) as decision_groups from v_quality group by 1, 2""")
def j13(s, d):
    loss = decision.pairwise_ranking_loss(rankings(s, d), decision.GROUP, "predicted_combined_score", "actual_combined_score")
    return loss.groupBy("window", "model").agg(F.avg("pairwise_ranking_loss").alias("mean_pairwise_loss"), F.count("*").alias("decision_groups"))


_class = f"{R('prec')} as top_5_precision, {R('rec')} as top_5_recall, {R('f1')} as top_5_f1"


@query("G15_top_k_classification", f"select {G}, {_class} from v_quality")
def g15(s, d):
    return decision.top_k_classification(rankings(s, d), decision.GROUP)


@query("G16_ranking_quality", f"""select {G}, {R('loss')} as pairwise_ranking_loss, {_class}, {R('acc')} as price_direction_accuracy, {R('r1')} as top_1_combined_regret,
  {R('r2')} as top_1_carbon_regret_g_co2e_per_kwh, {R('r3')} as top_1_cost_regret_eur_mwh from v_quality""")
def g16(s, d):
    return decision.ranking_quality_by_group(rankings(s, d))


def _quality(s, d):
    return decision.ranking_quality_summary(decision.ranking_quality_by_group(rankings(s, d)))


@query("G16b_ranking_quality_summary", f"""select model, n as decision_groups, {R('loss')} as pairwise_ranking_loss, {_class}, {R('acc')} as price_direction_accuracy,
  {R('err')} as price_direction_error, {R('r1')} as mean_top_1_combined_regret, {R('r2')} as mean_top_1_carbon_regret_g_co2e_per_kwh, {R('r3')} as mean_top_1_cost_regret_eur_mwh from v_quality_summary""")
def g16b(s, d):
    return _quality(s, d)


def summaries(s, d):
    price = metrics.mean_over_windows(
        metrics.regression_metrics(A.price_pred(s, d), "actual_price_eur_mwh", "predicted_price_eur_mwh", ["window", "model"]), ["model"]
    )
    hourly_carbon = carbon.hourly_carbon(A.pred_long(s, d), A.factors(), A.TECH_SOURCES)
    return price, carbon.carbon_summary(carbon.carbon_metrics(hourly_carbon))


def models(s, d):
    return decision.champion_table(*summaries(s, d), _quality(s, d))


@query("J10_model_metrics", f"""select model, {R('err')} as price_direction_error, {R('ci_mae')} as carbon_intensity_mae_g_co2e_per_kwh, {R('r2')} as carbon_regret_g_co2e_per_kwh,
  {R('rl')} as top_5_ranking_loss, {R('mae')} as price_mae_eur_mwh_reference_only from v_champion""")
def j10(s, d):
    return models(s, d).select(
        "model", "price_direction_error", "carbon_intensity_mae_g_co2e_per_kwh", "carbon_regret_g_co2e_per_kwh", "top_5_ranking_loss", "price_mae_eur_mwh_reference_only"
    )


@query("G25_champion_models", f"""select model, {R('ce')} as carbon_error_component, {R('cr')} as carbon_regret_component, {R('rk')} as ranking_component,
  {R('pd')} as price_direction_error_component, {R('score')} as champion_score, row_number() over (order by score, ce, model) as champion_rank from v_champion""")
def g25(s, d):
    return models(s, d).select(
        "model", "carbon_error_component", "carbon_regret_component", "ranking_component", "price_direction_error_component", "champion_score", "champion_rank"
    )


@query("K07_model_scores", f"select model, {R('score')} as champion_score from v_champion order by score, model limit 6")
def k07(s, d):
    return dashboard.model_scores(models(s, d))


_champion = "(select model from v_champion order by score, ce, model limit 1)"


@query("C06_champion_recommendations", f"select {_rec_sql}, agreement_count, model_count, {_conf} from v_rec where model = {_champion}")
def c06(s, d):
    run = decision_run(
        ranking.price_decision_rankings(A.price_pred(s, d)), carbon.hourly_carbon(A.pred_long(s, d), A.factors(), A.TECH_SOURCES), *summaries(s, d)
    )
    return run.champion_recommendations


@query("P09_champion_filter", f"select {KEYS}, decision_group, predicted_decision_rank as recommendation_rank from v_rec where model = {_champion}")
def p09(s, d):
    ranked = rankings(s, d)
    kept = decision.champion_recommendations(decision.top_recommendations(ranked), decision.champion(models(s, d)))
    return kept.select(TS, "window", "model", "decision_group", "recommendation_rank")


def _run(s, d):
    return decision_run(
        ranking.price_decision_rankings(A.price_pred(s, d)), carbon.hourly_carbon(A.pred_long(s, d), A.factors(), A.TECH_SOURCES), *summaries(s, d)
    )


@query("C07_decision_run", f"""select 'rankings' as output, count(*) as row_count from v_rankings union all select 'recommendations', count(*) from v_rec
union all select 'champion_recommendations', count(*) from v_rec where model = {_champion} union all select 'scenario_recommendations', count(*) from v_scenario where p_rank <= 5
union all select 'decision_summary', count(distinct model) from v_rankings union all select 'ranking_quality', count(distinct model) from v_rankings
union all select 'scenario_summary', count(distinct (scenario, model)) from v_scenario union all select 'champion_models', count(*) from v_champion""")
def c07(s, d):
    from dataclasses import fields

    from hourwatt.sources.tables import load_summary

    run = _run(s, d)
    return load_summary({f.name: getattr(run, f.name) for f in fields(run)}).withColumnRenamed("table_name", "output")


# Per output of the run: its SQL, the columns that name a row and the values compared.
_AT = ["window", "model", "decision_group", TS]
_recommended = ["recommendation_rank", *_rec.values(), "confidence_score", "model_agreement_rate"]
_contents = {
    "rankings": (f"select {KEYS}, decision_group, {', '.join(_ranks)}, {_regret_sql} from v_rankings", _AT, [*_ranks, *_regret.values()]),
    "recommendations": (f"select {_rec_sql}, {_conf} from v_rec", _AT, _recommended),
    "champion_recommendations": (f"select {_rec_sql}, {_conf} from v_rec where model = {_champion}", _AT, _recommended),
    "scenario_recommendations": (
        _scenario_rec, ["scenario", *_AT], ["recommendation_rank", "actual_scenario_rank", "predicted_scenario_score", "scenario_regret"],
    ),
    "decision_summary": (
        f"""select model, count(*) filter (where predicted_decision_rank = 1) as decision_groups, {_best("combined_regret")} as mean_combined_regret,
  {_best("cost_savings")} as mean_cost_savings_vs_run_now_eur_mwh, {_best("actual_decision_rank")} as mean_actual_rank_of_recommendation from v_rankings group by 1""",
        ["model"], ["decision_groups", "mean_combined_regret", "mean_cost_savings_vs_run_now_eur_mwh", "mean_actual_rank_of_recommendation"],
    ),
    "ranking_quality": (
        f"select model, n as decision_groups, {R('loss')} as pairwise_ranking_loss, {_class}, {R('err')} as price_direction_error from v_quality_summary",
        ["model"], ["decision_groups", "pairwise_ranking_loss", "top_5_precision", "top_5_recall", "top_5_f1", "price_direction_error"],
    ),
    "scenario_summary": (
        _scenario_summary, ["scenario", "model"], ["decision_groups", "top_1_hit_rate", "top_3_capture_rate", "mean_scenario_regret"],
    ),
    "champion_models": (
        f"select model, {R('score')} as champion_score, row_number() over (order by score, ce, model) as champion_rank from v_champion",
        ["model"], ["champion_score", "champion_rank"],
    ),
}


def _long(name, body, keys, measures):
    item = ", ".join(f'cast("{k}" as varchar)' for k in keys)
    values = ", ".join(f"{{'measure': '{m}', 'value': cast({m} as double)}}" for m in measures)
    return f"select '{name}' as output, item, v.measure as measure, v.value as value from (select concat_ws('|', {item}) as item, unnest([{values}]) as v from ({body}) t)"


@query("C07b_decision_contents", " union all ".join(f"({_long(name, *parts)})" for name, parts in _contents.items()))
def c07b(s, d):
    run, parts = _run(s, d), []
    for name, (_, keys, measures) in _contents.items():
        item = F.concat_ws("|", *[F.date_format(k, "yyyy-MM-dd HH:mm:ss") if k == TS else F.col(k).cast("string") for k in keys])
        values = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
        parts.append(getattr(run, name).select(F.lit(name).alias("output"), item.alias("item"), F.inline(values)))
    return reduce(DataFrame.unionByName, parts)


@query("K04_best_start", f"""select (select count(*) from v_rankings) as input_rows, 0 as recommended_shift_hours, {T('ts')} as start_utc, predicted_decision_rank
from v_rankings where predicted_decision_rank = 1 order by ts, "window", model limit 1""")
def k04(s, d):
    best = workload.best_start(rankings(s, d).select(TS, "predicted_decision_rank"))
    return best.select(
        "input_rows", "recommended_shift_hours", F.col("recommendation")[TS].alias("start_utc"),
        F.col("recommendation")["predicted_decision_rank"].alias("predicted_decision_rank"),
    )


def _recommendations(s, d):
    return decision.recommendations_with_confidence(rankings(s, d))


@query("S14_dashboard_summary", f"""select count(distinct decision_group) as date_count, count(*) as recommendation_count, {R(H('avg(score)', 4))} as average_confidence_score,
  {R(H("avg((confidence >= 0.75)::int)", 4))} as high_confidence_share from (select *, {H('confidence')} as score from v_rec) r""")
def s14(s, d):
    return dashboard.summary_numbers(_recommendations(s, d))


@query("S14b_dashboard_filters", "select distinct 'date' as filter, decision_group as value from v_rec union all select distinct 'scenario', scenario from v_scenario")
def s14b(s, d):
    ranked = rankings(s, d)
    return dashboard.filter_values(decision.top_recommendations(ranked), decision.top_scenario_recommendations(decision.scenario_rankings(ranked)))


@query("S14c_dashboard_documents", f"""select "window", decision_group, count(*) as recommendations, 3 * count(*) as scenario_rows, min(model) as first_model,
  {R(H('max(confidence)'))} as best_confidence from v_rec group by 1, 2""")
def s14c(s, d):
    ranked = rankings(s, d)
    documents = dashboard.date_documents(
        decision.recommendations_with_confidence(ranked), decision.top_scenario_recommendations(decision.scenario_rankings(ranked))
    )
    size = lambda c: F.json_array_length(c).cast("bigint")
    read = F.from_json("recommendations", "array<struct<model: string, confidence_score: double>>")
    return documents.select(
        "window", "decision_group", size("recommendations").alias("recommendations"), size("scenario_recommendations").alias("scenario_rows"),
        F.array_min(read["model"]).alias("first_model"), F.array_max(read["confidence_score"]).alias("best_confidence"),
    )


_none = 'cast(null as varchar) as "window", cast(null as varchar) as decision_group'
_document_sql = f"""select 'champion' as section, {_none}, case when model = {_champion} then 'chosen' else 'other' end as item, model, {R(H('score', 4))} as value from v_champion
union all select 'summary', {_none}, 'regret of ' || scenario, model, {R(H(_first('regret'), 4))} from v_scenario group by scenario, model
union all select 'summary', {_none}, 'carbon regret', model, {R(H("avg(carbon_regret) filter (where predicted_decision_rank = 1)", 4))} from v_rankings group by model
union all select 'summary', {_none}, 'recommendations', null, count(*) from v_rec where model = {_champion}
union all select 'summary', {_none}, 'dates', null, count(distinct decision_group) from v_rec where model = {_champion}
union all select distinct 'filters', {_none}, 'date ' || decision_group, null, cast(null as double) from v_rec where model = {_champion}
union all select distinct 'filters', {_none}, scenario, null, cast(null as double) from v_scenario
union all select 'date', "window", decision_group, 'confidence ' || predicted_decision_rank, model, {R(H(H('confidence'), 4))} from v_rec where model = {_champion}
union all select 'date', "window", decision_group, scenario || ' ' || p_rank, model, {R(H(H('p_score'), 4))} from v_scenario where p_rank <= 5 and model = {_champion}"""


@query("S14d_dashboard_parts", _document_sql)
def s14d(s, d):
    """The parts of the document read back, one row per entry."""
    run = decision_run(
        ranking.price_decision_rankings(A.price_pred(s, d)), carbon.hourly_carbon(A.pred_long(s, d), A.factors(), A.TECH_SOURCES), *summaries(s, d)
    )
    parts = cut_lineage(dashboard.dashboard_document(run))

    def entries(section, field, shape, item, model, value):
        read = F.explode(F.from_json(F.get_json_object("document", f"$.{field}"), f"array<{shape}>")).alias("e")
        return parts.filter(F.col("section") == section).select("section", "window", "decision_group", "document", read).select(
            "section", "window", "decision_group", item.alias("item"), model.alias("model"), value.cast("double").alias("value")
        )

    e, chosen, none = F.col("e"), F.get_json_object("document", "$.model"), F.lit(None).cast("string")
    found = [
        entries("champion", "models", "struct<model: string, champion_score: double>", F.when(e["model"] == chosen, "chosen").otherwise("other"), e["model"], e["champion_score"]),
        entries("summary", "scenario_metrics", "struct<scenario: string, model: string, mean_scenario_regret: double>", F.concat(F.lit("regret of "), e["scenario"]), e["model"], e["mean_scenario_regret"]),
        entries("summary", "decision_metrics", "struct<model: string, mean_carbon_regret_g_co2e_per_kwh: double>", F.lit("carbon regret"), e["model"], e["mean_carbon_regret_g_co2e_per_kwh"]),
        entries("filters", "dates", "string", F.concat(F.lit("date "), e), none, none),
        entries("filters", "scenarios", "string", e, none, none),
        entries("date", "recommendations", "struct<recommendation_rank: int, model: string, confidence_score: double>", F.concat(F.lit("confidence "), e["recommendation_rank"].cast("string")), e["model"], e["confidence_score"]),
        entries(
            "date", "scenario_recommendations", "struct<scenario: string, recommendation_rank: int, model: string, predicted_scenario_score: double>",
            F.concat(e["scenario"], F.lit(" "), e["recommendation_rank"].cast("string")), e["model"], e["predicted_scenario_score"],
        ),
    ]
    for item, field in (("recommendations", "recommendation_count"), ("dates", "date_count")):
        number = F.get_json_object("document", f"$.{field}").cast("double").alias("value")
        found.append(parts.filter("section = 'summary'").select("section", "window", "decision_group", F.lit(item).alias("item"), none.alias("model"), number))
    return reduce(DataFrame.unionByName, found)


@query("P10_dashboard_filters", f"""select {KEYS}, decision_group, p_rank as recommendation_rank, 'Clean First' as scenario_title from v_scenario
where p_rank <= 5 and scenario = 'clean_first' and decision_group = (select max(decision_group) from v_rec)""")
def p10(s, d):
    rows = decision.top_scenario_recommendations(decision.scenario_rankings(rankings(s, d)))
    return dashboard.scenario_recommendations_of_date(rows).select(TS, "window", "model", "decision_group", "recommendation_rank", "scenario_title")


@query("P10b_recommendations_of_date", f"""select {KEYS}, decision_group, predicted_decision_rank as recommendation_rank from v_rec where decision_group = '2024-01-20'""")
def p10b(s, d):
    rows = decision.top_recommendations(rankings(s, d))
    return dashboard.recommendations_of_date(rows, "2024-01-20").select(TS, "window", "model", "decision_group", "recommendation_rank")


@query("K07b_carbon_chart", f"""select "window", model, decision_group, predicted_decision_rank as recommendation_rank, strftime(ts, '%H:%M') as hour, {R(H('p_carbon'))} as carbon,
  cast(floor({H('confidence')} * 100 + 0.5) as bigint) as confidence from v_rec""")
def k07b(s, d):
    return dashboard.carbon_chart(_recommendations(s, d))


# Workload tables.

_blocks = """(select a.region, {d} as d, a.ts, avg(b.price) as price from p a join p b on b.region = a.region and b.ts >= a.ts and b.ts < a.ts + interval {d} hours
  group by 1, 2, 3 having count(*) = {d})"""
_workload_sql = f"""with p as (select region, h as ts, cast(sum(cast(value as decimal(18,6))) as double) / count(value) as price from v_ev group by 1, 2),
w as (select cast(o_orderkey as varchar) as workload_id, {{regions}}[1 + o_custkey % 12] as region, timestamp '2024-01-01 00:00:00' + to_days(cast(o_orderkey % 28 as integer)) + to_minutes(o_orderkey % 60) as earliest,
  cast(1 + o_orderkey % 24 as integer) as d from orders),
starts as (select workload_id, region, d, unnest(generate_series(date_trunc('hour', earliest + interval 59 minutes), least(earliest + to_hours(12 - d), earliest + interval 10 hours), interval 1 hour)) as ts from w),
b as ({' union all '.join(f'select * from {_blocks.format(d=d)} b{d}' for d in range(1, 13))}),
c as (select s.workload_id, s.region, s.d, s.ts, b.price from starts s join b on b.region = s.region and b.d = s.d and b.ts = s.ts)"""


def _with_regions(tail):
    return _workload_sql.replace("{regions}", sql_views._regions) + "\n" + tail


def candidates(s, d):
    prices, jobs = A.price_by(s, d, "region"), A.workloads(s, d)
    return workload.workload_candidates(jobs, workload.block_averages(prices, workload.workload_durations(jobs), "price_eur_mwh"))


@query("J07_workload_interval_join", _with_regions(f"select workload_id, region, d as duration_hours, {T('ts')} as start_utc, {R('price')} as avg_price_eur_mwh from c"))
def j07(s, d):
    return candidates(s, d).select("workload_id", "region", "duration_hours", "start_utc", "avg_price_eur_mwh")


_best_start = _with_regions(f"""select w.workload_id, count(c.ts) as candidate_count, {T('(list(ts order by price, ts) filter (ts is not null))[1]')} as best_start_utc, {R('min(price)')} as best_avg_price_eur_mwh,
  {R('arg_min(price, ts)')} as run_now_avg_price_eur_mwh from w left join c on c.workload_id = w.workload_id group by 1""")


@query("W14_workload_best_start", _best_start)
def w14(s, d):
    return workload.best_workload_starts(A.workloads(s, d), candidates(s, d), "avg_price_eur_mwh")


@query("W14b_sparse_best_start", _best_start)
def w14b(s, d):
    prices, jobs = A.price_by(s, d, "region"), A.workloads(s, d)
    return workload.cheapest_starts(jobs, workload.block_averages(prices, workload.workload_durations(jobs), "price_eur_mwh"), "avg_price_eur_mwh")
