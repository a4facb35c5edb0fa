"""Queries: carbon accounting, forecast metrics and rankings by price."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourwatt import constants as C
from hourwatt.catalog import adapters as A
from hourwatt.catalog.registry import query
from hourwatt.catalog.sql_views import ISO, R, T
from hourwatt.operators import carbon, metrics, ranking
from hourwatt.operators.calendar import TS
from hourwatt.plans.carbon import carbon_accounting
from hourwatt.sources.dimensions import factor_frame, load_emission_factors
from hourwatt.sources.payloads import hourly_mix

SRC = A.TECH_SOURCES


def _hourly(s, d):
    return carbon.hourly_carbon(A.pred_long(s, d), A.factors(), SRC)


def flagship(s, d):
    """Hourly carbon intensity of the generation mix, per methodology."""
    return carbon.hourly_intensity_long(A.mix_long(s, d), factor_frame(s, A.factors()))


query("J12_factor_join", f"""
select {T('ts')} as timestamp_utc, methodology, {R('sum(mwh)')} as generation_mwh, {R('sum(mwh * factor)')} as emissions_kg_co2e,
  {R('sum(mwh * factor) / nullif(sum(mwh), 0)')} as carbon_intensity_g_co2e_per_kwh
from v_mix_long join v_factors on source = target group by ts, methodology""")(flagship)


@query("S03_emission_factors", f"""
select methodology, target as source, count(*) as hours, {R('sum(cast(mwh as decimal(18,6)))')} as mwh, {R('max(factor)')} as factor_kg_co2e_per_mwh
from v_mix_long join v_factors on source = target group by 1, 2""")
def s03(s, d):
    factors = factor_frame(s, load_emission_factors())
    mix = A.mix_long(s, d).withColumnRenamed("target", "source")
    return mix.join(F.broadcast(factors), "source").groupBy("methodology", "source").agg(
        F.count("*").alias("hours"), F.sum(F.col("mwh").cast("decimal(18,6)")).alias("mwh"), F.max("factor_kg_co2e_per_mwh").alias("factor_kg_co2e_per_mwh")
    )


def _mix_sql(view, scope, sources):
    columns = ", ".join(f"{R(s)} as {s}_mwh" for s in sources)
    return f"""select region, {T('ts')} as timestamp_utc, {R('consumption')} as consumption_mwh, {columns}, {R('rate')} as carbon_intensity_gco2_kwh,
      {R('production')} as total_production_mwh, 'api' as source, '{scope}' as scope, '1h' as granularity,
      'odre:{scope}:' || region || ':' || {ISO.format('ts')} as source_record_id from {view}"""


@query("S07_hourly_mix", _mix_sql("v_mix", "national", SRC) + " order by 2")
def s07(s, d):
    return hourly_mix(A.records(s, d), C.NATIONAL_SCOPE)


@query("G03_energy_integration", _mix_sql("v_mix_regional", "regional", ("nuclear", "wind", "solar")))
def g03(s, d):
    return hourly_mix(A.records(s, d), C.REGIONAL_SCOPE)


_wide = ", ".join(f"{R(f'{side}_{s}')} as {side}_{s}_generation_mwh" for s in SRC for side in ("actual", "predicted"))


@query("G08_pivot_generation", f"""select {T('ts')} as timestamp_utc, "window", model, {_wide} from v_gen_wide""")
def g08(s, d):
    return carbon.pivot_generation(A.pred_long(s, d), SRC)


_totals = ", ".join(
    f"{R(f'{side}_{short}')} as {side}_{name}"
    for short, name in (("gen", "total_generation_mwh"), ("em", "total_emissions_kg_co2e"), ("ci", "carbon_intensity_g_co2e_per_kwh"))
    for side in ("actual", "predicted")
)
_per_source = ", ".join(
    f"{R(f'{side}_{s}')} as {side}_{s}_generation_mwh, {R(f'{side}_{s} * f_{s}')} as {side}_{s}_emissions_kg_co2e" for s in SRC for side in ("actual", "predicted")
)


@query("G09_hourly_emissions", f"""select {T('ts')} as timestamp_utc, methodology, "window", model, {_totals}, {_per_source} from v_carbon""")
def g09(s, d):
    return _hourly(s, d)


_contribution_sql = " union all ".join(
    f"""select {T('ts')} as timestamp_utc, methodology, "window", model, '{s}' as source, """
    + ", ".join(
        f"{R(f'{side}_{s}')} as {side}_generation_mwh, {R(f'{side}_{s} * f_{s}')} as {side}_emissions_kg_co2e, {R(f'{side}_{s} * f_{s} / nullif({side}_em, 0)')} as {side}_emissions_share"
        for side in ("actual", "predicted")
    )
    + " from v_carbon"
    for s in SRC
)


@query("G10_contributions", _contribution_sql)
def g10(s, d):
    return carbon.contributions(_hourly(s, d), SRC)


_metric_names = {
    "em_mae": "emissions_mae_kg_co2e", "em_rmse": "emissions_rmse_kg_co2e", "em_bias": "emissions_bias_kg_co2e", "em_smape": "emissions_smape",
    "ci_mae": "carbon_intensity_mae_g_co2e_per_kwh", "ci_rmse": "carbon_intensity_rmse_g_co2e_per_kwh",
    "ci_bias": "carbon_intensity_bias_g_co2e_per_kwh", "ci_smape": "carbon_intensity_smape",
}
_metric_sql = ", ".join(f"{R(k)} as {v}" for k, v in _metric_names.items())


@query("G11_carbon_metrics", f"""select methodology, "window", model, n as rows, {_metric_sql} from v_carbon_metrics""")
def g11(s, d):
    return carbon.carbon_metrics(_hourly(s, d))


@query("G12_carbon_summary", f"select methodology, model, {_metric_sql} from v_carbon_summary order by methodology, emissions_mae_kg_co2e")
def g12(s, d):
    return carbon.carbon_summary(carbon.carbon_metrics(_hourly(s, d))).orderBy("methodology", "emissions_mae_kg_co2e")


@query("C02_carbon_accounting", f"select methodology, model, {_metric_sql} from v_carbon_summary")
def c02(s, d):
    return carbon_accounting(A.pred_long(s, d), A.factors(), SRC).summary


@query("P04_missing_targets", f"""
select w."window", w.model, t.target from (select distinct win as "window", model from v_pred_long where target in ('nuclear', 'gas')) w
cross join (select unnest(['nuclear', 'gas', 'oil', 'hydro']) as target) t
where not exists (select 1 from v_pred_long p where p.win = w."window" and p.model = w.model and p.target = t.target)""")
def p04(s, d):
    return carbon.missing_targets(A.pred_long(s, d), ("nuclear", "gas", "oil", "hydro"))


@query("F01_safe_divide", f"""
select {T('ts')} as timestamp_utc, target, {R("mwh / nullif(case when target = 'wind' then 0 else mwh end, 0)")} as ratio from v_mix_long""")
def f01(s, d):
    from hourwatt.functions.numeric import safe_divide

    denominator = F.when(F.col("target") == "wind", F.lit(0.0)).otherwise(F.col("mwh"))
    return A.mix_long(s, d).select(TS, "target", safe_divide(F.col("mwh"), denominator).alias("ratio"))


@query("F07_clip", f"""
select event_id, {R('greatest(value - 50, 0)')} as floored, {R('least(greatest((value - 50) / 100, 0), 1)')} as bounded,
  case when event_type = 'error' then null else {R('greatest(value - 50, 0)')} end as kept_null from v_ev""")
def f07(s, d):
    from hourwatt.functions.numeric import clip

    value = F.col("value") - 50
    return A.events(s, d).select(
        "event_id", clip(value, lower=0).alias("floored"), clip(value / 100, 0, 1).alias("bounded"),
        clip(F.when(F.col("event_type") != "error", value), lower=0).alias("kept_null"),
    )


# Forecast metrics and price rankings.

_reg = ", ".join(f"{R(k)} as {v}" for k, v in (("mae", "mae"), ("rmse", "rmse"), ("smape", "smape"), ("da", "directional_accuracy")))
PRICE = ("actual_price_eur_mwh", "predicted_price_eur_mwh")


def _price_metrics(s, d):
    return metrics.regression_metrics(A.price_pred(s, d), *PRICE, ["window", "model"])


@query("G13_regression_metrics", f"""select "window", model, n as test_rows, {_reg} from v_reg""")
def g13(s, d):
    return _price_metrics(s, d)


@query("G13b_evaluate_forecast", f"""select {R('avg(abs(predicted - actual))')} as mae, {R('sqrt(avg(pow(predicted - actual, 2)))')} as rmse,
  {R('avg(2 * abs(predicted - actual) / greatest(abs(actual) + abs(predicted), 1e-9))')} as smape from v_price_pred""")
def g13b(s, d):
    return metrics.evaluate_forecast(A.price_pred(s, d), *PRICE)


@query("G22_metric_means", f"""select 'price' as target, model, {_reg} from v_reg_summary union all
select target, model, {R('avg(mae)')}, {R('avg(rmse)')}, {R('avg(smape)')}, {R('avg(da)')} from (
  select target, win, model, avg(abs(predicted - actual)) as mae, sqrt(avg(pow(predicted - actual, 2))) as rmse,
    avg(2 * abs(predicted - actual) / greatest(abs(actual) + abs(predicted), 1e-9)) as smape,
    avg(case when pa is not null then (sign(actual - pa) = sign(predicted - pp))::int end) as da
  from (select *, lag(actual) over (partition by target, win, model order by ts) as pa, lag(predicted) over (partition by target, win, model order by ts) as pp from v_pred_long) t
  group by 1, 2, 3) u group by 1, 2""")
def g22(s, d):
    price = metrics.mean_over_windows(_price_metrics(s, d), ["model"]).select(F.lit("price").alias("target"), "*")
    signals = metrics.regression_metrics(A.pred_long(s, d), "actual_mwh", "predicted_mwh", ["target", "window", "model"])
    return price.unionByName(metrics.mean_over_windows(signals, ["target", "model"]))


@query("W15_direction_match", f"""select {T('ts')} as timestamp_utc, win as "window", model,
  case when pa is not null then (sign(actual - pa) = sign(predicted - pp))::int::double end as direction_match
  from (select *, lag(actual) over (partition by win, model order by ts) as pa, lag(predicted) over (partition by win, model order by ts) as pp from v_price_pred) t""")
def w15(s, d):
    return metrics.with_direction_match(A.price_pred(s, d), *PRICE, ["window", "model"]).select(TS, "window", "model", "direction_match")


_smape = "2 * abs(predicted - actual) / greatest(abs(actual) + abs(predicted), 1e-9)"


@query("F02_error_columns", f"""select {T('ts')} as timestamp_utc, win as "window", model, {R('predicted - actual')} as error, {R('abs(predicted - actual)')} as absolute_error,
  {R('pow(predicted - actual, 2)')} as squared_error, {R(_smape)} as symmetric_absolute_percentage_error, {R(f'100 * ({_smape})')} as smape_pct from v_price_pred""")
def f02(s, d):
    return metrics.add_errors(A.price_pred(s, d)).drop(*PRICE)


_regime = "case when actual <= q1 then 'low' when actual <= q2 then 'medium_low' when actual <= q3 then 'medium_high' else 'high' end"
_regimes = f"""(select p.*, {_regime} as price_regime from v_price_pred p, (select quantile_cont(actual, 0.25) as q1, quantile_cont(actual, 0.5) as q2,
  quantile_cont(actual, 0.75) as q3 from v_price_pred) q)"""


@query("F08_price_regime", f"""select {T('ts')} as timestamp_utc, win as "window", model, price_regime from {_regimes} r""")
def f08(s, d):
    return metrics.add_price_regime(A.price_pred(s, d)).select(TS, "window", "model", "price_regime")


def _diagnostics_sql():
    buckets = {
        "window": ("win", '"window"'), "hour": ("cast(hour(ts) as varchar)", "hour"), "day_of_week": ("cast(isodow(ts) - 1 as varchar)", "day_of_week"),
        "month": ("cast(month(ts) as varchar)", "month"), "weekend": ("cast(isodow(ts) >= 6 as varchar)", "is_weekend"),
        "peak_hour": ("cast(hour(ts) between 8 and 20 as varchar)", "is_peak_hour"),
        "morning_ramp": ("cast(hour(ts) between 6 and 9 as varchar)", "is_morning_ramp"),
        "evening_peak": ("cast(hour(ts) between 17 and 20 as varchar)", "is_evening_peak"), "price_regime": ("price_regime", "price_regime"),
    }
    parts = []
    for name, (expr, _) in buckets.items():
        columns = ", ".join(f"{expr if other == name else 'null'} as {alias}" for other, (_, alias) in buckets.items())
        parts.append(
            f"""select model, {columns}, '{name}' as diagnostic_group, count(*) as rows, {R('avg(predicted - actual)')} as mean_error, {R('avg(abs(predicted - actual))')} as mae,
            {R('sqrt(avg(pow(predicted - actual, 2)))')} as rmse, {R(f'avg({_smape})')} as smape, {R('max(abs(predicted - actual))')} as max_abs_error, {R(f'max({_smape})')} as max_smape
            from {_regimes} r group by model, {expr}"""
        )
    return " union all ".join(parts)


@query("G21_error_diagnostics", _diagnostics_sql())
def g21(s, d):
    return metrics.error_diagnostics(A.price_pred(s, d))


@query("K01_top_misses", f"""select {T('ts')} as timestamp_utc, "window", model, {R('absolute_error')} as absolute_error, hour(ts)::int as hour, (isodow(ts) - 1)::int as day_of_week,
  hour(ts) between 8 and 20 as is_peak_hour, hour(ts) between 17 and 20 as is_evening_peak from (
  select ts, win as "window", model, abs(predicted - actual) as absolute_error, row_number() over (partition by model order by abs(predicted - actual) desc, ts, win) as rn from v_price_pred) t where rn <= 25""")
def k01(s, d):
    top = metrics.top_error_periods(A.price_pred(s, d))
    return top.select(TS, "window", "model", "absolute_error", "hour", "day_of_week", "is_peak_hour", "is_evening_peak")


@query("M01_seasonal_naive", f"""select {T('a.ts')} as timestamp_utc, a.target, {R('a.mwh')} as mwh, {R('b.mwh')} as predicted_mwh
  from v_mix_long a left join v_mix_long b on b.target = a.target and b.ts = a.ts - interval 24 hours""")
def m01(s, d):
    from hourwatt.operators.trailing import lag_hours, owned_rows, with_halo

    spread = with_halo(A.mix_long(s, d), 24)
    return owned_rows(spread.withColumn("predicted_mwh", lag_hours("mwh", 24, ["target"])))


_price_rank_cols = f"""{T('ts')} as timestamp_utc, "window", model, {R('actual_price')} as actual_price_eur_mwh, {R('predicted_price')} as predicted_price_eur_mwh, decision_date,
  predicted_price_rank, actual_price_rank, candidate_count, {R('best')} as actual_best_price_eur_mwh, {R('actual_price - best')} as regret_vs_best_eur_mwh,
  predicted_price_rank = 1 as is_predicted_best, actual_price_rank = 1 as is_actual_best, predicted_price_rank <= 3 as is_predicted_top_3, actual_price_rank <= 3 as is_actual_top_3"""


def _price_rankings(s, d):
    return ranking.price_decision_rankings(A.price_pred(s, d))


@query("M09_price_rankings", f"select {_price_rank_cols} from v_price_rank")
def m09(s, d):
    return _price_rankings(s, d)


_spearman = """(select "window", model, decision_date, case when stddev_pop(pr) * stddev_pop(ar) = 0 then null else covar_pop(pr, ar) / (stddev_pop(pr) * stddev_pop(ar)) end as rho from (
  select "window", model, decision_date,
    rank() over (partition by "window", model, decision_date order by predicted_price) + (count(*) over (partition by "window", model, decision_date, predicted_price) - 1) / 2 as pr,
    rank() over (partition by "window", model, decision_date order by actual_price) + (count(*) over (partition by "window", model, decision_date, actual_price) - 1) / 2 as ar
  from v_price_rank) t group by 1, 2, 3)"""


@query("G18_spearman", f"""select "window", model, decision_date, {R('rho')} as spearman from {_spearman} r""")
def g18(s, d):
    return ranking.group_spearman(_price_rankings(s, d), ["window", "model", "decision_date"], "predicted_price_eur_mwh", "actual_price_eur_mwh")


@query("G17_price_ranking_summary", f"""select a.model, decision_groups, {R('top1')} as top_1_hit_rate, {R('top3')} as top_3_capture_rate, {R('mr')} as mean_top_1_regret_eur_mwh,
  {R('medr')} as median_top_1_regret_eur_mwh, {R('mar')} as mean_actual_rank_of_predicted_best, {R('t3')} as top_3_average_actual_rank, {R('rho')} as mean_spearman_rank_corr from (
  select model, count(distinct ("window", decision_date)) as decision_groups, avg((actual_price_rank = 1)::int) filter (where predicted_price_rank = 1) as top1,
    avg((predicted_price_rank <= 3)::int) filter (where actual_price_rank = 1) as top3, avg(actual_price - best) filter (where predicted_price_rank = 1) as mr,
    median(actual_price - best) filter (where predicted_price_rank = 1) as medr, avg(actual_price_rank) filter (where predicted_price_rank = 1) as mar,
    avg(actual_price_rank) filter (where predicted_price_rank <= 3) as t3 from v_price_rank group by 1) a
  join (select model, avg(rho) as rho from {_spearman} r group by 1) b on a.model = b.model""")
def g17(s, d):
    return ranking.price_ranking_summary(_price_rankings(s, d))


@query("G28_flat_metrics", f"""select model || '.' || metric as metric_name, {R('value')} as value from (
  select model, 'mae' as metric, mae as value from v_reg_summary union all select model, 'rmse', rmse from v_reg_summary
  union all select model, 'smape', smape from v_reg_summary union all select model, 'directional_accuracy', da from v_reg_summary) t""")
def g28(s, d):
    return metrics.flatten_metrics(metrics.mean_over_windows(_price_metrics(s, d), ["model"]))


@query("G24_best_model", f"""select arg_min(model, mae) as model, {R('min(mae)')} as mae from v_reg_summary where model <> 'naive_lag_24h'""")
def g24(s, d):
    from hourwatt.plans.forecast import best_trained_model

    return best_trained_model(metrics.mean_over_windows(_price_metrics(s, d), ["model"]))


@query("M10_signal_model_choice", f"""select "window", model, n as test_rows, {R('mae')} as mae from v_reg where model = 'naive_lag_168h'""")
def m10(s, d):
    from hourwatt.plans.forecast import preferred_model

    table = _price_metrics(s, d)
    chosen = preferred_model(A.MODELS, order=("ridge", "naive_lag_168h", C.NAIVE_MODEL))
    return table.filter(F.col("model") == chosen).select("window", "model", "test_rows", "mae")
