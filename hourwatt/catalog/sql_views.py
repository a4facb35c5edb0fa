"""Shared views of the reference SQL: the driver's tables in the operators' shapes.

Written for DuckDB, independently of the Spark code: lags are self-joins or row offsets on densified
series, pivots are conditional aggregates.
"""

from __future__ import annotations

from hourwatt.catalog.adapters import TECHNOLOGY, TECH_SOURCES, WINDOWS, factors
from hourwatt.constants import REGIONAL_LOCATIONS, SCENARIOS


def T(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


# A mean over 32, 96, ... two-digit values can end in an exact half at the seventh digit, where the order
# of addition would decide how it rounds. Both sides add this before rounding, so such values round up.
NUDGE = 1.37e-8


def R(expression: str, digits: int = 6) -> str:
    """Rounded double; adding zero turns -0.0 into 0.0."""
    return f"round(cast({expression} as double) + {NUDGE}, {digits}) + 0.0"


def H(expression: str, digits: int = 2) -> str:
    """Half-even rounding of the scaled value."""
    return f"round_even(({expression}) * {10**digits}.0::double, 0) / {10**digits}.0::double"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S+00:00')"
_tech = "case event_type " + " ".join(f"when '{e}' then '{t}'" for e, t in TECHNOLOGY.items()) + " end"
_regions = "[" + ", ".join(quoted(r[0]) for r in REGIONAL_LOCATIONS) + "]"
_windows = ", ".join(f"('{w.name}', timestamp '{w.train_start}', timestamp '{w.train_end}', timestamp '{w.test_start}', timestamp '{w.test_end}')" for w in WINDOWS)
_factors = ", ".join(f"('{m}', '{s}', {v}::double)" for m, by in factors().items() for s, v in by.items())
_scenarios = ", ".join(f"('{n}', {p}::double / ({p}::double + {c}::double), {c}::double / ({p}::double + {c}::double))" for n, p, c in SCENARIOS)
_dec = "cast({} as decimal(18,6))"


def _forecast(series: str, keys: list[str]) -> str:
    part = f"partition by {', '.join(keys)} " if keys else ""
    on = "".join(f" and x.{k} = s.{k}" for k in keys)
    k = "".join(f"s.{c}, " for c in keys)
    return f"""
    with s as (select {', '.join([*keys, 'ts'])}, {H('v')} as v from {series}),
    m as (select *, {H('''cast(sum(cast(v as decimal(18,6))) over d as double) / nullif(count(v) over d, 0)''')} as mean
          from s window d as ({part}order by ts range between interval 24 hours preceding and interval 1 hour preceding)),
    p as (
      select {k}s.ts, s.v as actual, 'naive_lag_24h' as model, x.v as predicted from s join s x on x.ts = s.ts - interval 24 hours{on}
      union all
      select {k}s.ts, s.v, 'naive_lag_168h', x.v from s join s x on x.ts = s.ts - interval 168 hours{on}
      union all
      select {k}s.ts, s.v, 'rolling_mean_24h', s.mean from m s where s.mean is not null)
    select p.*, w.win from p join v_windows w on p.ts between w.test_start and w.test_end"""


_side_sums = ",\n".join(
    f"max(case when target = '{s}' then case when {side} < 0 then 0 else {side} end end) as {side}_{s}" for s in TECH_SOURCES for side in ("actual", "predicted")
)


def _carbon_totals(side: str) -> str:
    generation = " + ".join(f"coalesce({side}_{s}, 0)" for s in TECH_SOURCES)
    emissions = " + ".join(f"coalesce({side}_{s} * f_{s}, 0)" for s in TECH_SOURCES)
    return f"{generation} as {side}_gen, {emissions} as {side}_em"


_factor_columns = ", ".join(f"max(case when source = '{s}' then factor end) as f_{s}" for s in TECH_SOURCES)

G = '"window", model, decision_group'
RANK_PAIRS = {
    "predicted_price": "p_price", "predicted_carbon": "p_carbon", "actual_price": "a_price", "actual_carbon": "a_carbon",
}
_ranks = ", ".join(f"row_number() over (partition by {G} order by {v}, ts) as {n}_rank" for n, v in RANK_PAIRS.items())
_pcts = ", ".join(f"coalesce(({n}_rank - 1) / nullif(candidate_count - 1, 0), 0) as {n}_rank_pct" for n in RANK_PAIRS)


def ranking_sql(candidates: str, price_weight: float = 0.5, carbon_weight: float = 0.5) -> str:
    """Decision ranking of a candidate relation, with regret, savings and price direction."""
    w = price_weight + carbon_weight
    pw, cw = f"({price_weight}::double / {w}::double)", f"({carbon_weight}::double / {w}::double)"
    label = "case when {0} is null then 'unknown' when {0} > 0 then 'increase' when {0} < 0 then 'decrease' else 'flat' end"
    return f"""
    with r as (select *, {_ranks}, count(*) over (partition by {G}) as candidate_count from {candidates}),
    q as (select *, {_pcts} from r),
    s as (select *, {pw} * predicted_price_rank_pct + {cw} * predicted_carbon_rank_pct as predicted_combined_score,
                 {pw} * actual_price_rank_pct + {cw} * actual_carbon_rank_pct as actual_combined_score from q),
    d as (select *, row_number() over (partition by {G} order by predicted_combined_score, ts) as predicted_decision_rank,
                 row_number() over (partition by {G} order by actual_combined_score, ts) as actual_decision_rank,
                 min(actual_combined_score) over (partition by {G}) as best_score,
                 min(a_price) over (partition by {G}) as best_price, min(a_carbon) over (partition by {G}) as best_carbon,
                 first_value(a_price) over (partition by {G} order by ts) as now_price,
                 first_value(a_carbon) over (partition by {G} order by ts) as now_carbon from s)
    select *, actual_combined_score - best_score as combined_regret, a_price - best_price as cost_regret, a_carbon - best_carbon as carbon_regret,
           now_price - a_price as cost_savings, now_carbon - a_carbon as carbon_savings,
           {label.format('(p_price - prev_price)')} as p_dir, {label.format('(a_price - prev_price)')} as a_dir,
           case when prev_price is not null then case when {label.format('(p_price - prev_price)')} = {label.format('(a_price - prev_price)')} then 1.0 else 0.0 end end as dir_ok
    from d"""


def candidate_sql(hourly: str, d: int, constrained: bool) -> str:
    """Blocks of d contiguous hours by joining the hour to its successors."""
    date = "" if constrained else " and {0}.decision_date = h.decision_date"
    joins = "\n".join(
        f'join {hourly} h{i} on h{i}."window" = h."window" and h{i}.model = h.model and h{i}.ts = h.ts + interval {i} hours' + date.format(f"h{i}")
        for i in range(1, d)
    )
    rows = ["h", *[f"h{i}" for i in range(1, d)]]

    def mean(c: str) -> str:
        total = " + ".join(f"coalesce({r}.{c}, 0)" for r in rows)
        count = " + ".join(f"({r}.{c} is not null)::int" for r in rows)
        return f"({total}) / nullif({count}, 0)"

    def total(c: str) -> str:
        return " + ".join(f"coalesce({r}.{c}, 0)" for r in rows)

    group = "'constrained_window'" if constrained else "h.decision_date"
    date_out = "strftime(h.ts, '%Y-%m-%d')" if constrained else "h.decision_date"
    return f"""
    select h.ts, h.ts + interval {d} hours as end_ts, h."window", h.model, {date_out} as decision_date, {group} as decision_group, {d} as duration_hours,
      {mean('actual_price')} as a_price, {mean('predicted_price')} as p_price, {mean('prev')} as prev_price,
      {mean('actual_ci')} as a_carbon, {mean('predicted_ci')} as p_carbon, {total('actual_em')} as a_em, {total('predicted_em')} as p_em
    from {hourly} h
    {joins}"""


VIEWS: dict[str, str] = {
    "v_ev": f"""select event_id, ts, user_id, event_type, value, cast(regexp_extract(props, '[0-9]+') as bigint) as k, {_tech} as tech,
      {_regions}[1 + user_id % 12] as region, date_trunc('hour', ts) as h from events""",
    "v_windows": f"select * from (values {_windows}) t(win, train_start, train_end, test_start, test_end)",
    "v_factors": f"select * from (values {_factors}) t(methodology, source, factor)",
    "v_scenarios": f"select * from (values {_scenarios}) t(scenario, pw, cw)",
    "v_mix_long": f"select tech as target, h as ts, cast(sum({_dec.format('value')} * 0.25) as double) as mwh from v_ev group by 1, 2",
    "v_price": f"select h as ts, cast(sum({_dec.format('value')}) as double) / count(value) as price from v_ev group by 1",
    "v_mix": "select 'FR' as region, h as ts, cast(sum(k * 0.25) as double) as consumption, "
    + ", ".join(f"cast(sum(case when tech = '{s}' then {_dec.format('value')} end * 0.25) as double) as {s}" for s in TECH_SOURCES)
    + f", cast(sum({_dec.format('value')} * 0.25) as double) as production, cast(sum(k) as double) / count(k) as rate from v_ev group by h",
    "v_mix_regional": "select region, h as ts, cast(sum(k * 0.25) as double) as consumption, "
    + ", ".join(f"cast(sum(case when tech = '{s}' then {_dec.format('value')} end * 0.25) as double) as {s}" for s in ("nuclear", "wind", "solar"))
    + f", cast(sum(case when tech in ('nuclear', 'wind', 'solar') then {_dec.format('value')} else 0 end * 0.25) as double) as production, cast(sum(k) as double) / count(k) as rate from v_ev group by 1, 2",
    "v_weather_agg": """select h as ts, avg(value) as t, min(value) as tmin, max(value) as tmax, avg(k) as app, avg(case when event_type <> 'error' then value end) as rad,
      sum(value) as total from v_ev group by h""",
    "v_mix_series": "select target, ts, mwh as v from v_mix_long",
    "v_price_series": "select ts, price as v from v_price",
    "v_pred_long": _forecast("v_mix_series", ["target"]),
    "v_price_pred": _forecast("v_price_series", []),
    "v_gen_wide": f'select ts, win as "window", model, {_side_sums} from v_pred_long group by 1, 2, 3',
    "v_factors_wide": f"select methodology, {_factor_columns} from v_factors group by 1",
    "v_carbon_base": f"select g.*, f.*, {_carbon_totals('actual')}, {_carbon_totals('predicted')} from v_gen_wide g, v_factors_wide f",
    "v_carbon": "select *, actual_em / nullif(actual_gen, 0) as actual_ci, predicted_em / nullif(predicted_gen, 0) as predicted_ci from v_carbon_base",
    "v_carbon_metrics": """select methodology, "window", model, count(*) as n,
      avg(abs(predicted_em - actual_em)) as em_mae, sqrt(avg(pow(predicted_em - actual_em, 2))) as em_rmse, avg(predicted_em - actual_em) as em_bias,
      avg(2 * abs(predicted_em - actual_em) / greatest(abs(actual_em) + abs(predicted_em), 1e-9)) as em_smape,
      avg(abs(predicted_ci - actual_ci)) as ci_mae, sqrt(avg(pow(predicted_ci - actual_ci, 2))) as ci_rmse, avg(predicted_ci - actual_ci) as ci_bias,
      avg(case when actual_ci is not null and predicted_ci is not null then 2 * abs(predicted_ci - actual_ci) / greatest(abs(actual_ci) + abs(predicted_ci), 1e-9) end) as ci_smape
      from v_carbon group by 1, 2, 3""",
    "v_price_rank": """select ts, win as "window", model, actual as actual_price, predicted as predicted_price, strftime(ts, '%Y-%m-%d') as decision_date,
      row_number() over (partition by win, model, strftime(ts, '%Y-%m-%d') order by predicted, ts) as predicted_price_rank,
      row_number() over (partition by win, model, strftime(ts, '%Y-%m-%d') order by actual, ts) as actual_price_rank,
      count(*) over (partition by win, model, strftime(ts, '%Y-%m-%d')) as candidate_count,
      min(actual) over (partition by win, model, strftime(ts, '%Y-%m-%d')) as best from v_price_pred""",
    "v_hourly": """select p.ts, p."window", p.model, p.decision_date, p.actual_price, p.predicted_price, c.actual_ci, c.predicted_ci, c.actual_em, c.predicted_em,
      lag(p.actual_price, 24) over (partition by p."window", p.model order by p.ts) as prev
      from v_price_rank p join v_carbon c on c.ts = p.ts and c."window" = p."window" and c.model = p.model and c.methodology = 'direct_operational_emissions'""",
    "v_candidates": candidate_sql("v_hourly", 1, False),
    "v_rankings": ranking_sql("v_candidates"),
    "v_candidates3": candidate_sql("v_hourly", 3, False),
    "v_scenario_scores": """select r.*, s.scenario, s.pw, s.cw, s.pw * predicted_price_rank_pct + s.cw * predicted_carbon_rank_pct as p_score,
      s.pw * actual_price_rank_pct + s.cw * actual_carbon_rank_pct as a_score from v_rankings r, v_scenarios s""",
    "v_scenario": f"""select *, row_number() over (partition by scenario, {G} order by p_score, predicted_decision_rank) as p_rank,
      row_number() over (partition by scenario, {G} order by a_score, predicted_decision_rank) as a_rank,
      a_score - min(a_score) over (partition by scenario, {G}) as regret from v_scenario_scores""",
    "v_margin": f"""select *, case when spread = 0 or next_score is null then 0 else least(greatest((next_score - predicted_combined_score) / spread, 0), 1) end as margin from (
      select *, lead(predicted_combined_score) over (partition by {G} order by predicted_decision_rank) as next_score,
      max(predicted_combined_score) over (partition by {G}) - min(predicted_combined_score) over (partition by {G}) as spread from v_rankings) t""",
    "v_agreement": """select "window", decision_group, ts, count(distinct model) as agreement_count from v_rankings where predicted_decision_rank <= 5 group by 1, 2, 3""",
    "v_model_counts": """select "window", decision_group, count(distinct model) as model_count from v_rankings group by 1, 2""",
    "v_rec": """select m.*, a.agreement_count, c.model_count, a.agreement_count / c.model_count as agreement_rate,
      1 - (m.predicted_decision_rank - 1) / 4.0::double as rank_part,
      0.45::double * (1.0::double - (m.predicted_decision_rank - 1) / 4.0::double) + 0.35::double * (a.agreement_count / c.model_count) + 0.20::double * m.margin as confidence
      from v_margin m join v_agreement a using ("window", decision_group, ts) join v_model_counts c using ("window", decision_group) where m.predicted_decision_rank <= 5""",
    "v_pairs": f"""select a."window", a.model, a.decision_group, count(*) as compared,
      count(*) filter (where sign(a.predicted_combined_score - b.predicted_combined_score) <> sign(a.actual_combined_score - b.actual_combined_score)) as mistakes
      from v_rankings a join v_rankings b on a."window" = b."window" and a.model = b.model and a.decision_group = b.decision_group
      and a.predicted_decision_rank < b.predicted_decision_rank and a.actual_combined_score <> b.actual_combined_score group by 1, 2, 3""",
    "v_quality_counts": f"""select {G}, count(*) filter (where predicted_decision_rank <= 5 and actual_decision_rank <= 5) as hit,
      count(*) filter (where predicted_decision_rank <= 5) as pp, count(*) filter (where actual_decision_rank <= 5) as ap, avg(dir_ok) as acc,
      max(case when predicted_decision_rank = 1 then combined_regret end) as r1, max(case when predicted_decision_rank = 1 then carbon_regret end) as r2,
      max(case when predicted_decision_rank = 1 then cost_regret end) as r3 from v_rankings group by 1, 2, 3""",
    "v_quality": f"""select q.*, coalesce(p.mistakes / p.compared, 0) as loss, hit / pp as prec, hit / ap as rec,
      case when hit = 0 then 0 else 2 * (hit / pp) * (hit / ap) / (hit / pp + hit / ap) end as f1
      from v_quality_counts q left join v_pairs p using ("window", model, decision_group)""",
    "v_quality_summary": """select model, count(*) as n, avg(loss) as loss, avg(prec) as prec, avg(rec) as rec, avg(f1) as f1, avg(acc) as acc, 1 - avg(acc) as err,
      avg(r1) as r1, avg(r2) as r2, avg(r3) as r3 from v_quality group by 1""",
    "v_reg": """select win as "window", model, count(*) as n, avg(abs(predicted - actual)) as mae, sqrt(avg(pow(predicted - actual, 2))) as rmse,
      avg(2 * abs(predicted - actual) / greatest(abs(actual) + abs(predicted), 1e-9)) as smape, avg(case when pa is not null then (sign(actual - pa) = sign(predicted - pp))::int end) as da
      from (select *, lag(actual) over (partition by win, model order by ts) as pa, lag(predicted) over (partition by win, model order by ts) as pp from v_price_pred) t group by 1, 2""",
    "v_reg_summary": "select model, avg(mae) as mae, avg(rmse) as rmse, avg(smape) as smape, avg(da) as da from v_reg group by 1",
    "v_carbon_summary": """select methodology, model, avg(em_mae) as em_mae, avg(em_rmse) as em_rmse, avg(em_bias) as em_bias, avg(em_smape) as em_smape, avg(ci_mae) as ci_mae,
      avg(ci_rmse) as ci_rmse, avg(ci_bias) as ci_bias, avg(ci_smape) as ci_smape from v_carbon_metrics group by 1, 2""",
    "v_champion_base": """select q.model, q.err, c.ci_mae, q.r2, (q.loss + (1 - q.f1)) / 2 as rl, q.loss, q.f1, q.r1, p.mae from v_quality_summary q
      join v_carbon_summary c on c.model = q.model and c.methodology = 'direct_operational_emissions' join v_reg_summary p on p.model = q.model""",
    "v_champion": """select *, 0.45::double * ce + 0.25::double * cr + 0.2::double * rk + 0.1::double * pd as score from (select *,
      coalesce((ci_mae - min(ci_mae) over ()) / nullif(max(ci_mae) over () - min(ci_mae) over (), 0), 0) as ce,
      coalesce((r2 - min(r2) over ()) / nullif(max(r2) over () - min(r2) over (), 0), 0) as cr,
      coalesce((rl - min(rl) over ()) / nullif(max(rl) over () - min(rl) over (), 0), 0) as rk,
      coalesce((err - min(err) over ()) / nullif(max(err) over () - min(err) over (), 0), 0) as pd from v_champion_base) t""",
}
