"""Queries: data quality, ingestion state, set operations and idempotent merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourwatt import schemas
from hourwatt.catalog import adapters as A
from hourwatt.catalog.registry import query
from hourwatt.catalog.sql_views import ISO, R, T
from hourwatt.operators import ingestion, quality
from hourwatt.operators.calendar import TS
from hourwatt.sources.tables import load_summary
from hourwatt.session import cut_lineage
from hourwatt.sources.upsert import keep_one, require_record_id, upsert

LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_REST = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def tables(s, d):
    return {"electricity_prices": A.price_table(s, d), "hourly_electricity_mix": mix(s, d), "weather_observations": A.weather_rows(s, d)}


def mix(s, d):
    from hourwatt import constants as C
    from hourwatt.sources.payloads import hourly_mix

    return hourly_mix(A.records(s, d), C.REGIONAL_SCOPE)


@query("G04_table_coverage", f"""select 'electricity_prices' as table_name, count(*) as row_count, {T('min(ts)')} as min_timestamp_utc, {T('max(ts)')} as max_timestamp_utc from v_price
union all select 'hourly_electricity_mix', count(*), {T('min(ts)')}, {T('max(ts)')} from v_mix_regional union all select 'weather_observations', count(*), {T('min(h)')}, {T('max(h)')} from v_ev""")
def g04(s, d):
    return quality.table_coverage(tables(s, d))


@query("G05_duplicate_keys", "select l_orderkey, l_linenumber, count(*) as duplicate_count from lineitem group by 1, 2 having count(*) > 1")
def g05(s, d):
    return quality.duplicate_keys(A.table(s, d, "lineitem"), LINE_KEY)


@query("D08_natural_key_duplicates", f"select region, {T('h')} as timestamp_utc, '1h' as granularity, 'api' as source, count(*) as duplicate_count from v_ev group by region, h having count(*) > 1")
def d08(s, d):
    return quality.duplicate_keys(A.weather_rows(s, d), schemas.NATURAL_KEYS["weather_observations"])


@query("G07_null_counts", """select 'hourly_electricity_mix' as table_name, count(*) filter (where nuclear is null) as null_primary_measure_1, count(*) filter (where wind is null) as null_primary_measure_2,
  count(*) filter (where rate is null) as null_primary_measure_3 from v_mix_regional
union all select 'weather_observations', 0, count(*) filter (where event_type = 'error'), 0 from v_ev""")
def g07(s, d):
    measures = {
        "hourly_electricity_mix": ["nuclear_mwh", "wind_mwh", "carbon_intensity_gco2_kwh"],
        "weather_observations": ["temperature_c", "shortwave_radiation_wm2", "cloud_cover_pct"],
    }
    return quality.null_counts(tables(s, d), measures)


@query("G26_off_hour_rows", f"select count(*) as row_count, {T('min(ts)')} as min_timestamp_utc, {T('max(ts)')} as max_timestamp_utc, count(*) filter (where minute(ts) <> 0 or second(ts) <> 0) as non_hourly_rows from events")
def g26(s, d):
    return quality.off_hour_rows(A.events(s, d), "ts")


@query("G27_load_summary", "select 'electricity_prices' as table_name, count(*) as row_count from v_price union all select 'hourly_electricity_mix', count(*) from v_mix_regional union all select 'weather_observations', count(*) from events")
def g27(s, d):
    return load_summary(tables(s, d))


@query("D01_quality_checks", """with price_gap as (select count(*) as n from (select unnest(generate_series(min(ts), max(ts), interval 1 hour)) as ts from v_price) g where ts not in (select ts from v_price)),
region_gap as (select r.region, count(*) as n from (select region, unnest(generate_series(min(h), max(h), interval 1 hour)) as ts from v_ev group by 1) r
  where not exists (select 1 from v_ev e where e.region = r.region and e.h = r.ts) group by 1)
select 'table_coverage' as check_name, true as passed, 3 as detail_rows union all select 'duplicate_source_ids', true, 0
union all select 'missing_price_hours', n = 0, case when n > 0 then 1 else 0 end from price_gap
union all select 'missing_mix_hours', count(*) = 0, count(*) from region_gap union all select 'missing_weather_hours', count(*) = 0, count(*) from region_gap
union all select 'key_null_rates', true, 2""")
def d01(s, d):
    t = tables(s, d)
    return quality.run_checks(t["electricity_prices"], t["hourly_electricity_mix"], t["weather_observations"])


@query("D02_quality_report")
def d02(s, d):
    t = tables(s, d)
    details = quality.check_details(t["electricity_prices"], t["hourly_electricity_mix"], t["weather_observations"])
    # Both the verdicts and the lines read these rows.
    stored = {name: cut_lineage(rows) for name, rows in details.items()}
    return quality.compact_report(quality.judge(stored), stored)


def bad_weather(s, d):
    """Weather rows whose humidity-like percentage goes over 100 for large values."""
    return A.weather_rows(s, d).withColumn("cloud_cover_pct", F.col("cloud_cover_pct") + F.col("temperature_c") - 100)


_rules = ["cloud_cover_pct_percent", "precipitation_mm_not_negative", "source_known", "timestamp_present", "region_not_empty", "granularity_known"]


def rules():
    return {name: rule for name, rule in schemas.weather_rules().items() if name in _rules}


@query("D09_constraint_violations", """select count(*) as row_count, rule, case when rule = 'cloud_cover_pct_percent' then count(*) filter (where k + value - 100 < 0 or k + value - 100 > 100) else 0 end as violations
from v_ev cross join (values ('cloud_cover_pct_percent'), ('precipitation_mm_not_negative'), ('source_known'), ('timestamp_present'), ('region_not_empty'), ('granularity_known')) r(rule) group by rule""")
def d09(s, d):
    return quality.violation_counts(bad_weather(s, d), rules())


def _broken_events(s, d):
    """Every event as a price, a mix and a checkpoint row; each kind of event breaks rules of its own."""
    ev, kind = A.events(s, d), F.col("event_type")
    blank = lambda name, good: F.when(kind == name, F.lit("")).otherwise(F.lit(good))
    return ev.select(
        F.when(kind == "error", "guess").otherwise("api").alias("source"), blank("signup", "FR").alias("region"),
        F.when(kind != "view", F.col("ts")).alias(TS), F.when(F.col("k") > 50, "2h").otherwise("1h").alias("granularity"),
        blank("click", "day_ahead").alias("market"), F.when(kind != "purchase", F.col("value")).alias("price_eur_mwh"),
        F.when(F.col("value") > 50, "EURO").otherwise("EUR").alias("currency"), F.when(kind == "click", "local").otherwise("regional").alias("scope"),
        (F.col("value") - 20).alias("nuclear_mwh"), (F.col("k") - 10).alias("consumption_mwh"),
        F.when(kind == "error", "lost").otherwise("completed").alias("status"), (F.col("k") - 5).alias("rows_loaded"),
        F.to_date("ts").alias("window_start_date"), F.date_sub(F.to_date("ts"), (F.col("k") % 3).cast("int") - 1).alias("window_end_date"),
    )


_observed = {
    "source_known": "event_type = 'error'", "region_not_empty": "event_type = 'signup'", "timestamp_present": "event_type = 'view'", "granularity_known": "k > 50",
}
_priced = {"market_not_empty": "event_type = 'click'", "price_present": "event_type = 'purchase'", "currency_three_letters": "value > 50"}
_mixed = {"scope_known": "event_type = 'click'", "nuclear_mwh_not_negative": "value < 20", "consumption_mwh_not_negative": "k < 10"}
_tracked = {"status_known": "event_type = 'error'", "rows_loaded_not_negative": "k < 5", "window_ordered": "k % 3 = 2"}


def _violations_sql(rules):
    return " union all ".join(f"select count(*) as row_count, '{name}' as rule, count(*) filter ({broken}) as violations from v_ev" for name, broken in rules.items())


@query("D09c_price_rules", _violations_sql(_observed | _priced))
def d09c(s, d):
    return quality.violation_counts(_broken_events(s, d), schemas.price_rules())


@query("D09d_mix_rules", _violations_sql(_observed | _mixed))
def d09d(s, d):
    return quality.violation_counts(_broken_events(s, d), {n: r for n, r in schemas.mix_rules().items() if n in _observed | _mixed})


@query("D09e_checkpoint_rules", _violations_sql(_tracked))
def d09e(s, d):
    return quality.violation_counts(_broken_events(s, d), schemas.checkpoint_rules())


@query("D09b_quarantine", """select region, count(*) filter (where ok) as valid_rows, count(*) filter (where not ok) as quarantined_rows from (
  select region, k + cast(value as decimal(18,6)) - 100 between 0 and 100 as ok from v_ev) t group by 1""")
def d09b(s, d):
    valid, rejected = quality.split_valid(bad_weather(s, d), rules())
    rows = valid.select("region", F.lit(1).alias("v"), F.lit(0).alias("q")).unionByName(rejected.select("region", F.lit(0).alias("v"), F.lit(1).alias("q")))
    return rows.groupBy("region").agg(F.sum("v").alias("valid_rows"), F.sum("q").alias("quarantined_rows"))


@query("F11_contract_rules", """select count(*) as row_count, rule, case rule when 'duration_positive' then 0 when 'end_after_start' then 0 when 'power_positive' then count(*) filter (where o_totalprice <= 0) else 0 end as violations
from orders cross join (values ('workload_id_not_empty'), ('region_not_empty'), ('duration_positive'), ('power_positive'), ('max_delay_not_negative'), ('end_after_start')) r(rule) group by rule""")
def f11(s, d):
    return quality.violation_counts(A.workloads(s, d), schemas.workload_rules())


# Ingestion state.

_days = """(select tech as region, h::date as day, count(distinct hour(h)) as hours, count(*) as n from v_ev group by 1, 2)"""
_state = f"(select region, day, n, case when hours = 24 then 'completed' when hours >= 12 then 'failed' else 'running' end as status, hours from {_days} x)"


@query("J14_pending_windows", f"select region, strftime(day, '%Y-%m-%d') as window_start_date from {_state} t where status <> 'completed'")
def j14(s, d):
    state = A.checkpoints(s, d)
    return ingestion.pending_windows(state.select(*ingestion.WINDOW_KEY), state).select("region", "window_start_date")


@query("D06_resume_plan", f"""select g.region, strftime(g.day, '%Y-%m-%d') as window_start_date from (select r.region, unnest(generate_series(a::timestamp, b::timestamp, interval 1 day))::date as day
  from (select distinct tech as region from v_ev) r, (select min(ts)::date as a, max(ts)::date as b from events) q) g
where not exists (select 1 from {_state} t where t.region = g.region and t.day = g.day and t.status = 'completed')""")
def d06(s, d):
    from hourwatt.operators.calendar import date_windows

    ev = A.events(s, d)
    span = ev.agg(F.to_date(F.min("ts")).alias("start_date"), F.to_date(F.max("ts")).alias("end_date"))
    regions = F.explode(F.array(*[F.lit(t) for t in A.TECHNOLOGY.values()])).alias("region")
    plan = date_windows(span, 1).select(F.lit("odre").alias("source_name"), F.lit("mix").alias("dataset_name"), regions, "window_start_date", "window_end_date")
    return ingestion.pending_windows(plan, A.checkpoints(s, d)).select("region", "window_start_date")


_now = "2024-02-01 00:00:00"


def _now_column():
    return F.lit(_now).cast("timestamp")


def _state_rows(df):
    return df.select("region", "window_start_date", "status", "rows_loaded", "error_message", "started_at", "finished_at")


_state_out = "region, strftime(day, '%Y-%m-%d') as window_start_date"
_old_message = "case when status = 'failed' then 'hours: ' || hours end"
_day = "strftime(day, '%Y-%m-%d %H:%M:%S')"


@query("D03_start_windows", f"""select {_state_out}, case when status = 'completed' then status else 'running' end as status, case when status = 'completed' then n else 0 end as rows_loaded,
  null::varchar as error_message, case when status = 'completed' then {_day} else '{_now}' end as started_at, case when status = 'completed' then {_day} end as finished_at from {_state} t
union all select region, '2024-02-10', 'running', 0, null, '{_now}', null from (select distinct region from {_state} t) u""")
def d03(s, d):
    state = A.checkpoints(s, d)
    later = state.select(*ingestion.WINDOW_KEY[:3]).distinct().select(
        "*", F.lit("2024-02-10").cast("date").alias("window_start_date"), F.lit("2024-02-10").cast("date").alias("window_end_date")
    )
    return _state_rows(ingestion.start_windows(state, state.select(*ingestion.WINDOW_KEY).unionByName(later), _now_column()))


@query("D04_complete_windows", f"""select {_state_out}, 'completed' as status, n as rows_loaded, null::varchar as error_message, {_day} as started_at, '{_now}' as finished_at from {_state} t""")
def d04(s, d):
    state = A.checkpoints(s, d)
    loaded = A.events(s, d).groupBy(F.col("technology").alias("region"), F.to_date("ts").alias("window_start_date")).agg(F.count("*").alias("rows_loaded"))
    loaded = loaded.select(F.lit("odre").alias("source_name"), F.lit("mix").alias("dataset_name"), "region", "window_start_date", F.col("window_start_date").alias("window_end_date"), "rows_loaded")
    return _state_rows(ingestion.complete_windows(state, loaded, _now_column()))


@query("D05_fail_windows", f"""select {_state_out}, case when status = 'completed' then status else 'failed' end as status, case when status = 'completed' then n else 0 end as rows_loaded,
  case when status <> 'completed' then repeat('x', 2000) end as error_message, {_day} as started_at, case when status = 'completed' then {_day} else '{_now}' end as finished_at from {_state} t""")
def d05(s, d):
    state = A.checkpoints(s, d)
    failures = state.select(*ingestion.WINDOW_KEY, F.repeat(F.lit("x"), F.lit(3000)).alias("error_message"))
    return _state_rows(ingestion.fail_windows(state, failures, _now_column()))


@query("F12_message_truncation", "select event_type, max(length(substr(repeat(event_type, 1000), 1, 2000))) as message_length from events group by 1")
def f12(s, d):
    from hourwatt.functions.text import truncate_message

    message = truncate_message(F.repeat("event_type", F.lit(1000)))
    return A.events(s, d).groupBy("event_type").agg(F.max(F.length(message)).cast("bigint").alias("message_length"))


@query("D07_purge_and_reset", f"""select 'prices' as table_name, count(*) as row_count from v_price where false union all select 'weather', count(*) from events
union all select 'checkpoints', 0 from (select 1) x""")
def d07(s, d):
    prices = ingestion.purge_source(A.price_table(s, d), "energy-charts:")
    weather = ingestion.purge_source(A.weather_rows(s, d), "energy-charts:")
    return load_summary({"prices": prices, "weather": weather, "checkpoints": ingestion.reset_windows(A.checkpoints(s, d), "odre", "mix")})


# Set operations, deduplication and upserts.


@query("U01_union_of_checks", f"select 'electricity_prices' as table_name, count(*) as row_count, {T('min(ts)')} as first_hour from v_price union all select 'weather_observations', count(*), {T('min(h)')} from v_ev")
def u01(s, d):
    t = tables(s, d)
    return quality.table_coverage({k: t[k] for k in ("electricity_prices", "weather_observations")}).select(
        "table_name", "row_count", F.col("min_timestamp_utc").alias("first_hour")
    )


@query("U02_concatenate_frames", """select win as "window", model, 'price' as kind, count(*) as rows from v_price_pred group by 1, 2 union all select win, model, 'generation', count(*) from v_pred_long group by 1, 2""")
def u02(s, d):
    both = A.price_pred(s, d).withColumn("kind", F.lit("price")).unionByName(A.pred_long(s, d).withColumn("kind", F.lit("generation")), allowMissingColumns=True)
    return both.groupBy("window", "model", "kind").agg(F.count("*").alias("rows"))


@query("U03_set_operations", """select 'common' as side, model as name from (select distinct model from v_price_pred intersect select distinct model from v_pred_long) a
union all select 'missing', s from (select unnest(['nuclear', 'gas', 'coal', 'oil', 'wind', 'solar', 'hydro', 'bioenergy']) as s except select distinct target from v_pred_long) b""")
def u03(s, d):
    from hourwatt import constants as C

    common = A.price_pred(s, d).select("model").intersect(A.pred_long(s, d).select("model"))
    wanted = s.createDataFrame([(x,) for x in C.GENERATION_SOURCES], "name string")
    missing = wanted.exceptAll(A.pred_long(s, d).select(F.col("target").alias("name")).distinct())
    return common.select(F.lit("common").alias("side"), F.col("model").alias("name")).unionByName(missing.select(F.lit("missing").alias("side"), "name"))


@query("U04_provisional_merge", f"""with early as (select region, h as ts, sum(k * 0.25)::double as mwh from v_ev where event_type <> 'error' group by 1, 2),
late as (select region, h as ts, sum(k * 0.25)::double as mwh from v_ev where event_type in ('view', 'error', 'signup') group by 1, 2)
select coalesce(l.region, e.region) as region, {T('coalesce(l.ts, e.ts)')} as timestamp_utc, {R('coalesce(l.mwh, e.mwh)')} as consumption_mwh from early e full join late l on l.region = e.region and l.ts = e.ts""")
def u04(s, d):
    from hourwatt import constants as C
    from hourwatt.plans.ingestion import merge_datasets
    from hourwatt.sources.payloads import hourly_mix

    ev = A.events(s, d)
    rec = ev.select("ts", "event_type", F.col("region").alias("libelle_region"), F.col("k").alias("consommation"), F.col("k").alias("taux_co2"))
    historical = hourly_mix(rec.filter(F.col("event_type") != "error"), C.REGIONAL_SCOPE)
    provisional = hourly_mix(rec.filter(F.col("event_type").isin("view", "error", "signup")), C.REGIONAL_SCOPE)
    return merge_datasets([historical, provisional]).select("region", TS, "consumption_mwh")


_rest = ", ".join(LINE_REST)
_line_out = "l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') as l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
_latest = f"(select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, {_rest}) as rn from lineitem {{0}})"


def lines(s, d):
    return A.table(s, d, "lineitem")


@query("W16_keep_one_per_key", f"select {_line_out} from {_latest.format('')} t where rn = 1")
def w16(s, d):
    return keep_one(lines(s, d), LINE_KEY, F.desc("l_shipdate"), *LINE_REST)


@query("S10_upsert", f"""with base as (select * from {_latest.format('where year(l_shipdate) < 2000')} t where rn = 1), batch as (select * from {_latest.format('where year(l_shipdate) >= 1999')} t where rn = 1)
select {_line_out}, origin as created_at from (select *, 'batch' as origin from batch b where not exists (select 1 from base x where x.l_orderkey = b.l_orderkey and x.l_linenumber = b.l_linenumber)
  union all select b.*, 'base' from batch b where exists (select 1 from base x where x.l_orderkey = b.l_orderkey and x.l_linenumber = b.l_linenumber)
  union all select x.*, 'base' from base x where not exists (select 1 from batch b where x.l_orderkey = b.l_orderkey and x.l_linenumber = b.l_linenumber)) u""")
def s10(s, d):
    all_lines, order = lines(s, d), [F.desc("l_shipdate"), *LINE_REST]
    base = keep_one(all_lines.filter(F.year("l_shipdate") < 2000), LINE_KEY, *order).withColumn("created_at", F.lit("base"))
    batch = all_lines.filter(F.year("l_shipdate") >= 1999).withColumn("created_at", F.lit("batch"))
    return upsert(base, batch, LINE_KEY, order)


@query("S11_feature_upsert", f"select {T('ts')} as timestamp_utc, {R('case when day(ts) >= 15 then price + 1 else price end')} as price_eur_mwh from v_price")
def s11(s, d):
    prices = A.price_by(s, d)
    changed = prices.filter(F.dayofmonth(TS) >= 15).withColumn("price_eur_mwh", F.col("price_eur_mwh") + 1)
    return upsert(prices, changed, [TS], ["price_eur_mwh"])


@query("P13_record_ids", f"""select event_id, 'odre:regional:' || region || ':' || {ISO.format('h')} as mix_id, 'energy-charts:FR:' || {ISO.format('h')} as price_id,
  'entsoe:10YFR-RTE------C:' || {ISO.format('h')} as xml_price_id, 'open-meteo:' || region || ':' || {ISO.format('h')} as weather_id from v_ev""")
def p13(s, d):
    from hourwatt.functions.text import iso_utc, record_id

    hour = iso_utc(F.date_trunc("hour", "ts"))
    ids = A.events(s, d).select(
        "event_id", record_id("odre", "regional", F.col("region"), hour).alias("mix_id"), record_id("energy-charts", "FR", hour).alias("price_id"),
        record_id("entsoe", "10YFR-RTE------C", hour).alias("xml_price_id"), record_id("open-meteo", F.col("region"), hour).alias("weather_id"),
    )
    return require_record_id(ids, "mix_id")


@query("W17_importance_rank", f"""select o_orderpriority as model, o_custkey as feature, {R('sum(cast(o_totalprice as decimal(18,2)))')} as importance,
  row_number() over (partition by o_orderpriority order by sum(cast(o_totalprice as decimal(18,2))) desc, o_custkey) as rank from orders group by 1, 2""")
def w17(s, d):
    from hourwatt.operators.ranking import rank_across_ranges

    totals = A.table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("model"), F.col("o_custkey").alias("feature")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("importance")
    )
    return rank_across_ranges(totals, ["model"], [F.desc("importance"), F.col("feature")])
