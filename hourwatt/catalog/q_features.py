"""Queries: calendar, gaps, lag and rolling features, the feature table and walk-forward splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourwatt import constants as C
from hourwatt.catalog import adapters as A
from hourwatt.catalog.registry import query
from hourwatt.catalog.sql_views import R, T
from hourwatt.operators import calendar, densify, trailing
from hourwatt.operators.calendar import TS
from hourwatt.operators.power_mix import add_power_mix
from hourwatt.operators.ranking import decision_date
from hourwatt.operators.walk_forward import assign_windows
from hourwatt.plans import features as P
from hourwatt.sources.dimensions import region_frame
from hourwatt.sources.payloads import hourly_mix

_calendar_sql = """hour({0})::int as hour, (isodow({0}) - 1)::int as day_of_week, month({0})::int as month, dayofyear({0})::int as day_of_year, isodow({0}) >= 6 as is_weekend,
  hour({0}) between 8 and 20 as is_peak_hour, hour({0}) between 6 and 9 as is_morning_ramp, hour({0}) between 17 and 20 as is_evening_peak, hour({0}) < 6 as is_overnight"""
_cyclic_sql = ", ".join(
    f"{R(f'{fn}(2 * pi() * {value} / {period})')} as {name}_{fn}"
    for name, value, period in (("hour", "hour({0})", "24"), ("day_of_year", "dayofyear({0})", "365.25"))
    for fn in ("sin", "cos")
)


@query("T04_calendar_features", f"select event_id, {_calendar_sql.format('ts')} from events")
def t04(s, d):
    wanted = [c for c in C.CALENDAR_COLUMNS if not c.endswith(("_sin", "_cos"))]
    return calendar.add_calendar(A.events(s, d), "ts").select("event_id", *wanted)


@query("T05_cyclic_features", f"select o_orderkey, {_cyclic_sql.format('o_orderdate')} from orders")
def t05(s, d):
    orders = A.table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias(TS))
    return calendar.add_calendar(orders).select("o_orderkey", "hour_sin", "hour_cos", "day_of_year_sin", "day_of_year_cos")


@query("T10_decision_date", "select event_id, strftime(ts, '%Y-%m-%d') as decision_date, 'constrained_window' as decision_group from events")
def t10(s, d):
    from hourwatt.operators.workload import CONSTRAINED_GROUP

    return A.events(s, d).select("event_id", decision_date(F.col("ts")).alias("decision_date"), F.lit(CONSTRAINED_GROUP).alias("decision_group"))


def _ranges(s, d, *keys):
    orders = A.table(s, d, "orders")
    return orders.groupBy(*keys).agg(F.to_date(F.min("o_orderdate")).alias("start_date"), F.to_date(F.max("o_orderdate")).alias("end_date"))


_ranges_sql = "select {0} min(o_orderdate)::date as a, max(o_orderdate)::date as b from orders {1}"
_dates = "strftime(x, '%Y-%m-%d')"


def _windows_sql(days: int, key: str = "", extra: str = "") -> str:
    group = f"group by {key}" if key else ""
    source = _ranges_sql.format(f"{key}," if key else "", group)
    k = f"{key}, " if key else ""
    return f"""select {k}{extra}strftime(w, '%Y-%m-%d') as window_start_date, strftime(least(w + interval {days - 1} days, b), '%Y-%m-%d') as window_end_date
      from (select {k}b, unnest(generate_series(a::timestamp, b::timestamp, interval {days} days)) as w from ({source}) r) t"""


@query("T06_date_windows", _windows_sql(7, "o_orderpriority"))
def t06(s, d):
    return calendar.date_windows(_ranges(s, d, "o_orderpriority"), 7).select("o_orderpriority", "window_start_date", "window_end_date")


def _years_sql(key: str = "", extra: str = "") -> str:
    group, k = (f"group by {key}", f"{key}, ") if key else ("", "")
    return f"""select {k}{extra}strftime(greatest(a, make_date(y, 1, 1)), '%Y-%m-%d') as window_start_date, strftime(least(b, make_date(y, 12, 31)), '%Y-%m-%d') as window_end_date
      from (select {k}a, b, unnest(generate_series(year(a), year(b))) as y from ({_ranges_sql.format(k, group)}) r) t"""


@query("T07_calendar_year_windows", _years_sql("o_orderstatus"))
def t07(s, d):
    return calendar.calendar_year_windows(_ranges(s, d, "o_orderstatus")).select("o_orderstatus", "window_start_date", "window_end_date")


_locations = ", ".join("('" + name.replace("'", "''") + "')" for name, *_ in C.REGIONAL_LOCATIONS)


@query("T08_backfill_plan", f"""{_windows_sql(7, extra="'mix_national' as dataset, 'FR' as region, ")}
union all {_windows_sql(7, extra="'mix_regional' as dataset, 'ALL_REGIONS' as region, ")}
union all {_years_sql(extra="'price_by_year' as dataset, 'FR' as region, ")}
union all {_windows_sql(365, extra="'price_fixed_length' as dataset, 'FR' as region, ")}
union all select 'weather', l.region, w.window_start_date, w.window_end_date from ({_windows_sql(31)}) w cross join (values {_locations}) l(region)""")
def t08(s, d):
    return calendar.backfill_plan(_ranges(s, d))


@query("P14_day_predicate", f"""select e.event_id, w.window_start_date from events e join ({_windows_sql(7).replace('orders', '(select ts as o_orderdate from events) o')}) w
on e.ts >= w.window_start_date::timestamp and e.ts < w.window_end_date::timestamp + interval 1 day""")
def p14(s, d):
    ev = A.events(s, d).select("event_id", "ts")
    span = ev.agg(F.to_date(F.min("ts")).alias("start_date"), F.to_date(F.max("ts")).alias("end_date"))
    # A month of events spans five weekly windows; the window of a day is an equi-key.
    windows = calendar.date_windows(span, 7).withColumn("day", F.explode(F.sequence("window_start_date", "window_end_date")))
    matched = ev.withColumn("day", F.to_date("ts")).join(windows, "day")
    inside = calendar.day_predicate(F.col("ts"), F.col("window_start_date"), F.col("window_end_date"))
    return matched.filter(inside).select("event_id", "window_start_date")


@query("T09_offset_timestamps", f"""select event_id, {T('ts')} as parsed_utc, case when event_type = 'error' then null else {T("ts - interval 2 hours")} end as parsed_offset from
  (select event_id, event_type, date_trunc('second', ts) as ts from events) e""")
def t09(s, d):
    from hourwatt.functions.text import parse_offset_timestamp

    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    # Text without an offset is rejected.
    suffix = F.when(F.col("event_type") != "error", "+02:00").otherwise("")
    return A.events(s, d).select(
        "event_id", parse_offset_timestamp(F.concat(stamp, F.lit("Z"))).alias("parsed_utc"),
        parse_offset_timestamp(F.concat(stamp, suffix)).alias("parsed_offset"),
    )


_bounds = "(select tech, min(h) as a, max(h) as b from v_ev group by 1)"
_expected = f"(select tech, unnest(generate_series(a, b, interval 1 hour)) as ts from {_bounds} r)"


@query("T01_densify_hourly", f"select x.tech as target, {T('x.ts')} as timestamp_utc, {R('m.mwh')} as mwh from {_expected} x left join v_mix_long m on m.target = x.tech and m.ts = x.ts")
def t01(s, d):
    return densify.densify_hourly(A.mix_long(s, d), ["target"])


@query("T02_expected_hours", f"select tech as target, {T('ts')} as timestamp_utc from {_expected} x")
def t02(s, d):
    return densify.expected_hours(A.mix_long(s, d), ["target"])


_gap = f"from {_expected} x left join v_mix_long m on m.target = x.tech and m.ts = x.ts where m.ts is null"


@query("T03_missing_hours", f"select x.tech as technology, {T('x.ts')} as timestamp_utc {_gap}")
def t03(s, d):
    return densify.missing_hours(A.events(s, d), ["technology"], "ts")


@query("J05_gap_anti_join", f"""select r.region, {T('r.ts')} as timestamp_utc from (select region, unnest(generate_series(min(h), max(h), interval 1 hour)) as ts from v_ev group by 1) r
where not exists (select 1 from v_ev e where e.region = r.region and e.h = r.ts)""")
def j05(s, d):
    return densify.missing_hours(A.events(s, d), ["region"], "ts")


@query("G06_missing_hour_counts", f"select x.tech as technology, count(*) as missing_hours {_gap} group by 1")
def g06(s, d):
    return densify.missing_hour_counts(A.events(s, d), ["technology"], ts="ts")


# Lag and rolling features of the series that grow with the data: one per user.

_user = """(select user_id, h as ts, cast(sum(cast(value as decimal(18,6))) as double) as v from v_ev group by 1, 2)"""
_user_dense = f"""(select g.user_id, g.ts, u.v, u.ts is not null as present from (select user_id, unnest(generate_series(min(ts), max(ts), interval 1 hour)) as ts from {_user} b group by 1) g
  left join {_user} u on u.user_id = g.user_id and u.ts = g.ts)"""


def user_series(s, d):
    exact = F.sum(F.col("value").cast("decimal(18,6)")).cast("double")
    return A.events(s, d).groupBy("user_id", F.date_trunc("hour", "ts").alias(TS)).agg(exact.alias("v"))


@query("W01_time_lags", f"""select user_id, {T('ts')} as timestamp_utc, {', '.join(f'{R(f"l{h}")} as v_lag_{h}h' for h in C.LAG_HOURS)} from (
  select *, {', '.join(f'lag(v, {h}) over (partition by user_id order by ts) as l{h}' for h in C.LAG_HOURS)} from {_user_dense} g) t where present""")
def w01(s, d):
    spread = trailing.with_halo(user_series(s, d), max(C.LAG_HOURS))
    lags = {f"v_lag_{h}h": trailing.lag_hours("v", h, ["user_id"]) for h in C.LAG_HOURS}
    return trailing.owned_rows(spread.withColumns(lags)).drop("v")


# The power sums (energy times four) have two digits, so no 24 h or 168 h mean ends in an exact half at
# the sixth digit and both engines round alike.
_dense_mix = f"(select x.tech as target, x.ts, m.mwh * 4 as v from {_expected} x left join v_mix_long m on m.target = x.tech and m.ts = x.ts)"


def power_series(s, d):
    return A.mix_long(s, d).select("target", TS, (F.col("mwh") * 4).alias("v"))


def _roll(fn, n, v="v"):
    frame = f"over (partition by target order by ts rows between {n} preceding and 1 preceding)"
    return f"case when count({v}) {frame} = {n} then {fn}({v}) {frame} end"


@query("W02_rolling_means", f"""select target, {T('ts')} as timestamp_utc, {R('m24')} as v_rolling_mean_24h, {R('m168')} as v_rolling_mean_168h from (
  select *, {_roll('avg', 24)} as m24, {_roll('avg', 168)} as m168 from {_dense_mix} g) t where v is not null""")
def w02(s, d):
    spread = trailing.with_halo(power_series(s, d), 168)
    means = {f"v_rolling_mean_{n}h": trailing.rolling("v", "mean", n, ["target"]) for n in C.MEAN_HOURS}
    return trailing.owned_rows(spread.withColumns(means)).drop("v")


@query("W03_rolling_spread", f"""select target, {T('ts')} as timestamp_utc, {R('s')} as v_rolling_std_24h, {R('lo')} as v_rolling_min_24h, {R('hi')} as v_rolling_max_24h from (
  select *, {_roll('stddev_samp', 24)} as s, {_roll('min', 24)} as lo, {_roll('max', 24)} as hi from {_dense_mix} g) t where v is not null""")
def w03(s, d):
    spread = trailing.with_halo(power_series(s, d), 24)
    stats = {f"v_rolling_{x}_24h": trailing.rolling("v", x, 24, ["target"]) for x in ("std", "min", "max")}
    return trailing.owned_rows(spread.withColumns(stats)).drop("v")


# The national feature table.

_targets = {"price": "price", "consumption": "consumption", "total_production": "production", **{t: t for t in A.TECH_SOURCES}}


def _series_sql(order: str = "order by ts") -> str:
    """Densified national series with every lag and rolling feature, from row offsets."""
    parts = []
    for prefix, v in _targets.items():
        frame = {n: f"over ({order} rows between {n} preceding and 1 preceding)" for n in (24, 168)}
        parts += [f"lag({v}, {h}) over ({order}) as {prefix}_lag_{h}h" for h in C.LAG_HOURS]
        parts += [f"case when count({v}) {frame[n]} = {n} then avg({v}) {frame[n]} end as {prefix}_rolling_mean_{n}h" for n in C.MEAN_HOURS]
        for stat, fn in (("std", "stddev_samp"), ("min", "min"), ("max", "max")):
            parts.append(f"case when count({v}) {frame[24]} = 24 then {fn}({v}) {frame[24]} end as {prefix}_rolling_{stat}_24h")
    return f"""select *, {', '.join(parts)} from (select g.ts, p.price, m.consumption * 4 as consumption, m.production * 4 as production, {', '.join(f'm.{t} * 4 as {t}' for t in A.TECH_SOURCES)}, p.ts is not null as present,
      w.t, w.tmin, w.tmax, w.app, w.rad, w.total from (select unnest(generate_series(min(ts), max(ts), interval 1 hour)) as ts from v_price) g
      left join v_price p on p.ts = g.ts left join v_mix m on m.ts = g.ts left join v_weather_agg w on w.ts = g.ts) d"""


def _feature_expressions() -> dict[str, str]:
    out = {"price_eur_mwh": "price", "consumption_mwh": "consumption", "total_production_mwh": "production"}
    for name in C.MIX_COLUMNS[2:]:
        out[name] = name[:-4] if name[:-4] in A.TECH_SOURCES else "null"
    fossil = "coalesce(gas, 0) + coalesce(coal, 0)"
    renewable = "coalesce(wind, 0) + coalesce(solar, 0)"
    out |= {
        "renewable_mwh": renewable, "fossil_mwh": fossil, "renewable_share": f"({renewable}) / nullif(production, 0)",
        "nuclear_share": "nuclear / nullif(production, 0)", "fossil_share": f"({fossil}) / nullif(production, 0)",
        "residual_demand_mwh": "consumption - coalesce(wind, 0) - coalesce(solar, 0)", "supply_demand_gap_mwh": "production - consumption",
        "avg_temperature_c": "t", "min_temperature_c": "tmin", "max_temperature_c": "tmax", "avg_apparent_temperature_c": "app", "avg_wind_speed_mps": "t",
        "avg_wind_speed_80m_mps": "app", "avg_shortwave_radiation_wm2": "rad", "avg_cloud_cover_pct": "app", "avg_precipitation_mm": "t",
        "total_precipitation_mm": "total", "avg_surface_pressure_hpa": "app + 950",
    }
    for prefix in ("price", "consumption", "total_production", *C.GENERATION_SOURCES):
        known = prefix in _targets
        for name in C.lag_feature_names(prefix):
            out[name] = name if known else "null"
        if known:
            out[f"{prefix}_rolling_range_24h"] = f"{prefix}_rolling_max_24h - {prefix}_rolling_min_24h"
            out[f"{prefix}_lag_1h_to_24h"] = f"{prefix}_lag_1h - {prefix}_lag_24h"
            out[f"{prefix}_lag_24h_to_168h"] = f"{prefix}_lag_24h - {prefix}_lag_168h"
    out["price_lag_168h_to_336h"] = "price_lag_168h - price_lag_336h"
    out["price_vs_rolling_mean_24h"] = "price_lag_1h - price_rolling_mean_24h"
    level = {}
    for h in (24, 168):
        variable = f"coalesce(wind_lag_{h}h, 0) + coalesce(solar_lag_{h}h, 0)"
        level[h] = (f"(consumption_lag_{h}h - coalesce(wind_lag_{h}h, 0) - coalesce(solar_lag_{h}h, 0))", f"({variable})")
        out[f"residual_demand_lag_{h}h"], out[f"variable_renewable_lag_{h}h"] = level[h]
    out["residual_demand_lag_24h_to_168h"] = f"{level[24][0]} - {level[168][0]}"
    out["variable_renewable_lag_24h_to_168h"] = f"{level[24][1]} - {level[168][1]}"
    return out


_expr = _feature_expressions()
_required = " and ".join(f"({_expr[c]}) is not null" for c in C.REQUIRED_MODELING_COLUMNS)


def _features_sql(columns: list[str], where: str) -> str:
    calendar_columns = set(C.CALENDAR_COLUMNS)
    selected = [f"{R(_expr[c])} as {c}" for c in columns if c not in calendar_columns and c != TS]
    extra = [_calendar_sql.format("ts"), _cyclic_sql.format("ts")] if calendar_columns & set(columns) else []
    return f"select {T('ts')} as timestamp_utc, {', '.join([*selected, *extra])} from ({_series_sql()}) f where present and {where}"


def base(s, d):
    """Joined national rows; the records count as hourly power, so energy has two digits."""
    mix = hourly_mix(A.records(s, d), C.NATIONAL_SCOPE, interval_hours="1.00")
    return P.price_mix_weather(A.price_table(s, d), mix, P.compact_weather(A.weather_rows(s, d)))


@query("C01_feature_table", _features_sql(C.modeling_columns(), _required))
def c01(s, d):
    return P.modeling_features(base(s, d))


@query("P01_feature_projection", _features_sql([c for c in C.modeling_columns() if c.startswith(("hour", "day_", "month", "is_", "price_", TS)) or c in C.CALENDAR_COLUMNS], _required))
def p01(s, d):
    wanted = [c for c in C.modeling_columns() if c.startswith(("hour", "day_", "month", "is_", "price_", TS)) or c in C.CALENDAR_COLUMNS]
    return P.modeling_features(base(s, d)).select(*wanted)


_spreads = [c for c in C.modeling_columns() if c.endswith(("_rolling_range_24h", "_lag_1h_to_24h", "_lag_24h_to_168h", "_168h_to_336h", "_vs_rolling_mean_24h")) and c.startswith(("price", "consumption", "wind"))]


def _with_lags(s, d):
    typed = base(s, d)
    typed = typed.select(TS, *[F.col(c).cast("double").alias(c) for c in typed.columns if c != TS])
    return trailing.add_trailing_features(typed)


@query("W04_feature_spreads", _features_sql(_spreads, "true"))
def w04(s, d):
    return _with_lags(s, d).select(TS, *_spreads)


@query("W05_residual_demand_lags", _features_sql(C.DEMAND_CONTRASTS, "true"))
def w05(s, d):
    return _with_lags(s, d).select(TS, *C.DEMAND_CONTRASTS)


_usable = " and ".join(f"({_expr[c]}) is not null" for c in ["price_eur_mwh", *C.base_price_features()] if c not in C.CALENDAR_COLUMNS)
_w06 = ["price_lag_24h", "price_rolling_std_24h", "consumption_lag_24h_to_168h", "residual_demand_lag_24h"]


@query("W06_complete_older_export", _features_sql(_w06, _usable).replace(R(_expr["price_lag_24h"]), R("-1")))
def w06(s, d):
    export = base(s, d)
    export = export.select(TS, *[F.col(c).cast("double").alias(c) for c in export.columns if c != TS])
    # A column the export already has is kept as it is, even when it differs from what would be derived.
    return P.complete_features(export.withColumn("price_lag_24h", F.lit(-1.0))).select(TS, *_w06)


@query("P02_power_mix", _features_sql(list(C.POWER_MIX_COLUMNS), "true"))
def p02(s, d):
    typed = base(s, d)
    typed = typed.select(TS, *[F.col(c).cast("double").alias(c) for c in typed.columns if c != TS])
    return add_power_mix(typed).select(TS, *C.POWER_MIX_COLUMNS)


@query("P03_required_columns", _features_sql(["price_eur_mwh"], _required))
def p03(s, d):
    return P.modeling_features(base(s, d)).select(TS, "price_eur_mwh")


@query("P05_numeric_coercion", f"select event_id, case when event_type = 'error' then null else {R('value')} end as number from events")
def p05(s, d):
    from hourwatt.functions.numeric import to_double

    text = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return A.events(s, d).select("event_id", to_double(text).alias("number"))


@query("J01_price_mix_join", f"select {T('p.ts')} as timestamp_utc, {R('p.price')} as price_eur_mwh, {R('m.consumption * 4')} as consumption_mwh, {R('m.production * 4')} as total_production_mwh from v_price p join v_mix m on m.ts = p.ts")
def j01(s, d):
    return base(s, d).select(TS, "price_eur_mwh", "consumption_mwh", "total_production_mwh")


_weather_agg = {
    "avg_temperature_c": "t", "min_temperature_c": "tmin", "max_temperature_c": "tmax", "avg_apparent_temperature_c": "app", "avg_wind_speed_mps": "t",
    "avg_wind_speed_80m_mps": "app", "avg_shortwave_radiation_wm2": "rad", "avg_cloud_cover_pct": "app", "avg_precipitation_mm": "t",
    "total_precipitation_mm": "total", "avg_surface_pressure_hpa": "app + 950",
}
_weather_sql = ", ".join(f"{R(v)} as {k}" for k, v in _weather_agg.items())


@query("J02_weather_join", f"select {T('p.ts')} as timestamp_utc, {R('p.price')} as price_eur_mwh, {_weather_sql} from v_price p left join v_weather_agg w on w.ts = p.ts")
def j02(s, d):
    return base(s, d).select(TS, "price_eur_mwh", *C.WEATHER_AGG_COLUMNS)


@query("G01_compact_weather", f"select {T('ts')} as timestamp_utc, {_weather_sql} from v_weather_agg")
def g01(s, d):
    return P.compact_weather(A.weather_rows(s, d))


@query("G02_hourly_mean_price", f"select event_type, {T('h')} as timestamp_utc, {R('avg(case when k >= 10 then value end)')} as price_eur_mwh from v_ev group by 1, h")
def g02(s, d):
    # Missing sub-hourly prices are skipped.
    ev = A.events(s, d).withColumn("price", F.when(F.col("k") >= 10, F.col("value")))
    return ev.groupBy("event_type", F.date_trunc("hour", "ts").alias(TS)).agg(F.avg("price").alias("price_eur_mwh"))


_view_mix = """(select region, 'national' as scope, ts, consumption, production, nuclear, rate from v_mix
  union all select region, 'regional', ts, consumption, production, nuclear, rate from v_mix_regional)"""
_view_weather = "(select region, h as ts, avg(value) as temperature, avg(k) as cloud from v_ev group by 1, 2)"


@query("J03_hourly_features_view", f"""select m.region, m.scope, {T('m.ts')} as timestamp_utc, {R('p.price')} as price_eur_mwh, {R('m.consumption')} as consumption_mwh,
  {R('m.production')} as total_production_mwh, {R('m.nuclear')} as nuclear_mwh, {R('m.rate')} as carbon_intensity_gco2_kwh, {R('w.temperature')} as temperature_c,
  {R('w.cloud')} as cloud_cover_pct from {_view_mix} m left join v_price p on p.ts = m.ts left join {_view_weather} w on w.region = m.region and w.ts = m.ts""")
def j03(s, d):
    rec = A.records(s, d)
    mix = hourly_mix(rec, C.NATIONAL_SCOPE).unionByName(hourly_mix(rec, C.REGIONAL_SCOPE), allowMissingColumns=True)
    view = P.hourly_features_view(mix, A.price_table(s, d), A.weather_hourly(s, d))
    return view.select(
        "region", "scope", TS, "price_eur_mwh", "consumption_mwh", "total_production_mwh", "nuclear_mwh", "carbon_intensity_gco2_kwh", "temperature_c", "cloud_cover_pct"
    )


@query("S18_region_dimension", """select e.region, count(*) as event_count, max(l.city) as city, max(l.latitude) as latitude, max(l.longitude) as longitude from v_ev e join (values """
       + ", ".join("('{}', '{}', {}::double, {}::double)".format(r.replace("'", "''"), c, la, lo) for r, c, la, lo in C.REGIONAL_LOCATIONS)
       + """) l(region, city, latitude, longitude) on l.region = e.region group by 1""")
def s18(s, d):
    ev = A.events(s, d).groupBy("region").agg(F.count("*").alias("event_count"))
    return ev.join(F.broadcast(region_frame(s)), "region")


@query("J06_window_range_join", """select w.win as "window", r.role, count(*) as rows, sum(e.k) as total from v_ev e join v_windows w on true
join (values ('train'), ('test')) r(role) on (r.role = 'train' and e.ts between w.train_start and w.train_end) or (r.role = 'test' and e.ts between w.test_start and w.test_end) group by 1, 2""")
def j06(s, d):
    rows = assign_windows(A.events(s, d).select("ts", "k"), A.WINDOWS, "ts")
    return rows.groupBy("window", "role").agg(F.count("*").alias("rows"), F.sum("k").alias("total"))


@query("P07_train_test_split", """select w.win as "window", (select count(*) from v_price p where p.ts between w.train_start and w.train_end) as train_rows,
(select count(*) from v_price p where p.ts between w.test_start and w.test_end) as test_rows from v_windows w""")
def p07(s, d):
    from functools import reduce

    from hourwatt.operators.walk_forward import split_window

    prices = A.price_by(s, d)
    parts = []
    for window in A.WINDOWS:
        train, test = split_window(prices, window)
        counts = train.select(F.lit(1).alias("t"), F.lit(0).alias("v")).unionByName(test.select(F.lit(0).alias("t"), F.lit(1).alias("v")))
        parts.append(counts.agg(F.sum("t").cast("bigint").alias("train_rows"), F.sum("v").cast("bigint").alias("test_rows")).select(F.lit(window.name).alias("window"), "*"))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("P06_constant_filters", f"""select 'price' as table_name, count(*) as rows from v_price union all select 'mix', count(*) from v_mix_regional where region in ('Bretagne', 'Normandie')
union all select 'targets', count(*) from v_mix_long where target in ('gas', 'coal')""")
def p06(s, d):
    prices = A.price_table(s, d).filter((F.col("region") == "FR") & (F.col("market") == C.DAY_AHEAD_MARKET))
    mix = hourly_mix(A.records(s, d), C.REGIONAL_SCOPE).filter(F.col("region").isin("Bretagne", "Normandie") & (F.col("scope") == C.REGIONAL_SCOPE))
    targets = A.mix_long(s, d).filter(F.col("target").isin("gas", "coal"))
    from hourwatt.sources.tables import load_summary

    return load_summary({"price": prices, "mix": mix, "targets": targets}).withColumnRenamed("row_count", "rows")


@query("P15_target_feature_names", _features_sql(C.lag_feature_names("gas"), _required))
def p15(s, d):
    names = [c for c in C.target_features("gas") if c not in C.CALENDAR_COLUMNS]
    return P.modeling_features(base(s, d)).select(TS, *names)
