"""Queries: streaming twins of the batch operators, run to the end of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourwatt import constants as C
from hourwatt.catalog import adapters as A
from hourwatt.catalog.registry import query
from hourwatt.catalog.sql_views import R, T
from hourwatt.operators.calendar import TS
from hourwatt.session import prepare_session, scratch_path
from hourwatt.streaming import energy as E


def event_stream(s, d):
    schema = A.table(s, d, "events").schema
    ev = E.read_folder(prepare_session(s), f"{d}/events.parquet*", schema)
    return ev.withColumns(
        {"technology": A.technology(F.col("event_type")), "region": A.region_name(F.col("user_id")), "k": F.from_json("props", "k int")["k"]}
    )


def record_stream(s, d):
    return event_stream(s, d).select(
        "ts", F.col("region").alias("libelle_region"), F.col("k").alias("consommation"), F.col("k").alias("taux_co2"),
        *[F.when(F.col("technology") == tech, F.col("value")).alias(field) for tech, field in A.RECORD_FIELD.items()],
    )


_closed = "(select max(ts) - interval 10 minutes from events)"


@query("ST01_hourly_mix_stream", f"""select region, {T('ts')} as timestamp_utc, {R('consumption')} as consumption_mwh, {R('nuclear')} as nuclear_mwh, {R('wind')} as wind_mwh,
  {R('production')} as total_production_mwh, {R('rate')} as carbon_intensity_gco2_kwh from v_mix_regional where ts + interval 1 hour <= {_closed}""")
def st01(s, d):
    hourly = E.hourly_mix_stream(record_stream(s, d), C.REGIONAL_SCOPE)
    out = E.run_to_parquet(hourly, "hourly-mix")
    return out.select("region", TS, "consumption_mwh", "nuclear_mwh", "wind_mwh", "total_production_mwh", "carbon_intensity_gco2_kwh")


@query("ST02_distinct_stream", "select event_id, region, k from v_ev")
def st02(s, d):
    # Every record is sent twice.
    twice = event_stream(s, d).withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2))))
    return E.run_to_parquet(E.distinct_records(twice, ["event_id"]).select("event_id", "region", F.col("k").cast("bigint").alias("k")), "distinct")


@query("ST03_upsert_stream", f"""select region, {T('h')} as timestamp_utc, {R('arg_max(value, (ts, event_id))')} as value from v_ev group by region, h""")
def st03(s, d):
    rows = event_stream(s, d).select(
        "region", F.date_trunc("hour", "ts").alias(TS), "value", "event_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day")
    )
    root = scratch_path(s, "upsert")
    E.upsert_stream(rows, f"{root}/table", "day", ["region", TS], [F.desc("ts"), F.desc("event_id")], f"{root}/state")
    return s.read.parquet(f"{root}/table").select("region", TS, "value")


@query("ST04_sliding_day_mean", f"""with s as (select target, ts, mwh * 4 as v from v_mix_long), e as (select target, unnest(generate_series(min(ts) + interval 1 hour, max(ts) + interval 24 hours, interval 1 hour)) as ts from s group by 1)
select e.target, {T('e.ts')} as timestamp_utc, {R('avg(s.v)')} as rolling_mean_24h, count(s.v) as hours_present from e join s on s.target = e.target and s.ts >= e.ts - interval 24 hours and s.ts < e.ts
where e.ts <= (select max(ts) - interval 1 hour from s) group by e.target, e.ts""")
def st04(s, d):
    landed = scratch_path(s, "hours")
    A.mix_long(s, d).select("target", TS, (F.col("mwh") * 4).alias("v")).write.parquet(landed)
    hours = E.read_folder(s, landed, s.read.parquet(landed).schema)
    return E.run_to_parquet(E.sliding_day_mean(hours, "v", ["target"]), "day-mean")


@query("ST05_coverage_islands", f"""select target, {T('min(ts)')} as first_hour, {T('max(ts)')} as last_hour, count(*) as hours from (
  select *, sum(new_island) over (partition by target order by ts) as island from (
    select target, ts, case when ts - lag(ts) over (partition by target order by ts) = interval 1 hour then 0 else 1 end as new_island from v_mix_long) a) b group by target, island""")
def st05(s, d):
    return E.coverage_islands(A.mix_long(s, d), ["target"])


@query("ST05b_coverage_stream", f"""select target, {T('min(ts)')} as first_hour, {T('max(ts)')} as last_hour, count(*) as hours from (
  select *, sum(new_island) over (partition by target order by ts) as island from (
    select target, ts, case when ts - lag(ts) over (partition by target order by ts) = interval 1 hour then 0 else 1 end as new_island from v_mix_long) a) b
group by target, island having max(ts) + interval 90 minutes <= (select max(ts) - interval 1 hour from v_mix_long)""")
def st05b(s, d):
    """The islands that the watermark has closed; the open ones are the stream's tail."""
    landed = scratch_path(s, "island-hours")
    A.mix_long(s, d).select("target", TS).write.parquet(landed)
    hours = E.read_folder(s, landed, s.read.parquet(landed).schema)
    return E.run_to_parquet(E.coverage_islands(hours, ["target"], delay="1 hour"), "islands")
