"""Queries: scans, payload parsers, sinks read back, and incremental loads."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F
from pyspark.sql import types as PT

from hourwatt import constants as C
from hourwatt import schemas
from hourwatt.catalog import adapters as A
from hourwatt.catalog.registry import query
from hourwatt.catalog.sql_views import H, ISO, R, T
from hourwatt.operators import ingestion, metrics
from hourwatt.operators.calendar import TS
from hourwatt.plans import ingestion as load_plan
from hourwatt.session import scratch_path
from hourwatt.sources import payloads, tables

PRICE_CSV = PT.StructType([PT.StructField(TS, PT.TimestampType()), PT.StructField("price_eur_mwh", PT.DoubleType())])


@query("S01_csv_scan", f"select {T('ts')} as timestamp_utc, {R('price')} as price_eur_mwh from v_price")
def s01(s, d):
    path = scratch_path(s, "prices-csv")
    tables.write_csv(A.price_by(s, d), path)
    return tables.read_csv(s, path, PRICE_CSV)


@query("S02_table_scan", "select event_id, value from events where event_type = 'purchase'")
def s02(s, d):
    return tables.read_table(s, f"{d}/events.parquet", ["event_id", "value"], F.col("event_type") == "purchase")


_zone = f"'energy-charts:FR:' || {ISO.format('h')}"


@query("S04_price_payloads", f"""select 'api' as source, {_zone} as source_record_id, 'FR' as region, {T('h')} as timestamp_utc, '1h' as granularity, 'day_ahead' as market,
  {R('round(cast(sum(cast(value as decimal(18,6))) as double) / count(*), 6)')} as price_eur_mwh, 'EUR' as currency from v_ev where event_type <> 'error' group by h""")
def s04(s, d):
    return payloads.parse_price_pages(A.broken_too(A.price_pages(s, d)), on_invalid="skip")


_last = "row_number() over (partition by region, event_id // 100 order by ts desc) = 1"


@query("S05_weather_payloads", f"""select region, {T('ts')} as timestamp_utc, {R('value')} as temperature_c, k::double as relative_humidity_2m_pct, k::double as humidity_pct,
  {R("case when event_type <> 'error' then value end")} as shortwave_radiation_wm2, {R("case when event_type <> 'error' then value end")} as solar_irradiance_wm2,
  {R(f'case when last_of_page then null else value end')} as wind_speed_mps, null::double as rain_mm, k::int as weather_code,
  'open-meteo:' || region || ':' || {ISO.format('ts')} as source_record_id from (select *, {_last} as last_of_page from v_ev) e""")
def s05(s, d):
    rows = payloads.parse_weather_pages(A.broken_too(A.weather_pages(s, d)), on_invalid="skip")
    return rows.select(
        "region", TS, "temperature_c", "relative_humidity_2m_pct", "humidity_pct", "shortwave_radiation_wm2", "solar_irradiance_wm2", "wind_speed_mps", "rain_mm",
        "weather_code", "source_record_id",
    )


@query("S06_price_xml", f"""select 'entsoe:10YFR-RTE------C:' || {ISO.format('ts')} as source_record_id, {T('ts')} as timestamp_utc, {R('value')} as price_eur_mwh from (
  select event_type, value, start + to_minutes(cast(minutes * (pos - 1) as bigint)) as ts from (select event_type, value, row_number() over (partition by event_id // 100 order by event_id) as pos,
    min(h) over (partition by event_id // 100) as start, case (event_id // 100) % 3 when 0 then 15 when 1 then 30 else 60 end as minutes from v_ev) p) q where event_type <> 'error'""")
def s06(s, d):
    rows = payloads.parse_price_xml_pages(A.broken_too(A.xml_pages(s, d)), "10YFR-RTE------C", on_invalid="skip")
    return rows.select("source_record_id", TS, "price_eur_mwh")


@query("S08_raw_page_append", "select 'energy_charts' as source_name, count(distinct event_id // 100) as pages from events union all select 'odre', count(distinct event_id // 100) from events")
def s08(s, d):
    path = scratch_path(s, "raw-pages")
    tables.append_raw_pages(A.price_pages(s, d), path)
    tables.append_raw_pages(A.record_pages(s, d), path)
    return s.read.parquet(path).groupBy("source_name").agg(F.count("*").alias("pages"))


@query("S09_record_extraction", "select event_id, k as consommation, region as libelle_region from v_ev")
def s09(s, d):
    rows = payloads.extract_records(A.broken_too(A.record_pages(s, d)), on_invalid="skip")
    parsed = rows.select(F.from_json("record", "event_id bigint, consommation bigint, libelle_region string").alias("r"))
    return parsed.select("r.*")


@query("P11_null_records", f"select {T('ts')} as timestamp_utc, case when p.target = 'wind' then null else {R('mwh')} end as mwh from v_mix_long p")
def p11(s, d):
    values = A.mix_long(s, d).withColumn("mwh", F.when(F.col("target") == "wind", F.lit(float("nan"))).otherwise(F.col("mwh"))).select(TS, "mwh")
    return tables.nan_to_null_record(values).select("record.*")


@query("P16_stored_text", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(cast(l_extendedprice as decimal(18,2)) as varchar) as amount from lineitem")
def p16(s, d):
    rows = A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    return tables.to_stored_text(rows)


@query("F09_decimal_parse", f"select event_id, case when event_type in ('error', 'view') then null else {R('value')} end as amount from events")
def f09(s, d):
    from hourwatt.functions.numeric import parse_decimal

    text = F.when(F.col("event_type") == "error", F.lit("")).when(F.col("event_type") != "view", F.col("value").cast("string"))
    return A.events(s, d).select("event_id", parse_decimal(text).alias("amount"))


@query("F10_metric_names", "select distinct lower(translate(o_orderpriority || ' a/b:c', ' /-:', '____')) as metric_name from orders")
def f10(s, d):
    from hourwatt.functions.text import metric_name

    return A.table(s, d, "orders").select(metric_name(F.concat("o_orderpriority", F.lit(" a/b:c"))).alias("metric_name")).distinct()


@query("S12_csv_sink", """select win as "window", model, count(*) as rows from v_price_pred group by 1, 2""")
def s12(s, d):
    path = scratch_path(s, "predictions-csv")
    predictions = A.price_pred(s, d)
    tables.write_csv(predictions, path)
    return tables.read_csv(s, path, predictions.schema).groupBy("window", "model").agg(F.count("*").alias("rows"))


def _summary(s, d):
    by_window = metrics.regression_metrics(A.price_pred(s, d), "actual_price_eur_mwh", "predicted_price_eur_mwh", ["window", "model"])
    return metrics.mean_over_windows(by_window, ["model"])


_summary_sql = f"select model, {R('mae')} as mae, {R('rmse')} as rmse, {R('smape')} as smape, {R('da')} as directional_accuracy from v_reg_summary"


@query("S13_json_sink", _summary_sql)
def s13(s, d):
    path = scratch_path(s, "summary-json")
    summary = _summary(s, d)
    tables.write_json(summary, path)
    return s.read.schema(summary.schema).json(path)


@query("S17_json_report_scan", _summary_sql)
def s17(s, d):
    path = scratch_path(s, "report-json")
    summary = _summary(s, d)
    # One row per model: the report document is a handful of rows.
    document = summary.agg(F.collect_list(F.struct(*summary.columns)).alias("summary"))
    tables.write_json(document, path)
    fields = "model string, mae double, rmse double, smape double, directional_accuracy double"
    report = tables.read_json_report(s, path, schema=fields)
    return report.unionByName(tables.read_csv(s, f"{path}-absent", summary.schema, optional=True))


@query("S15_file_manifest")
def s15(s, d):
    names = [f"{t}.parquet" for t in ("events", "orders", "lineitem", "not_delivered")]
    return tables.file_manifest(s, d, names)


# Which technology's checkpoints stand for which dataset, so that the states of all five are used.
STATE_OF = {
    "nuclear": ("energy_charts", C.PRICE_DATASET), "gas": ("odre", C.NATIONAL_DATASET), "coal": ("odre", C.REGIONAL_DATASET),
    "solar": ("odre", C.NATIONAL_PROVISIONAL_DATASET), "wind": ("open_meteo", C.WEATHER_DATASET),
}
BROKEN_PRICE, BROKEN_WEATHER, PROVISIONAL_FROM = 7, 11, "2024-01-20"


def landed_pages(s, d):
    """Pages of one day each of all sources, with their ingestion window; some price and weather pages break off."""
    ev = A.events(s, d).withColumns({"day": F.to_date("ts"), "page": F.floor(F.col("event_id") / A.PAGE_RECORDS)})
    price = F.struct("ts", "event_id", F.unix_seconds("ts").alias("s"), F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    prices = ev.groupBy("day", "page").agg(F.sort_array(F.collect_list(price)).alias("p")).select(
        "day", "page", F.lit(C.NATIONAL_REGION).alias("region"),
        F.to_json(F.struct(F.lit(C.PRICE_UNIT).alias("unit"), F.col("p.s").alias("unix_seconds"), F.col("p.v").alias("price")), {"ignoreNullFields": "false"}).alias("payload"),
    )
    weather = ev.groupBy("day", "page", "region").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("t"), "value"))).alias("p")).select(
        "day", "page", "region", F.to_json(F.struct(F.struct(F.col("p.t").alias("time"), F.col("p.value").alias("temperature_2m")).alias("hourly"))).alias("payload"),
    )

    def records(rows, added):
        point = F.struct(
            "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("date_heure"), F.col("region").alias("libelle_region"),
            (F.col("k") + added).alias("consommation"), F.col("k").alias("taux_co2"),
            *[F.when(F.col("technology") == tech, F.col("value")).alias(name) for tech, name in A.RECORD_FIELD.items()],
        )
        listed = rows.groupBy("day", "page").agg(F.to_json(F.struct(F.sort_array(F.collect_list(point)).alias("results"))).alias("payload"))
        return listed.select("day", "page", F.lit(load_plan.ALL_REGIONS).alias("region"), "payload")

    def cut(pages, every):
        half = F.expr("substring(payload, 1, cast(length(payload) / 2 as int))")
        return pages.withColumn("payload", F.when(F.col("page") % every == 3, half).otherwise(F.col("payload")))

    def named(pages, source, dataset):
        return pages.select(
            F.lit(source).alias("source_name"), F.lit(dataset).alias("dataset_name"), "region", F.col("day").alias("window_start_date"),
            F.col("day").alias("window_end_date"), F.col("day").cast("timestamp").alias("page_ts"), F.col("payload").alias("response_payload"),
        )

    national = named(records(ev, 0).withColumn("region", F.lit(C.NATIONAL_REGION)), "odre", C.NATIONAL_DATASET)
    provisional = records(ev.where(F.col("day") >= F.lit(PROVISIONAL_FROM).cast("date")), 1).withColumn("region", F.lit(C.NATIONAL_REGION))
    pages = [
        named(cut(prices, BROKEN_PRICE), "energy_charts", C.PRICE_DATASET), national, named(records(ev, 0), "odre", C.REGIONAL_DATASET),
        named(provisional, "odre", C.NATIONAL_PROVISIONAL_DATASET), named(cut(weather, BROKEN_WEATHER), "open_meteo", C.WEATHER_DATASET),
    ]
    return functools.reduce(lambda a, b: a.unionByName(b), pages)


def _load(s, d):
    pages = landed_pages(s, d)
    plan = pages.select(*ingestion.WINDOW_KEY).distinct()
    names = F.create_map(*[x for tech, (source, dataset) in STATE_OF.items() for x in (F.lit(tech), F.struct(F.lit(source).alias("source_name"), F.lit(dataset).alias("dataset_name")))])
    state = A.checkpoints(s, d).withColumn("_of", names[F.col("region")]).drop("source_name", "dataset_name", "region").select("_of.*", "*").drop("_of")
    place = ["source_name", "dataset_name", "window_start_date", "window_end_date"]
    checkpoints = plan.join(state, place).select(*[f.name for f in schemas.CHECKPOINTS.fields])
    empty = {"prices": schemas.PRICES, "mix": schemas.MIX, "weather": schemas.WEATHER}
    tables = {name: s.createDataFrame([], schema) for name, schema in empty.items()}
    return load_plan.incremental_load(pages, plan, checkpoints, tables, F.lit("2024-02-01 00:00:00").cast("timestamp"))


_datasets = ", ".join(f"('{tech}', '{source}', '{dataset}')" for tech, (source, dataset) in STATE_OF.items())
LOADED = f"""names(tech, source_name, dataset_name) as (values {_datasets}),
t as (select tech, h::date as day, count(distinct h) as hours, count(*) as n from v_ev group by 1, 2),
e as (select *, h::date as day, event_id // {A.PAGE_RECORDS} as page from v_ev),
w as (
  select '{C.PRICE_DATASET}' as dataset_name, '{C.NATIONAL_REGION}' as region, day, count(distinct h) filter (tech <> 'coal') as n, bool_or(page % {BROKEN_PRICE} = 3) as broken from e group by day
  union all select '{C.NATIONAL_DATASET}', '{C.NATIONAL_REGION}', day, count(distinct h), false from e group by day
  union all select '{C.REGIONAL_DATASET}', '{load_plan.ALL_REGIONS}', day, count(distinct (region, h)), false from e group by day
  union all select '{C.NATIONAL_PROVISIONAL_DATASET}', '{C.NATIONAL_REGION}', day, count(distinct h), false from e where day >= date '{PROVISIONAL_FROM}' group by day
  union all select '{C.WEATHER_DATASET}', region, day, count(distinct date_trunc('second', ts)), bool_or(page % {BROKEN_WEATHER} = 3) from e group by region, day),
windows as (select source_name, w.*, coalesce(t.hours = 24, false) as known, t.n as before from w join names using (dataset_name) left join t on t.tech = names.tech and t.day = w.day)"""


@query("C08_incremental_load", f"""with {LOADED}
select source_name, dataset_name, region, strftime(day, '%Y-%m-%d') as window_start_date, case when known or not broken then 'completed' else 'failed' end as status,
  case when known then before when broken then 0 else n end as rows_loaded, broken and not known as has_reason from windows""")
def c08(s, d):
    return _load(s, d).checkpoints.select(*ingestion.WINDOW_KEY[:4], "status", "rows_loaded", F.col("error_message").isNotNull().alias("has_reason"))


@query("C08b_loaded_mix", f"""with {LOADED},
due as (select dataset_name, region, day from windows where not known and not broken),
price as (select 'prices' as "table", '{C.NATIONAL_REGION}' as region, p.ts, p.price as value from
    (select h as ts, cast(sum(cast(value as decimal(18,6))) as double) / count(value) as price from v_ev where tech <> 'coal' group by 1) p join due on due.day = p.ts::date and dataset_name = '{C.PRICE_DATASET}'),
mix as (select 'mix' as "table", due.region, e.h as ts, sum(case dataset_name when '{C.NATIONAL_PROVISIONAL_DATASET}' then k + 1 else k end * 0.25) as value, dataset_name
    from e join due using (day) where dataset_name in ('{C.NATIONAL_DATASET}', '{C.NATIONAL_PROVISIONAL_DATASET}') group by 2, 3, 5),
regional as (select 'mix' as "table", e.region, e.h as ts, sum(k * 0.25) as value from e join due using (day) where dataset_name = '{C.REGIONAL_DATASET}' group by 2, 3)
select "table", region, {T('ts')} as timestamp_utc, {R('value')} as value from price
union all select "table", region, {T('ts')}, {R('value')} from regional
union all select "table", region, {T('ts')}, {R("arg_max(value, dataset_name)")} from mix group by 1, 2, mix.ts""")
def c08b(s, d):
    """Prices and consumption as loaded; the provisional national values win where their windows were loaded too."""
    loaded = _load(s, d).tables
    prices = loaded["prices"].select(F.lit("prices").alias("table"), "region", TS, F.col("price_eur_mwh").cast("double").alias("value"))
    return prices.unionByName(loaded["mix"].select(F.lit("mix").alias("table"), "region", TS, F.col("consumption_mwh").cast("double").alias("value")))


@query("C08c_loaded_rows", f"""with {LOADED}
select case when dataset_name = '{C.PRICE_DATASET}' then 'prices' when dataset_name = '{C.WEATHER_DATASET}' then 'weather' else 'mix' end as "table",
  source_name, dataset_name, sum(n)::bigint as rows_loaded from windows where not known and not broken group by all having sum(n) > 0""")
def c08c(s, d):
    return load_plan.load_summary(_load(s, d).rows)


@query("C09_fetch_window", f"""with e as (select *, h::date as day, event_id // {A.PAGE_RECORDS} as page from v_ev where h >= timestamp '2024-01-08' and h < timestamp '2024-01-15'),
bad as (select distinct day from e where page % {BROKEN_PRICE} = 3), wet as (select distinct day, region from e where page % {BROKEN_WEATHER} = 3)
select 'prices' as "table", '{C.NATIONAL_REGION}' as region, strftime(day, '%Y-%m-%d') as day, count(distinct h) as n from e where tech <> 'coal' and not (page % {BROKEN_PRICE} = 3) group by 2, 3
union all select 'mix', region, strftime(day, '%Y-%m-%d'), count(distinct h) from e group by 2, 3
union all select 'mix', '{C.NATIONAL_REGION}', strftime(day, '%Y-%m-%d'), count(distinct h) from e group by 2, 3
union all select 'weather', region, strftime(day, '%Y-%m-%d'), count(distinct date_trunc('second', ts)) from e where not (page % {BROKEN_WEATHER} = 3) group by 2, 3""")
def c09(s, d):
    """Rows per day of a week's pages of all sources; pages that cannot be read are left out, and so is nothing else."""
    day = lambda text: F.lit(text).cast("date")
    pages = landed_pages(s, d)
    found = []
    for feed in load_plan.feeds():
        mine = pages.where(feed.holds() & feed.problem.isNull())
        rows = load_plan.fetch_window(mine, lambda p: feed.parse(p, []), day("2024-01-08"), day("2024-01-14"))
        found.append(rows.select(F.lit(feed.table).alias("table"), "region", F.to_date(TS).cast("string").alias("day"), TS, "source_record_id"))
    once = functools.reduce(lambda a, b: a.unionByName(b), found)
    return once.groupBy("table", "region", "day").agg(F.count_distinct("source_record_id").alias("n"))


@query("S07b_rounded_generation", f"select target, {T('ts')} as timestamp_utc, {R(H('mwh'))} as mwh from v_mix_long")
def s07b(s, d):
    from hourwatt.functions.numeric import half_even

    return A.mix_long(s, d).select("target", TS, half_even(F.col("mwh"), 2).alias("mwh"))
