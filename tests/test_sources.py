import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from hourwatt import constants as C
from hourwatt import schemas
from hourwatt.functions import numeric, text
from hourwatt.operators import ingestion, quality
from hourwatt.plans.ingestion import incremental_load, load_summary, merge_datasets, refresh_plan
from hourwatt.sources import payloads, tables
from hourwatt.sources.upsert import keep_one, require_record_id, upsert, write_upsert

T0 = 1704067200  # 2024-01-01 00:00 UTC


def page(spark, *payloads_):
    return spark.createDataFrame([(p if isinstance(p, str) else json.dumps(p), "R") for p in payloads_], "response_payload string, region string")


def test_price_pages(spark):
    pages = page(spark, {"unit": "EUR / MWh", "unix_seconds": [T0, T0 + 900, T0 + 1800, T0 + 3600], "price": [10.0, 20.0, None, -3.5]})
    rows = payloads.parse_price_pages(pages).orderBy("timestamp_utc").collect()
    assert [float(r.price_eur_mwh) for r in rows] == [15.0, -3.5]
    assert rows[0].source_record_id == "energy-charts:FR:2024-01-01T00:00:00+00:00"


@pytest.mark.parametrize("bad", [
    {"unit": "USD", "unix_seconds": [T0], "price": [1.0]},
    {"unit": "EUR / MWh", "unix_seconds": [T0, T0], "price": [1.0]},
    {"unit": "EUR / MWh", "price": [1.0]},
])
def test_bad_price_pages_fail_or_are_set_aside(spark, bad):
    good = {"unit": "EUR / MWh", "unix_seconds": [T0], "price": [1.0]}
    pages = page(spark, bad, good)
    with pytest.raises(Exception, match="unit|arrays"):
        payloads.parse_price_pages(pages).collect()
    assert payloads.parse_price_pages(pages, on_invalid="skip").count() == 1
    assert payloads.invalid_price_pages(pages).count() == 1


def test_weather_pages_with_short_arrays(spark):
    hourly = {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [1.5], "relative_humidity_2m": [80, None], "weather_code": [3, 61]}
    a, b = payloads.parse_weather_pages(page(spark, {"hourly": hourly})).orderBy("timestamp_utc").collect()
    assert a.temperature_c == Decimal("1.5") and b.temperature_c is None
    assert a.humidity_pct == 80 and b.humidity_pct is None and (a.weather_code, b.weather_code) == (3, 61)
    assert a.solar_irradiance_wm2 is None and b.timestamp_utc == dt.datetime(2024, 1, 1, 1)
    assert b.source_record_id == "open-meteo:R:2024-01-01T01:00:00+00:00"


def test_price_xml(spark):
    def doc(resolution, namespace=""):
        points = "<Point><position>1</position><price.amount>5.5</price.amount></Point><Point><position>3</position><price.amount>7</price.amount></Point><Point><position>4</position></Point>"
        return f"<Publication_MarketDocument{namespace}><TimeSeries><Period><timeInterval><start>2024-01-01T23:00Z</start></timeInterval>{resolution}{points}</Period></TimeSeries></Publication_MarketDocument>"

    for resolution, minutes, namespace in (("<resolution>PT15M</resolution>", 15, ""), ("<resolution>PT30M</resolution>", 30, ' xmlns="urn:x"'), ("", 60, "")):
        rows = payloads.parse_price_xml_pages(page(spark, doc(resolution, namespace)), "Z").orderBy("timestamp_utc").collect()
        assert [r.timestamp_utc for r in rows] == [dt.datetime(2024, 1, 1, 23), dt.datetime(2024, 1, 1, 23) + dt.timedelta(minutes=2 * minutes)]
        assert float(rows[1].price_eur_mwh) == 7.0


def test_record_extraction(spark):
    pages = page(spark, {"results": [{"a": 1}, "x", 3, None, {"a": 2}]}, [{"a": 5}, []], {"other": 1}, "null")
    got = payloads.extract_records(pages, on_invalid="skip").select(F.get_json_object("record", "$.a").cast("int").alias("a")).orderBy("a").collect()
    assert [r.a for r in got] == [1, 2, 5]
    assert payloads.rejected_pages(pages, payloads.record_page_problem()).count() == 2
    with pytest.raises(Exception, match="no list of records"):
        payloads.extract_records(pages).collect()


def test_broken_pages_are_never_lost_silently(spark):
    good = {"hourly": {"time": ["2024-01-01T00:00"], "temperature_2m": [1]}}
    pages = page(spark, good, "{broken", {"hourly": {"time": ["2024-01-01T00:00", "never"]}}).withColumn("region", F.lit("R"))
    for parse in (payloads.parse_weather_pages, lambda p, **k: payloads.parse_price_xml_pages(p, "Z", **k)):
        with pytest.raises(Exception, match="the (page|document) has"):
            parse(pages).collect()
    rows = payloads.parse_weather_pages(pages, on_invalid="skip").collect()
    assert [r.source_record_id for r in rows] == ["open-meteo:R:2024-01-01T00:00:00+00:00"]
    assert payloads.rejected_pages(pages, payloads.weather_page_problem()).count() == 2
    bad_start = "<Publication_MarketDocument><TimeSeries><Period><timeInterval><start>soon</start></timeInterval><Point><position>1</position><price.amount>5</price.amount></Point></Period></TimeSeries></Publication_MarketDocument>"
    assert payloads.rejected_pages(page(spark, bad_start, "<a"), payloads.xml_page_problem()).count() == 2


def test_hourly_mix_rules(spark):
    rows = [(dt.datetime(2024, 1, 1, 0, 15 * i), "R", 100.0, None, 4.0, 2.0, 1.0, None if i else 40.0) for i in range(4)]
    rec = spark.createDataFrame(rows, "ts timestamp, libelle_region string, nucleaire double, eolien double, pompage double, stockage_batterie double, destockage_batterie double, taux_co2 double")
    (r,) = payloads.hourly_mix(rec, C.REGIONAL_SCOPE).collect()
    assert float(r.nuclear_mwh) == 100.0 and r.wind_mwh is None
    assert float(r.battery_storage_mwh) == 3.0
    assert float(r.total_production_mwh) == 100.0 and float(r.carbon_intensity_gco2_kwh) == 40.0
    (empty,) = payloads.hourly_mix(rec.withColumn("nucleaire", F.lit(None).cast("double")), C.REGIONAL_SCOPE).collect()
    assert float(empty.total_production_mwh) == 0.0 and empty.source_record_id == "odre:regional:R:2024-01-01T00:00:00+00:00"


def test_narrow_batches_keep_stored_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    full = spark.createDataFrame([(1, "a", 1.0, "p"), (2, "b", 2.0, "p")], "k int, name string, v double, part string")
    write_upsert(spark, path, full, "part", ["k"])
    write_upsert(spark, path, full.select("k", (F.col("v") + 10).alias("v"), "part").where("k = 1"), "part", ["k"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("k", "name", "v").collect()) == [(1, "a", 11.0), (2, "b", 2.0)]


def test_latest_ingestion_wins(spark):
    rows = spark.createDataFrame([(1, "2024-01-01", 9.0), (1, "2024-01-02", 3.0)], "k int, ingestion_timestamp_utc string, v double")
    assert upsert(rows.limit(0), rows, ["k"]).first().v == 3.0


def test_upsert_rules(spark):
    old = spark.createDataFrame([("api", "1", "x", "first", 1.0), ("api", "2", "x", "first", 2.0)], "source string, source_record_id string, id string, created_at string, v double")
    new = spark.createDataFrame([("api", "2", "y", "second", 5.0, 1), ("api", "2", "y", "second", 7.0, 2), ("api", "3", "y", "second", 9.0, 1)], "source string, source_record_id string, id string, created_at string, v double, version int")
    once = upsert(old, new, order=[F.desc("version"), "v"])
    rows = {r.source_record_id: r for r in once.collect()}
    assert (rows["2"].v, rows["2"].id, rows["2"].created_at) == (7.0, "x", "first")
    assert rows["1"].v == 1.0 and rows["3"].created_at == "second"
    assert sorted(upsert(once, new, order=[F.desc("version"), "v"]).collect()) == sorted(once.collect())
    for bad in ("", None):
        with pytest.raises(Exception, match="cannot be merged twice"):
            require_record_id(spark.createDataFrame([("api", bad)], "source string, source_record_id string")).collect()


def test_one_row_per_key_is_limited_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    kept = keep_one(df, ["k"], F.desc("v"))
    assert sorted(r.v for r in kept.collect()) == [97, 98, 99]
    plan = keep_one(df, ["k"], F.desc("v"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_written_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "source string, source_record_id string, v int, day string"
    first = spark.createDataFrame([("api", "a", 1, "d1"), ("api", "b", 1, "d2")], schema)
    second = spark.createDataFrame([("api", "b", 2, "d2"), ("api", "c", 3, "d2")], schema)
    for batch in (first, second, second):
        write_upsert(spark, path, batch, "day", order=["v"])
    rows = spark.read.parquet(path).orderBy("source_record_id").collect()
    assert [(r.source_record_id, r.v) for r in rows] == [("a", 1), ("b", 2), ("c", 3)]


def test_later_dataset_wins(spark):
    schema = "source string, source_record_id string, v int"
    merged = merge_datasets([spark.createDataFrame([("api", "1", 1), ("api", "2", 1)], schema), spark.createDataFrame([("api", "2", 2)], schema)])
    assert {r.source_record_id: r.v for r in merged.collect()} == {"1": 1, "2": 2}


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def state(spark, *rows):
    day = dt.date(2024, 1, 1)
    stamp = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("s", "d", r, day, day, status, n, None, stamp, None, stamp) for r, status, n in rows], schemas.CHECKPOINTS)


def test_checkpoint_states(spark):
    old = state(spark, ("a", "completed", 5), ("b", "failed", 0))
    plan = state(spark, ("a", "", 0), ("b", "", 0), ("c", "", 0)).select(*ingestion.WINDOW_KEY)
    assert sorted(r.region for r in ingestion.pending_windows(plan, old).collect()) == ["b", "c"]
    started = {r.region: (r.status, r.rows_loaded) for r in ingestion.start_windows(old, plan, now()).collect()}
    assert started == {"a": ("completed", 5), "b": ("running", 0), "c": ("running", 0)}
    done = ingestion.complete_windows(old, plan.withColumn("rows_loaded", F.lit(9)), now())
    assert {r.region: (r.status, r.rows_loaded) for r in done.collect()} == {"a": ("completed", 9), "b": ("completed", 9)}
    failed = {r.region: r for r in ingestion.fail_windows(old, plan.withColumn("error_message", F.repeat(F.lit("e"), F.lit(5000))), now()).collect()}
    assert failed["a"].status == "completed" and failed["b"].status == "failed" and len(failed["c"].error_message) == 2000
    assert ingestion.reset_windows(old, "s", "d").isEmpty() and ingestion.reset_windows(old, "s", "x").count() == 2


WINDOW = "source_name string, dataset_name string, region string, window_start_date date, window_end_date date, response_payload string"


def landed(spark):
    """Two days of every source; the second day's price window holds one good page and one that breaks off."""
    pages = []
    for n in (1, 2):
        day, t = dt.date(2024, 1, n), T0 + 86400 * (n - 1)
        price = json.dumps({"unit": "EUR / MWh", "unix_seconds": [t, t + 3600], "price": [1.0, float(n)]})
        pages += [("energy_charts", C.PRICE_DATASET, "FR", day, day, price)] + [("energy_charts", C.PRICE_DATASET, "FR", day, day, price[:30])] * (n - 1)
        for dataset, region, power in ((C.NATIONAL_DATASET, "FR", 4), (C.REGIONAL_DATASET, "ALL_REGIONS", 4), (C.NATIONAL_PROVISIONAL_DATASET, "FR", 8)):
            record = {"date_heure": f"2024-01-0{n}T05:15:00+00:00", "libelle_region": "Bretagne", "consommation": power}
            pages.append(("odre", dataset, region, day, day, json.dumps({"results": [record, record]})))
        for region in ("Bretagne", "Normandie"):
            weather = {"hourly": {"time": [f"2024-01-0{n}T00:00", f"2024-01-0{n}T01:00", f"2024-01-0{n}T02:00"], "temperature_2m": [1.5, 2.5]}}
            pages.append(("open_meteo", C.WEATHER_DATASET, region, day, day, json.dumps(weather)))
    return spark.createDataFrame(pages, WINDOW)


def outcomes(result):
    return {(r.dataset_name, r.region, r.window_start_date.day): (r.status, r.rows_loaded) for r in result.checkpoints.collect()}


def test_all_sources_load_and_one_bad_page_fails_one_window(spark):
    pages = landed(spark)
    plan, none = pages.select(*ingestion.WINDOW_KEY).distinct(), state(spark).limit(0)
    empty = {name: spark.createDataFrame([], schema) for name, schema in (("prices", schemas.PRICES), ("mix", schemas.MIX), ("weather", schemas.WEATHER))}
    once = incremental_load(pages, plan, none, empty, now())
    wanted = {(d, r, n): ("completed", k) for n in (1, 2) for d, r, k in (
        (C.PRICE_DATASET, "FR", 2), (C.NATIONAL_DATASET, "FR", 1), (C.REGIONAL_DATASET, "ALL_REGIONS", 1), (C.NATIONAL_PROVISIONAL_DATASET, "FR", 1),
        (C.WEATHER_DATASET, "Bretagne", 3), (C.WEATHER_DATASET, "Normandie", 3))} | {(C.PRICE_DATASET, "FR", 2): ("failed", 0)}
    assert outcomes(once) == wanted
    assert [(r.window_start_date.day, r.error_message[:17]) for r in once.failures.collect()] == [(2, "unsupported price")]
    # The failed window's good page loads nothing; of two datasets of one table each counts its own rows, and the later one wins.
    assert once.tables["prices"].select(F.dayofmonth("timestamp_utc")).distinct().collect() == [(1,)]
    mix = {(r.scope, r.timestamp_utc.day): float(r.consumption_mwh) for r in once.tables["mix"].collect()}
    assert mix == {("national", 1): 4.0, ("national", 2): 4.0, ("regional", 1): 2.0, ("regional", 2): 2.0}
    assert once.tables["weather"].count() == 12
    counts = {(r.table, r.dataset_name): r.rows_loaded for r in load_summary(once.rows).collect()}
    assert counts == {("prices", C.PRICE_DATASET): 2, ("mix", C.NATIONAL_DATASET): 2, ("mix", C.REGIONAL_DATASET): 2, ("mix", C.NATIONAL_PROVISIONAL_DATASET): 2, ("weather", C.WEATHER_DATASET): 12}

    mended = pages.where(F.length("response_payload") != 30)
    twice = incremental_load(mended, plan, once.checkpoints, once.tables, now())
    assert outcomes(twice) == wanted | {(C.PRICE_DATASET, "FR", 2): ("completed", 2)}
    assert load_summary(twice.rows).collect() == [("prices", "energy_charts", C.PRICE_DATASET, 2)]
    assert twice.tables["prices"].count() == 4
    third = incremental_load(mended, plan, twice.checkpoints, twice.tables, now())
    assert third.rows.isEmpty() and outcomes(third) == outcomes(twice)
    for name, table in twice.tables.items():
        assert sorted(map(str, third.tables[name].collect())) == sorted(map(str, table.collect()))


def test_rows_that_break_a_rule_are_set_aside_and_unknown_datasets_fail(spark):
    day = dt.date(2024, 1, 1)
    record = {"date_heure": "2024-01-01T05:15:00+00:00", "consommation": 1, "nucleaire": -5}
    pages = spark.createDataFrame([("odre", C.NATIONAL_DATASET, "FR", day, day, json.dumps([record])), ("odre", "other", "FR", day, day, "[]")], WINDOW)
    plan = pages.select(*ingestion.WINDOW_KEY)
    result = incremental_load(pages, plan, state(spark).limit(0), {"mix": spark.createDataFrame([], schemas.MIX)}, now())
    assert outcomes(result) == {(C.NATIONAL_DATASET, "FR", 1): ("completed", 0), ("other", "FR", 1): ("failed", 0)}
    assert "nuclear_mwh_not_negative" in result.rejected["mix"].first().violated_rules and result.tables["mix"].isEmpty()


def test_refresh_plan_has_fixed_dates_and_provisional_mix(spark):
    days = [dt.date(2026, 4, 30), dt.date(2026, 5, 1), dt.date(2026, 6, 30), dt.date(2026, 7, 1)]
    rows = [("s", name, "FR", day, day) for day in days for name in (C.NATIONAL_DATASET, C.NATIONAL_PROVISIONAL_DATASET, C.PRICE_DATASET)]
    plan = spark.createDataFrame(rows, WINDOW.rsplit(",", 1)[0])
    kept = {(r.dataset_name, r.window_start_date) for r in refresh_plan(plan).collect()}
    assert kept == {(name, day) for name in (C.NATIONAL_PROVISIONAL_DATASET, C.PRICE_DATASET) for day in days[1:3]}


def test_constraints_and_quarantine(spark):
    rows = [("api", "1", "R", dt.datetime(2024, 1, 1), "1h", "regional", 5.0, -1.0), ("api", "2", "R", dt.datetime(2024, 1, 1), "1h", "regional", 5.0, None)]
    mix = schemas.conform(spark.createDataFrame(rows, "source string, source_record_id string, region string, timestamp_utc timestamp, granularity string, scope string, wind_mwh double, hydro_mwh double"), schemas.MIX)
    valid, rejected = quality.split_valid(mix, schemas.mix_rules())
    assert [r.source_record_id for r in valid.collect()] == ["2"]
    assert rejected.first().violated_rules == ["hydro_mwh_not_negative"]
    counts = {r.rule: r.violations for r in quality.violation_counts(mix, schemas.mix_rules()).collect()}
    assert counts["hydro_mwh_not_negative"] == 1 and counts["wind_mwh_not_negative"] == 0
    with pytest.raises(Exception, match="hydro_mwh_not_negative"):
        quality.require_valid(mix, schemas.mix_rules()).collect()
    with pytest.raises(ValueError, match="unexpected"):
        schemas.conform(mix.withColumn("extra", F.lit(1)), schemas.MIX)
    with pytest.raises(ValueError, match="missing"):
        schemas.conform(mix.drop("region"), schemas.MIX)


def test_scalar_functions(spark):
    row = spark.sql("select 2.675D a, 2.665D b, 1.015D c, 0D z, cast(null as double) n, double('NaN') nan").select(
        *[numeric.half_even(F.col(c), 2).alias(c) for c in "abc"], numeric.safe_divide(F.lit(1.0), F.col("z")).alias("z"),
        numeric.clip(F.col("n"), lower=0).alias("n"), numeric.nan_to_null(F.col("nan")).alias("nan"), numeric.to_double(F.lit("x")).alias("bad"),
        numeric.parse_decimal(F.lit("")).alias("empty"), text.metric_name(F.lit("A b/c-d:e")).alias("name"), text.scenario_title(F.lit("cost_aware_clean")).alias("title"),
        text.parse_offset_timestamp(F.lit("2024-01-01T00:00:00")).alias("naive"), text.parse_offset_timestamp(F.lit("2024-01-01T02:00+02:00")).alias("offset"),
    ).first()
    import numpy as np

    assert (row.a, row.b, row.c) == tuple(np.round([2.675, 2.665, 1.015], 2))
    assert row.z is None and row.n is None and row.nan is None and row.bad is None and row.empty is None and row.naive is None
    assert row.name == "a_b_c_d_e" and row.title == "Cost Aware Clean" and row.offset == dt.datetime(2024, 1, 1)


def test_files(spark, tmp_path):
    df = spark.sql("select timestamp'2024-01-01 05:00:00' ts, double('NaN') v")
    tables.write_csv(df, str(tmp_path / "c"))
    (r,) = tables.read_csv(spark, str(tmp_path / "c"), df.schema).collect()
    assert r.ts == dt.datetime(2024, 1, 1, 5) and r.v is None
    assert tables.read_csv(spark, str(tmp_path / "none"), df.schema, optional=True).isEmpty()
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.csv").write_text("x")
    manifest = tables.file_manifest(spark, str(tmp_path / "m"), ["a.csv", "b.csv"])
    assert {r.path: (r.exists, r.size_bytes) for r in manifest.collect()} == {"a.csv": (True, 1), "b.csv": (False, 0)}
    with pytest.raises(FileNotFoundError, match="b.csv"):
        tables.require_files(manifest)


def test_quality_report(spark):
    prices = spark.createDataFrame([("api", "1", "FR", dt.datetime(2024, 1, 1, h)) for h in (0, 1, 3)], "source string, source_record_id string, region string, timestamp_utc timestamp")
    mix = prices.withColumns({"scope": F.lit("national"), **{c: F.lit(1.0) for c in ("consumption_mwh", "total_production_mwh", "carbon_intensity_gco2_kwh")}})
    weather = prices.withColumns({c: F.lit(1.0) for c in ("temperature_c", "wind_speed_mps", "shortwave_radiation_wm2")}).filter("hour(timestamp_utc) < 2")
    passed = {r.check_name: r.passed for r in quality.run_checks(prices, mix, weather).collect()}
    assert passed == {
        "table_coverage": True, "duplicate_source_ids": False, "missing_price_hours": False, "missing_mix_hours": False, "missing_weather_hours": True, "key_null_rates": True,
    }
    lines = [r.line for r in quality.compact_report(quality.run_checks(prices, mix, weather), {}).collect()]
    assert "FAIL: duplicate_source_ids" in lines and "PASS: table_coverage" in lines


def test_checks_scan_every_table_once(spark, tmp_path):
    hours = [(None, None, None), ("api", "1", 0), ("api", "1", 0), ("api", "2", 3), (None, "1", 3), (None, "1", 4)]
    rows = [(a, b, "FR", c if c is None else dt.datetime(2024, 1, 1, c, 30)) for a, b, c in hours] + [("api", "9", None, dt.datetime(2024, 1, 2))]
    schema = "source string, source_record_id string, region string, timestamp_utc timestamp"
    prices = spark.createDataFrame(rows, schema)
    mix = prices.withColumns({"scope": F.lit("national"), **{c: F.lit(None).cast("double") for c in ("consumption_mwh", "total_production_mwh", "carbon_intensity_gco2_kwh")}})
    weather = prices.withColumns({c: F.lit(1.0) for c in ("temperature_c", "wind_speed_mps", "shortwave_radiation_wm2")})
    tables_ = {}
    for name, df in (("p", prices), ("m", mix), ("w", weather)):
        df.write.parquet(str(tmp_path / name))
        tables_[name] = spark.read.parquet(str(tmp_path / name))
    plan = quality.hourly_profile(tables_["m"], ["region", "scope"], ["consumption_mwh"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    details = quality.check_details(*tables_.values())
    assert not any("FileScan parquet" in d._jdf.queryExecution().executedPlan().toString() for d in details.values())
    names = {"electricity_prices": prices, "hourly_electricity_mix": mix, "weather_observations": weather}
    # The plain operators, one scan for each check, give the same rows.
    plain = {
        "table_coverage": quality.table_coverage(names), "duplicate_source_ids": quality.duplicate_record_ids(names),
        "missing_price_hours": quality.missing_hour_counts(prices, ["region"], "n"),
        "missing_mix_hours": quality.missing_hour_counts(mix, ["region", "scope"], "n"),
        "missing_weather_hours": quality.missing_hour_counts(weather, ["region"], "n"),
        "key_null_rates": quality.null_counts(names, {
            "hourly_electricity_mix": ["consumption_mwh", "total_production_mwh", "carbon_intensity_gco2_kwh"],
            "weather_observations": ["temperature_c", "wind_speed_mps", "shortwave_radiation_wm2"],
        }),
    }
    for name, df in details.items():
        assert df.columns == plain[name].columns
        assert sorted(map(repr, df.collect())) == sorted(map(repr, plain[name].collect())), name
    empty = [t.limit(0) for t in tables_.values()]
    assert [r.row_count for r in quality.check_details(*empty)["table_coverage"].collect()] == [0, 0, 0]
