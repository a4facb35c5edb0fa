import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourwatt import constants as C
from hourwatt.operators import calendar, densify, trailing
from hourwatt.plans.features import modeling_features

START = dt.datetime(2024, 1, 1)


def series(spark, hours, gaps=(), keys=1):
    rows = [(k, START + dt.timedelta(hours=h), float((h * 37 + k * 11) % 101)) for k in range(keys) for h in range(hours) if h not in gaps]
    schema = "k int, timestamp_utc timestamp, v double"
    return spark.createDataFrame(rows, schema), pd.DataFrame(rows, columns=["k", "ts", "v"])


@pytest.mark.parametrize("bucket_hours", [37, 336, 2016])
def test_lags_and_rolling_equal_a_densified_series(spark, bucket_hours):
    df, local = series(spark, 400, gaps=(50, 51, 200), keys=2)
    out = trailing.add_trailing_features(df, ["k"], {"v": "v"}, bucket_hours=bucket_hours).toPandas()
    assert len(out) == len(local)
    for k, part in local.groupby("k"):
        dense = part.set_index("ts")["v"].asfreq("h")
        wanted = pd.DataFrame({f"v_lag_{h}h": dense.shift(h) for h in C.LAG_HOURS})
        past = dense.shift(1)
        for n in C.MEAN_HOURS:
            wanted[f"v_rolling_mean_{n}h"] = past.rolling(n).mean()
        wanted["v_rolling_std_24h"] = past.rolling(24).std()
        wanted["v_rolling_min_24h"], wanted["v_rolling_max_24h"] = past.rolling(24).min(), past.rolling(24).max()
        got = out[out.k == k].set_index("timestamp_utc").sort_index()
        wanted = wanted.loc[got.index]
        for column in wanted:
            assert np.allclose(got[column].astype(float), wanted[column], equal_nan=True, atol=1e-9), column


def test_existing_columns_are_kept(spark):
    df, _ = series(spark, 60)
    out = trailing.add_trailing_features(df.withColumn("v_lag_1h", F.lit(-7.0)), ["k"], {"v": "v"}, only_missing=True)
    assert out.select("v_lag_1h").distinct().collect()[0][0] == -7.0
    assert out.filter("v_lag_24h is not null").count() == 36
    assert calendar.add_calendar(df.withColumn("hour", F.lit(99)), only_missing=True).first().hour == 99


def test_trailing_plan_has_one_exchange(spark):
    df, _ = series(spark, 60)
    plan = trailing.add_trailing_features(df, ["k"], {"v": "v"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_duplicate_timestamps_and_off_grid_rows(spark):
    names = {c: (lambda h, i=i: float((h * (i + 3)) % 17 + 1)) for i, c in enumerate(C.MIX_COLUMNS)}
    rows = [(START + dt.timedelta(hours=h), float(h % 50), *[f(h) for f in names.values()]) for h in range(400)]
    twin = [(rows[390][0], 49.5, *rows[390][2:]), (START + dt.timedelta(hours=390, minutes=30), 1.0, *rows[390][2:])]
    schema = "timestamp_utc timestamp, price_eur_mwh double, " + ", ".join(f"{c} double" for c in names)
    base = spark.createDataFrame(rows + twin, schema)
    for c in C.WEATHER_AGG_COLUMNS:
        base = base.withColumn(c, F.lit(1.0))
    out = modeling_features(base)
    assert out.columns == C.modeling_columns() and len(out.columns) == 207
    kept = out.filter(F.col("timestamp_utc") == rows[390][0]).collect()
    assert len(kept) == 1 and kept[0].price_eur_mwh == rows[390][1]
    assert out.count() == 400 - 336


def test_windows_of_dates(spark):
    ranges = spark.createDataFrame([("a", dt.date(2023, 12, 30), dt.date(2024, 1, 9))], "k string, start_date date, end_date date")
    weekly = calendar.date_windows(ranges, 7).select("window_start_date", "window_end_date").collect()
    assert [tuple(r) for r in weekly] == [(dt.date(2023, 12, 30), dt.date(2024, 1, 5)), (dt.date(2024, 1, 6), dt.date(2024, 1, 9))]
    years = calendar.calendar_year_windows(ranges).select("window_start_date", "window_end_date").collect()
    assert [tuple(r) for r in years] == [(dt.date(2023, 12, 30), dt.date(2023, 12, 31)), (dt.date(2024, 1, 1), dt.date(2024, 1, 9))]
    with pytest.raises(ValueError):
        calendar.date_windows(ranges, 0)
    backwards = ranges.select("k", F.col("end_date").alias("start_date"), F.col("start_date").alias("end_date"))
    with pytest.raises(Exception, match="runs backwards"):
        calendar.date_windows(backwards, 7).collect()


def test_calendar_values(spark):
    row = calendar.add_calendar(spark.sql("select timestamp'2024-02-04 20:00:00' timestamp_utc")).first()
    assert (row.hour, row.day_of_week, row.month, row.day_of_year) == (20, 6, 2, 35)
    assert (row.is_weekend, row.is_peak_hour, row.is_morning_ramp, row.is_evening_peak, row.is_overnight) == (True, True, False, True, False)
    assert math.isclose(row.hour_sin, math.sin(2 * math.pi * 20 / 24)) and math.isclose(row.day_of_year_cos, math.cos(2 * math.pi * 35 / 365.25))


def test_gaps_and_densify(spark):
    df, _ = series(spark, 10, gaps=(3, 4))
    assert [r.timestamp_utc.hour for r in densify.missing_hours(df, ["k"]).orderBy("timestamp_utc").collect()] == [3, 4]
    dense = densify.densify_hourly(df, ["k"])
    assert dense.count() == 10 and dense.filter("v is null").count() == 2
    assert densify.missing_hour_counts(df, ["k"]).first().missing_hours == 2
