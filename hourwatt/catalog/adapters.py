"""The driver's tables in the shapes the operators expect.

Each event is read as one quarter-hour power record: its type names the technology, its value the power,
and the number in ``props`` the consumption and the CO2 rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourwatt import constants as C
from hourwatt.functions.numeric import DECIMAL_TYPE, half_even, safe_divide
from hourwatt.functions.text import iso_utc, record_id
from hourwatt.operators.calendar import TS
from hourwatt.operators.trailing import lag_hours, owned_rows, trailing_frame, with_halo
from hourwatt.operators.walk_forward import ForecastWindow, assign_windows
from hourwatt.session import prepare_session
from hourwatt.sources.dimensions import load_emission_factors

TECHNOLOGY = {"click": "nuclear", "error": "coal", "purchase": "gas", "signup": "solar", "view": "wind"}
TECH_SOURCES = ("nuclear", "gas", "coal", "wind", "solar")
RECORD_FIELD = {"nuclear": "nucleaire", "coal": "charbon", "gas": "gaz", "solar": "solaire", "wind": "eolien"}
# The last window has no end, so that no later event is left out.
OPEN_END = "2999-12-31 23:00:00"
WINDOWS = (
    ForecastWindow("wf_1", "2024-01-01 00:00:00", "2024-01-07 23:00:00", "2024-01-08 00:00:00", "2024-01-14 23:00:00"),
    ForecastWindow("wf_2", "2024-01-01 00:00:00", "2024-01-14 23:00:00", "2024-01-15 00:00:00", "2024-01-21 23:00:00"),
    ForecastWindow("wf_3", "2024-01-01 00:00:00", "2024-01-21 23:00:00", "2024-01-22 00:00:00", OPEN_END),
)
MODELS = (C.NAIVE_MODEL, "naive_lag_168h", "rolling_mean_24h")
PAGE_RECORDS = 100
BROKEN_EVERY = 37


def factors():
    """The official factors of the five technologies that occur."""
    return {m: {s: by[s] for s in TECH_SOURCES} for m, by in load_emission_factors().items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare_session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def technology(event_type: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in TECHNOLOGY.items() for x in pair]), event_type)


def region_name(user_id: Column) -> Column:
    names = F.array(*[F.lit(name) for name, *_ in C.REGIONAL_LOCATIONS])
    return F.get(names, (user_id % 12).cast("int"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a zoned timestamp, the technology, the region and the number in ``props``."""
    raw = table(spark, sf_dir, "events")
    return raw.withColumns(
        {
            "ts": F.col("ts").cast("timestamp"),
            "technology": technology(F.col("event_type")),
            "region": region_name(F.col("user_id")),
            "k": F.from_json("props", "k int")["k"],
        }
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter-hour records: one technology field is set per event."""
    ev = events(spark, sf_dir)
    return ev.select(
        "event_id", "ts", F.col("region").alias("libelle_region"), F.col("k").alias("consommation"), F.col("k").alias("taux_co2"),
        *[F.when(F.col("technology") == tech, F.col("value")).alias(field) for tech, field in RECORD_FIELD.items()],
    )


def mix_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, hour, mwh): energy by technology; exact decimal sums, so the order of rows does not matter."""
    energy = F.sum(F.col("value").cast(DECIMAL_TYPE) * F.lit(C.INTERVAL_HOURS).cast("decimal(4,2)"))
    return events(spark, sf_dir).groupBy(F.col("technology").alias("target"), F.date_trunc("hour", "ts").alias(TS)).agg(
        energy.cast("double").alias("mwh")
    )


def _mean(column: str) -> Column:
    value = F.col(column).cast(DECIMAL_TYPE)
    return F.sum(value).cast("double") / F.count(value)


def price_by(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """Hourly mean value as price, per key."""
    return events(spark, sf_dir).groupBy(*keys, F.date_trunc("hour", "ts").alias(TS)).agg(_mean("value").alias("price_eur_mwh"))


def price_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical national day-ahead prices."""
    hourly = price_by(spark, sf_dir)
    return hourly.select(
        F.lit("api").alias("source"), record_id("energy-charts", "FR", iso_utc(F.col(TS))).alias("source_record_id"),
        F.lit("FR").alias("region"), TS, F.lit("1h").alias("granularity"), F.lit(C.DAY_AHEAD_MARKET).alias("market"),
        "price_eur_mwh", F.lit("EUR").alias("currency"),
    )


def weather_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-level weather observations by region (several per hour); the measures are the value and ``k``."""
    ev = events(spark, sf_dir)
    value, k = F.col("value").cast(DECIMAL_TYPE), F.col("k").cast(DECIMAL_TYPE)
    return ev.select(
        F.lit("api").alias("source"), record_id("open-meteo", F.col("region"), F.col("event_id").cast("string")).alias("source_record_id"),
        "region", F.date_trunc("hour", "ts").alias(TS), F.lit("1h").alias("granularity"), value.alias("temperature_c"),
        k.alias("apparent_temperature_c"), value.alias("wind_speed_mps"), k.alias("wind_speed_80m_mps"),
        F.when(F.col("event_type") != "error", value).alias("shortwave_radiation_wm2"), k.alias("cloud_cover_pct"),
        value.alias("precipitation_mm"), (k + 950).alias("surface_pressure_hpa"), k.cast("int").alias("weather_code"),
    )


def weather_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per region and hour: mean value and mean ``k``."""
    ev = events(spark, sf_dir)
    return ev.groupBy("region", F.date_trunc("hour", "ts").alias(TS)).agg(
        _mean("value").alias("temperature_c"), _mean("k").alias("cloud_cover_pct")
    )


def _forecasts(series: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Three baseline forecasts of every hour, long, in the test windows; all values have 2 digits.

    The trailing mean sums decimals, so it does not depend on the order of addition.
    """
    cents = series.withColumn("_v", half_even(F.col(value), 2))
    day = trailing_frame(keys, 24, 1)
    total, count = F.expr(f"sum(cast(_v as {DECIMAL_TYPE})) over {day}"), F.expr(f"count(_v) over {day}")
    wide = owned_rows(
        with_halo(cents, 168).withColumns(
            {
                C.NAIVE_MODEL: lag_hours("_v", 24, keys),
                "naive_lag_168h": lag_hours("_v", 168, keys),
                "rolling_mean_24h": half_even(safe_divide(total.cast("double"), count.cast("double")), 2),
            }
        )
    )
    entries = [F.struct(F.lit(m).alias("model"), F.col(m).alias("predicted")) for m in MODELS]
    long = wide.select(*keys, TS, F.col("_v").alias("actual"), F.inline(F.array(*entries)))
    kept = long.filter(F.col("predicted").isNotNull())
    return assign_windows(kept, WINDOWS, roles=("test",)).drop("role")


def pred_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source-level predictions (timestamp, window, target, model, actual, predicted)."""
    out = _forecasts(mix_long(spark, sf_dir), "mwh", ["target"])
    return out.select(TS, "window", "target", "model", F.col("actual").alias("actual_mwh"), F.col("predicted").alias("predicted_mwh"))


def price_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """National price predictions."""
    out = _forecasts(price_by(spark, sf_dir), "price_eur_mwh", [])
    return out.select(
        TS, "window", "model", F.col("actual").alias("actual_price_eur_mwh"), F.col("predicted").alias("predicted_price_eur_mwh")
    )


def workloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a workload of 1 to 24 hours within 12 hours of an earliest start at any minute; some cannot run."""
    key = F.col("o_orderkey")
    start = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) + (key % 28) * 86400 + (key % 60) * 60)
    return table(spark, sf_dir, "orders").select(
        key.cast("string").alias("workload_id"), region_name(F.col("o_custkey")).alias("region"), start.alias("earliest_start_utc"),
        (start + F.expr("interval 12 hours")).alias("latest_end_utc"), (60 + (key % 24) * 60).cast("int").alias("duration_minutes"),
        F.col("o_totalprice").alias("power_kw"), F.lit(600).alias("max_delay_minutes"), F.col("o_orderpriority").alias("service_level"),
    )


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily ingestion windows per technology; full days are completed, half-full ones failed, others running."""
    ev = events(spark, sf_dir)
    days = ev.groupBy(F.col("technology").alias("region"), F.to_date("ts").alias("day")).agg(
        F.count_distinct(F.hour("ts")).alias("hours"), F.count("*").alias("rows_loaded")
    )
    midnight = F.col("day").cast("timestamp")
    status = F.when(F.col("hours") == 24, "completed").when(F.col("hours") >= 12, "failed").otherwise("running")
    return days.select(
        F.lit("odre").alias("source_name"), F.lit("mix").alias("dataset_name"), "region", F.col("day").alias("window_start_date"),
        F.col("day").alias("window_end_date"), status.alias("status"),
        F.when(status == "completed", F.col("rows_loaded")).otherwise(F.lit(0).cast("bigint")).alias("rows_loaded"),
        F.when(status == "failed", F.concat(F.lit("hours: "), F.col("hours").cast("string"))).alias("error_message"),
        midnight.alias("started_at"), F.when(status != "running", midnight).alias("finished_at"), midnight.alias("updated_at"),
    )


def _page() -> Column:
    """Pages of at most 100 records, as event ids are unique; no page grows with the data."""
    return F.floor(F.col("event_id") / PAGE_RECORDS).alias("page")


def broken_too(pages: DataFrame) -> DataFrame:
    """The pages and, for every ``BROKEN_EVERY``-th one, a copy whose payload breaks off half way."""
    half = F.expr("substring(response_payload, 1, cast(length(response_payload) / 2 as int))")
    return pages.unionByName(pages.filter(F.col("page") % BROKEN_EVERY == 0).withColumn("response_payload", half))


def price_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price payloads of 100 points; error events carry a null price."""
    ev = events(spark, sf_dir)
    point = F.struct("ts", F.unix_seconds("ts").alias("s"), F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    grouped = ev.groupBy(_page()).agg(F.sort_array(F.collect_list(point)).alias("points"))
    payload = F.to_json(
        F.struct(F.lit(C.PRICE_UNIT).alias("unit"), F.col("points.s").alias("unix_seconds"), F.col("points.v").alias("price")),
        {"ignoreNullFields": "false"},
    )
    return grouped.select("page", F.lit("energy_charts").alias("source_name"), F.lit("/price").alias("endpoint"), payload.alias("response_payload"))


def weather_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather payloads by region; the wind array misses its last element, most variables are absent."""
    ev = events(spark, sf_dir)
    point = F.struct(
        "ts", "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("t"), F.col("value").alias("v"), "k",
        F.when(F.col("event_type") != "error", F.col("value")).alias("r"),
    )
    grouped = ev.groupBy("region", _page()).agg(F.sort_array(F.collect_list(point)).alias("points"))
    wind = F.slice(F.col("points.v"), F.lit(1), F.size("points") - 1)
    hourly = F.struct(
        F.col("points.t").alias("time"), F.col("points.v").alias("temperature_2m"), F.col("points.k").alias("relative_humidity_2m"),
        F.col("points.r").alias("shortwave_radiation"), wind.alias("wind_speed_10m"), F.col("points.k").alias("weather_code"),
    )
    payload = F.to_json(F.struct(hourly.alias("hourly")), {"ignoreNullFields": "false"})
    return grouped.select("page", "region", F.lit("open_meteo").alias("source_name"), F.lit("/archive").alias("endpoint"), payload.alias("response_payload"))


def record_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record payloads: an object with ``results``, or a bare list; each has one element that is no record."""
    ev = events(spark, sf_dir)
    point = F.struct(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("date_heure"), F.col("region").alias("libelle_region"),
        F.col("k").alias("consommation"), F.col("k").alias("taux_co2"),
        *[F.when(F.col("technology") == tech, F.col("value")).alias(field) for tech, field in RECORD_FIELD.items()],
    )
    grouped = ev.groupBy(_page()).agg(F.sort_array(F.collect_list(point)).alias("points"))
    items = F.to_json("points")
    listed = F.concat(F.lit('["note",'), F.substr(items, F.lit(2)))
    payload = F.when(F.col("page") % 2 == 0, F.concat(F.lit('{"results":'), listed, F.lit("}"))).otherwise(listed)
    return grouped.select("page", F.lit("odre").alias("source_name"), F.lit("/records").alias("endpoint"), payload.alias("response_payload"))


def xml_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price XML documents of 100 points; error events lack a price; the resolution depends on the page."""
    ev = events(spark, sf_dir)
    point = F.struct("event_id", F.when(F.col("event_type") != "error", F.col("value").cast("decimal(18,2)")).alias("v"), "ts")
    grouped = ev.groupBy(_page()).agg(F.sort_array(F.collect_list(point)).alias("points"), F.date_trunc("hour", F.min("ts")).alias("start"))
    resolution = F.when(F.col("page") % 3 == 0, "PT15M").when(F.col("page") % 3 == 1, "PT30M").otherwise("PT60M")
    body = F.array_join(
        F.transform(
            "points",
            lambda p, i: F.concat(
                F.lit("<Point><position>"), (i + 1).cast("string"), F.lit("</position>"),
                F.coalesce(F.concat(F.lit("<price.amount>"), p["v"].cast("string"), F.lit("</price.amount>")), F.lit("")), F.lit("</Point>"),
            ),
        ),
        "",
    )
    payload = F.concat(
        F.lit('<Publication_MarketDocument xmlns="urn:example"><TimeSeries><Period><timeInterval><start>'),
        F.date_format("start", "yyyy-MM-dd'T'HH:mmX"), F.lit("</start></timeInterval><resolution>"), resolution, F.lit("</resolution>"), body,
        F.lit("</Period></TimeSeries></Publication_MarketDocument>"),
    )
    return grouped.select("page", F.lit("entsoe").alias("source_name"), F.lit("/api").alias("endpoint"), payload.alias("response_payload"))
