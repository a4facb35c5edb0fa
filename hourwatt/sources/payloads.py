"""Raw API pages to canonical rows: prices (JSON, XML), weather (JSON) and generation records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourwatt import constants as C
from hourwatt.functions.numeric import DECIMAL_TYPE, parse_decimal
from hourwatt.functions.text import iso_timestamp, iso_utc, parse_offset_timestamp, record_id

PRICE_SCHEMA = "unit string, unix_seconds array<bigint>, price array<decimal(18,6)>"
XML_SCHEMA = (
    "TimeSeries array<struct<Period: array<struct<timeInterval: struct<start: string>, resolution: string, "
    "Point: array<struct<position: string, `price.amount`: string>>>>>>"
)


def accepted_pages(pages: DataFrame, problem: Column, on_invalid: str = "fail") -> DataFrame:
    """Pages without a problem; one with a problem fails the job, or is left out with ``on_invalid="skip"``."""
    if on_invalid == "skip":
        return pages.filter(problem.isNull())
    return pages.filter(F.when(problem.isNull(), F.lit(True)).otherwise(F.raise_error(problem).cast("boolean")))


def rejected_pages(pages: DataFrame, problem: Column) -> DataFrame:
    """The pages that a parser leaves out, with the reason in ``problem``."""
    return pages.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def _record_items(payload: str, records_field: str) -> Column:
    text = F.ltrim(F.col(payload))
    listed = F.when(text.startswith("["), text).otherwise(F.get_json_object(text, f"$.{records_field}"))
    return F.from_json(listed, "array<string>")


def record_page_problem(payload: str = "response_payload", records_field: str = "results") -> Column:
    """Why a page of records cannot be read, or null."""
    return F.when(_record_items(payload, records_field).isNull(), F.lit("the page holds no list of records"))


def extract_records(pages: DataFrame, payload: str = "response_payload", records_field: str = "results", on_invalid: str = "fail") -> DataFrame:
    """One row per record of a page, as JSON text.

    A page is a list of records or an object with the list in ``records_field``; list elements that are no objects are
    dropped. A page without such a list fails the job, or is left out with ``on_invalid="skip"``.
    """
    good = accepted_pages(pages, record_page_problem(payload, records_field), on_invalid)
    rows = good.select(*[c for c in pages.columns if c != payload], F.explode(_record_items(payload, records_field)).alias("record"))
    return rows.filter(F.ltrim("record").startswith("{"))


XML_OPTIONS = {"ignoreNamespace": "true", "rowTag": "Publication_MarketDocument"}


def _price_problem(p: Column) -> Column:
    return (
        F.when(p["unit"].isNull() | (p["unit"] != C.PRICE_UNIT), F.concat(F.lit("unsupported price unit: "), F.coalesce(p["unit"], F.lit("none"))))
        .when(p["unix_seconds"].isNull() | p["price"].isNull(), F.lit("unix_seconds and price arrays are required"))
        .when(F.size(p["unix_seconds"]) != F.size(p["price"]), F.lit("timestamp and price arrays differ in length"))
    )


def parse_price_pages(
    pages: DataFrame, zone: str = C.NATIONAL_REGION, payload: str = "response_payload", on_invalid: str = "fail", keys: Sequence[str] = ()
) -> DataFrame:
    """Price payloads to one mean price per UTC hour.

    Null prices are skipped. A page with a wrong unit or ragged arrays fails the job, or is left out with
    ``on_invalid="skip"`` (see ``invalid_price_pages`` for the rejected ones). ``keys`` name page columns that lead every
    row; hours are then averaged within a key.
    """
    parsed = pages.select(*keys, F.from_json(payload, PRICE_SCHEMA).alias("p"))
    parsed = accepted_pages(parsed, _price_problem(F.col("p")), on_invalid)
    points = parsed.select(*keys, F.inline(F.arrays_zip("p.unix_seconds", "p.price"))).filter(F.col("price").isNotNull())
    hour = F.date_trunc("hour", F.timestamp_seconds("unix_seconds"))
    hourly = points.groupBy(*keys, hour.alias("timestamp_utc")).agg((F.sum("price") / F.count("price")).cast(DECIMAL_TYPE).alias("price_eur_mwh"))
    return hourly.select(
        *keys, F.lit("api").alias("source"),
        record_id("energy-charts", zone, iso_utc(F.col("timestamp_utc"))).alias("source_record_id"),
        F.lit(C.NATIONAL_REGION).alias("region"), "timestamp_utc", F.lit("1h").alias("granularity"),
        F.lit(C.DAY_AHEAD_MARKET).alias("market"), "price_eur_mwh", F.lit("EUR").alias("currency"),
    )


def price_page_problem(payload: str = "response_payload") -> Column:
    """Why a price page cannot be read, or null."""
    return _price_problem(F.from_json(payload, PRICE_SCHEMA))


def invalid_price_pages(pages: DataFrame, payload: str = "response_payload") -> DataFrame:
    """Pages the price parser rejects, with the reason."""
    return rejected_pages(pages, price_page_problem(payload))


def weather_page_problem(payload: str = "response_payload") -> Column:
    """Why a weather page cannot be read, or null."""
    times = F.from_json(payload, "hourly struct<time: array<string>>")["hourly"]["time"]
    return F.when(times.isNull(), F.lit("the page has no hourly times")).when(F.exists(times, lambda t: iso_timestamp(t).isNull()), F.lit("the page has a time that is no time"))


def parse_weather_pages(
    pages: DataFrame, region: str = "region", payload: str = "response_payload", on_invalid: str = "fail", keys: Sequence[str] = ()
) -> DataFrame:
    """Weather payloads (one array per variable) to one row per hour.

    Arrays may be shorter than ``time``: positions past the end are null. Times without offset are UTC. A page that
    cannot be read fails the job, or is left out with ``on_invalid="skip"``.
    """
    pages = accepted_pages(pages, weather_page_problem(payload), on_invalid)
    variables = ", ".join(f"{v}: array<{'int' if v == 'weather_code' else DECIMAL_TYPE}>" for v in C.WEATHER_FIELDS)
    parsed = pages.select(*keys, F.col(region).alias("region"), F.from_json(payload, f"hourly struct<time: array<string>, {variables}>").alias("p"))
    hours = parsed.select(*keys, "region", F.col("p.hourly").alias("h"), F.posexplode("p.hourly.time").alias("_pos", "_time"))
    rows = hours.select(
        *keys, "region", iso_timestamp(F.col("_time")).alias("timestamp_utc"),
        *[F.get(F.col(f"h.{v}"), F.col("_pos")).alias(name) for v, name in C.WEATHER_FIELDS.items()],
    )
    return rows.select(
        *keys, F.lit("api").alias("source"),
        record_id("open-meteo", F.col("region"), iso_utc(F.col("timestamp_utc"))).alias("source_record_id"),
        "region", "timestamp_utc", F.lit("1h").alias("granularity"), *C.WEATHER_FIELDS.values(),
        F.col("shortwave_radiation_wm2").alias("solar_irradiance_wm2"), F.col("relative_humidity_2m_pct").alias("humidity_pct"),
    )


def xml_page_problem(payload: str = "response_payload") -> Column:
    """Why a price document cannot be read, or null."""
    series = F.from_xml(F.col(payload), XML_SCHEMA, XML_OPTIONS)["TimeSeries"]
    starts = F.flatten(F.transform(F.filter(series, lambda s: s["Period"].isNotNull()), lambda s: F.transform(s["Period"], lambda p: p["timeInterval"]["start"])))
    return F.when(series.isNull(), F.lit("the document has no series")).when(
        F.exists(starts, lambda t: (F.coalesce(t, F.lit("")) != "") & iso_timestamp(t).isNull()), F.lit("the document has a start that is no time")
    )


def parse_price_xml_pages(
    pages: DataFrame, zone: str, payload: str = "response_payload", on_invalid: str = "fail", keys: Sequence[str] = ()
) -> DataFrame:
    """Price XML documents to points: period start + resolution * (position - 1).

    Resolutions other than PT15M and PT30M count as one hour; points without position or price are skipped. A document
    that cannot be read fails the job, or is left out with ``on_invalid="skip"``.
    """
    options = XML_OPTIONS
    doc = accepted_pages(pages, xml_page_problem(payload), on_invalid).select(*keys, F.from_xml(F.col(payload), XML_SCHEMA, options).alias("d"))
    periods = doc.select(*keys, F.explode("d.TimeSeries").alias("s")).select(*keys, F.explode("s.Period").alias("p"))
    points = periods.filter(F.coalesce(F.col("p.timeInterval.start"), F.lit("")) != "").select(
        *keys, iso_timestamp(F.col("p.timeInterval.start")).alias("_start"), F.col("p.resolution").alias("_resolution"),
        F.explode("p.Point").alias("q"),
    )
    rows = points.select(
        *keys, "_start", "_resolution", F.nullif(F.col("q.position"), F.lit("")).cast("int").alias("_position"),
        F.nullif(F.col("q")["price.amount"], F.lit("")).cast(DECIMAL_TYPE).alias("price_eur_mwh"),
    ).filter(F.col("_position").isNotNull() & F.col("price_eur_mwh").isNotNull())
    minutes = F.when(F.col("_resolution") == "PT15M", 15).when(F.col("_resolution") == "PT30M", 30).otherwise(60)
    ts = F.timestamp_seconds(F.unix_seconds("_start") + minutes * 60 * (F.col("_position") - 1))
    return rows.select(*keys, ts.alias("timestamp_utc"), "price_eur_mwh").select(
        *keys, F.lit("api").alias("source"),
        record_id("entsoe", zone, iso_utc(F.col("timestamp_utc"))).alias("source_record_id"),
        F.lit(C.NATIONAL_REGION).alias("region"), "timestamp_utc", F.lit("1h").alias("granularity"),
        F.lit(C.DAY_AHEAD_MARKET).alias("market"), "price_eur_mwh", F.lit("EUR").alias("currency"),
    )


def mix_records(pages: DataFrame, payload: str = "response_payload", on_invalid: str = "fail") -> DataFrame:
    """Records of power pages with typed measures and ``ts``; the other page columns stay."""
    measures = sorted({*C.NATIONAL_FIELDS, *C.REGIONAL_FIELDS} | {"taux_co2"})
    fields = "date_heure string, libelle_region string, " + ", ".join(f"{m} string" for m in measures)
    records = extract_records(pages, payload, on_invalid=on_invalid)
    kept = [c for c in pages.columns if c != payload]
    parsed = records.select(*kept, F.from_json("record", fields).alias("_r")).select(*kept, "_r.*")
    typed = [parse_decimal(F.col(m)).alias(m) for m in measures]
    return parsed.select(*kept, parse_offset_timestamp(F.col("date_heure")).alias("ts"), "libelle_region", *typed)


def _fields(scope: str) -> Mapping[str, str]:
    if scope not in (C.NATIONAL_SCOPE, C.REGIONAL_SCOPE):
        raise ValueError(f"unknown scope: {scope}")
    return C.NATIONAL_FIELDS if scope == C.NATIONAL_SCOPE else C.REGIONAL_FIELDS


def hourly_mix_aggregates(columns: Sequence[str], scope: str, interval_hours: str = C.INTERVAL_HOURS) -> list[Column]:
    """Aggregates of one (region, hour): energy per measure, mean CO2 rate.

    Energy is power times a fixed interval length. A measure fed by several fields adds them; it is null
    when none of them has a value. Shared by the batch and the streaming job.
    """
    hours = F.lit(interval_hours).cast("decimal(4,2)")
    by_measure: dict[str, list[Column]] = {}
    for field, measure in _fields(scope).items():
        if field in columns:
            by_measure.setdefault(measure, []).append(F.sum(F.col(field).cast(DECIMAL_TYPE) * hours))
    aggs = []
    for measure, sums in by_measure.items():
        if len(sums) > 1:
            zero = F.lit(0).cast(DECIMAL_TYPE)
            total = sum((F.coalesce(s, zero) for s in sums[1:]), F.coalesce(sums[0], zero))
            aggs.append(F.when(F.coalesce(*sums).isNotNull(), total).alias(measure))
        else:
            aggs.append(sums[0].alias(measure))
    rate = F.col("taux_co2").cast(DECIMAL_TYPE)
    aggs.append(F.avg(rate).alias("carbon_intensity_gco2_kwh"))
    return aggs


def total_production(columns: Sequence[str]) -> Column:
    """Sum of the production measures present, null as zero; storage and exchanges stay out."""
    parts = [F.coalesce(F.col(f"{s}_mwh"), F.lit(0)) for s in C.PRODUCTION_SOURCES if f"{s}_mwh" in columns]
    return sum(parts[1:], parts[0]) if parts else F.lit(0)


def finish_mix(hourly: DataFrame, scope: str) -> DataFrame:
    """Add total production, source and record id to hourly sums."""
    return hourly.withColumn("total_production_mwh", total_production(hourly.columns)).withColumns(
        {
            "source": F.lit("api"),
            "scope": F.lit(scope),
            "granularity": F.lit("1h"),
            "source_record_id": record_id("odre", scope, F.col("region"), iso_utc(F.col("timestamp_utc"))),
        }
    )


def hourly_mix(records: DataFrame, scope: str, ts: str = "ts", interval_hours: str = C.INTERVAL_HOURS, keys: Sequence[str] = ()) -> DataFrame:
    """Quarter-hour power records to hourly energy per region (national rows all belong to ``FR``).

    The sums combine map-side, so a region with a third of all records shuffles one row per task and hour.
    """
    region = F.lit(C.NATIONAL_REGION) if scope == C.NATIONAL_SCOPE else F.col("libelle_region")
    aggs = hourly_mix_aggregates(records.columns, scope, interval_hours)
    hourly = records.groupBy(*keys, region.alias("region"), F.date_trunc("hour", F.col(ts)).alias("timestamp_utc")).agg(*aggs)
    return finish_mix(hourly, scope)
