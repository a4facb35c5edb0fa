"""Data-quality checks over the canonical tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourwatt.operators.calendar import TS
from hourwatt.operators.densify import missing_hour_counts
from hourwatt.session import cut_lineage

Tables = Mapping[str, DataFrame]


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def table_coverage(tables: Tables, ts: str = TS) -> DataFrame:
    """Row count and first/last timestamp of every table."""
    return _union(
        [
            df.agg(
                F.count("*").alias("row_count"), F.min(ts).alias("min_timestamp_utc"), F.max(ts).alias("max_timestamp_utc")
            ).select(F.lit(name).alias("table_name"), "*")
            for name, df in tables.items()
        ]
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; counted map-side first, so a hot key costs little."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("duplicate_count"))
    return counts.filter(F.col("duplicate_count") > 1)


def duplicate_record_ids(tables: Tables, keys: Sequence[str] = ("source", "source_record_id")) -> DataFrame:
    return _union(
        [duplicate_keys(df, keys).select(F.lit(name).alias("table_name"), *keys, "duplicate_count") for name, df in tables.items()]
    )


def null_counts(tables: Tables, measures: Mapping[str, Sequence[str]]) -> DataFrame:
    """Null counts of each table's primary measures (same position, same output column)."""
    return _union(
        [
            df.agg(*[F.count_if(F.col(m).isNull()).alias(f"null_primary_measure_{i}") for i, m in enumerate(measures[name], 1)]).select(
                F.lit(name).alias("table_name"), "*"
            )
            for name, df in tables.items()
            if name in measures
        ]
    )


def off_hour_rows(df: DataFrame, ts: str = TS) -> DataFrame:
    """Coverage of a table and how many of its rows are off the full hour."""
    return df.agg(
        F.count("*").alias("row_count"),
        F.min(ts).alias("min_timestamp_utc"),
        F.max(ts).alias("max_timestamp_utc"),
        F.count_if((F.minute(ts) != 0) | (F.second(ts) != 0)).alias("non_hourly_rows"),
    )


def violation_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Violations per rule from one pass over the table; a rule that is null counts as violated."""
    names = list(rules)
    aggs = [F.count_if(~F.coalesce(rules[n], F.lit(False))).alias(n) for n in names]
    one = df.agg(F.count("*").alias("row_count"), *aggs)
    entries = [F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in names]
    return one.select("row_count", F.inline(F.array(*entries)))


def with_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add the names of the rules each row breaks."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("violated_rules", F.array_compact(F.array(*broken)))


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the quarantine with the rules each row breaks."""
    marked = with_violations(df, rules)
    clean = F.size("violated_rules") == 0
    return marked.filter(clean).drop("violated_rules"), marked.filter(~clean)


def require_valid(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Fail the job on the first row that breaks a rule."""
    marked = with_violations(df, rules)
    message = F.concat(F.lit("rows violate: "), F.array_join("violated_rules", ", "))
    checked = F.when(F.size("violated_rules") == 0, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return marked.filter(checked).drop("violated_rules")


def _check(name: str, rows: DataFrame, passed: Column) -> DataFrame:
    return rows.agg(F.count("*").alias("detail_rows"), passed.alias("passed")).select(F.lit(name).alias("check_name"), "passed", "detail_rows")


def hourly_profile(
    df: DataFrame, keys: Sequence[str], measures: Sequence[str] = (), ids: Sequence[str] = ("source", "source_record_id"), ts: str = TS
) -> DataFrame:
    """What the checks need of a table, from one scan: ``of`` is ``hour`` or ``id``.

    Hour rows hold the rows, first and last time and null counts per (keys, hour), a set bound by time; id rows hold the
    rows per record id, repeated ids only. Both are counted map-side first. A table without rows has none.
    """
    hour = F.date_trunc("hour", F.col(ts)).alias("_hour")
    nulls = [F.count_if(F.col(m).isNull()).alias(f"_null_{i}") for i, m in enumerate(measures, 1)]
    # The measures and the time itself are read beside the grouped columns, which an id row has as null.
    rows = df.select(*ids, *keys, hour, F.col(ts).alias("_at"), *measures)
    by_id, by_hour = [F.col(c) for c in ids], [F.col(c) for c in (*keys, "_hour")]
    sets = rows.groupingSets([by_id, by_hour], *by_id, *by_hour)
    counted = sets.agg(
        F.grouping("_hour").alias("_grouped"), F.count("*").alias("_rows"), F.min("_at").alias("_first"), F.max("_at").alias("_last"), *nulls
    )
    wanted = counted.filter((F.col("_grouped") == 0) | (F.col("_rows") > 1))
    return wanted.withColumn("of", F.when(F.col("_grouped") == 0, "hour").otherwise("id")).drop("_grouped")


def check_details(prices: DataFrame, mix: DataFrame, weather: DataFrame) -> dict[str, DataFrame]:
    """The rows behind each of the six checks; every table is scanned once, by one job that runs here."""
    tables = {"electricity_prices": prices, "hourly_electricity_mix": mix, "weather_observations": weather}
    keys = {"electricity_prices": ["region"], "hourly_electricity_mix": ["region", "scope"], "weather_observations": ["region"]}
    measures = {
        "hourly_electricity_mix": ["consumption_mwh", "total_production_mwh", "carbon_intensity_gco2_kwh"],
        "weather_observations": ["temperature_c", "wind_speed_mps", "shortwave_radiation_wm2"],
    }
    ids = ("source", "source_record_id")
    profiles = {name: cut_lineage(hourly_profile(df, keys[name], measures.get(name, ()), ids)) for name, df in tables.items()}
    hours = {name: p.filter("of = 'hour'") for name, p in profiles.items()}

    def total(column: str, name: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).alias(name)

    coverage = [
        p.agg(total("_rows", "row_count"), F.min("_first").alias("min_timestamp_utc"), F.max("_last").alias("max_timestamp_utc")).select(
            F.lit(name).alias("table_name"), "*"
        )
        for name, p in hours.items()
    ]
    repeated = [
        p.filter("of = 'id'").select(F.lit(name).alias("table_name"), *ids, F.col("_rows").alias("duplicate_count"))
        for name, p in profiles.items()
    ]
    nulls = [
        hours[name].agg(*[total(f"_null_{i}", f"null_primary_measure_{i}") for i in range(1, len(columns) + 1)]).select(
            F.lit(name).alias("table_name"), "*"
        )
        for name, columns in measures.items()
    ]

    def gaps(name: str) -> DataFrame:
        return missing_hour_counts(hours[name].select(*keys[name], F.col("_hour").alias(TS)), keys[name], "n")

    return {
        "table_coverage": _union(coverage),
        "duplicate_source_ids": _union(repeated),
        "missing_price_hours": gaps("electricity_prices"),
        "missing_mix_hours": gaps("hourly_electricity_mix"),
        "missing_weather_hours": gaps("weather_observations"),
        "key_null_rates": _union(nulls),
    }


def run_checks(prices: DataFrame, mix: DataFrame, weather: DataFrame) -> DataFrame:
    """The six checks over the three tables."""
    return judge(check_details(prices, mix, weather))


def judge(details: Mapping[str, DataFrame]) -> DataFrame:
    """Which checks pass, from the rows behind them: expect rows, expect none, or all counts zero."""
    has_rows, no_rows = F.count("*") > 0, F.count("*") == 0

    def all_zero(column: str) -> Column:
        return F.coalesce(F.max(column), F.lit(0)) == 0

    rules = {
        "table_coverage": has_rows, "duplicate_source_ids": no_rows, "missing_price_hours": all_zero("n"), "missing_mix_hours": all_zero("n"),
        "missing_weather_hours": all_zero("n"), "key_null_rates": has_rows,
    }
    return _union([_check(name, details[name], rule) for name, rule in rules.items()])


def compact_report(checks: DataFrame, details: Mapping[str, DataFrame], rows: int = 10) -> DataFrame:
    """PASS/FAIL lines, each with at most ``rows`` detail rows as JSON text and how many more there are (a top-k report)."""
    status = F.when(F.col("passed"), "PASS").otherwise("FAIL")
    lines = [checks.select("check_name", F.concat(status, F.lit(": "), F.col("check_name")).alias("line"))]
    more = F.concat((F.col("detail_rows") - rows).cast("string"), F.lit(" more rows"))
    lines.append(checks.filter(F.col("detail_rows") > rows).select("check_name", more.alias("line")))
    for name, df in details.items():
        text = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
        lines.append(df.select(F.lit(name).alias("check_name"), text.alias("line")).orderBy("line").limit(rows))
    return _union(lines)
