"""Incremental loads from landed raw pages into canonical tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourwatt import constants as C
from hourwatt import schemas
from hourwatt.operators import ingestion
from hourwatt.operators.calendar import day_predicate
from hourwatt.operators.quality import split_valid
from hourwatt.schemas import RECORD_KEY
from hourwatt.session import cut_lineage
from hourwatt.sources import payloads
from hourwatt.sources.upsert import keep_one, require_record_id, upsert

ALL_REGIONS = "ALL_REGIONS"
# The dates of the fixed refresh.
REFRESH_START, REFRESH_END = "2026-05-01", "2026-06-30"


def merge_datasets(datasets: Sequence[DataFrame], keys: Sequence[str] = tuple(RECORD_KEY)) -> DataFrame:
    """Union datasets that produce the same record ids; the later dataset wins."""
    ranked = [df.withColumn("_precedence", F.lit(i)) for i, df in enumerate(datasets)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    return keep_one(both, list(keys), F.desc("_precedence")).drop("_precedence")


def pages_of_window(pages: DataFrame, start: Column, end: Column, ts: str = "page_ts") -> DataFrame:
    """Landed pages of an inclusive date window (half-open in time, so partitions prune)."""
    return pages.filter(day_predicate(F.col(ts), start, end))


def fetch_window(pages: DataFrame, parse: Callable[[DataFrame], DataFrame], start: Column, end: Column, ts: str = "page_ts") -> DataFrame:
    """Parse the pages of a window and keep one row per record id."""
    rows = parse(pages_of_window(pages, start, end, ts))
    others = [c for c in rows.columns if c not in RECORD_KEY]
    return keep_one(rows, RECORD_KEY, *others)


@dataclass(frozen=True)
class Feed:
    """A dataset of landed pages: the table its rows go to, how its pages are read and why one cannot be.

    ``parse`` takes pages and the names of page columns that lead every row, and skips pages with a ``problem``: a load
    has failed their windows by then, and an error raised in the parser could run before that.
    """

    source_name: str
    dataset_name: str
    table: str
    schema: T.StructType
    parse: Callable[[DataFrame, Sequence[str]], DataFrame]
    problem: Column
    rules: Mapping[str, Column] = field(default_factory=dict)

    def holds(self) -> Column:
        return (F.col("source_name") == self.source_name) & (F.col("dataset_name") == self.dataset_name)


def _mix(scope: str) -> Callable[[DataFrame, Sequence[str]], DataFrame]:
    return lambda pages, keys: payloads.hourly_mix(payloads.mix_records(pages, on_invalid="skip"), scope, keys=keys)


def feeds() -> list[Feed]:
    """All sources: prices, the national and the regional mix, their provisional versions, and weather.

    Of datasets that give the same record ids the later one in this list wins.
    """
    mix = dict(table="mix", schema=schemas.MIX, problem=payloads.record_page_problem(), rules=schemas.mix_rules())
    prices = dict(table="prices", schema=schemas.PRICES, parse=lambda pages, keys: payloads.parse_price_pages(pages, on_invalid="skip", keys=keys), problem=payloads.price_page_problem())
    weather = dict(table="weather", schema=schemas.WEATHER, parse=lambda pages, keys: payloads.parse_weather_pages(pages, on_invalid="skip", keys=keys), problem=payloads.weather_page_problem())
    return [
        Feed("energy_charts", C.PRICE_DATASET, rules=schemas.price_rules(), **prices),
        Feed("odre", C.NATIONAL_DATASET, parse=_mix(C.NATIONAL_SCOPE), **mix),
        Feed("odre", C.REGIONAL_DATASET, parse=_mix(C.REGIONAL_SCOPE), **mix),
        Feed("odre", C.NATIONAL_PROVISIONAL_DATASET, parse=_mix(C.NATIONAL_SCOPE), **mix),
        Feed("odre", C.REGIONAL_PROVISIONAL_DATASET, parse=_mix(C.REGIONAL_SCOPE), **mix),
        Feed("open_meteo", C.WEATHER_DATASET, rules=schemas.weather_rules(), **weather),
    ]


@dataclass(frozen=True)
class LoadResult:
    """``rows`` has the loaded rows per table and dataset, ``rejected`` the rows of each table that broke a rule."""

    tables: dict[str, DataFrame]
    checkpoints: DataFrame
    rejected: dict[str, DataFrame]
    failures: DataFrame
    rows: DataFrame


_AT = "_window"


def refresh_plan(plan: DataFrame, start: str = REFRESH_START, end: str = REFRESH_END) -> DataFrame:
    """The part of a plan that a refresh of fixed dates loads: prices, weather and the provisional mix."""
    inside = (F.col("window_start_date") >= F.lit(start).cast("date")) & (F.col("window_end_date") <= F.lit(end).cast("date"))
    return plan.where(inside & ~F.col("dataset_name").isin(C.NATIONAL_DATASET, C.REGIONAL_DATASET))


def _problem(sources: Sequence[Feed]) -> Column:
    known = [F.when(f.holds(), F.coalesce(f.problem, F.lit(""))) for f in sources]
    return F.nullif(F.coalesce(*known, F.lit("no feed reads this dataset")), F.lit(""))


def _typed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    return schemas.conform(rows, T.StructType([rows.schema[_AT], *schema.fields]))


def incremental_load(
    pages: DataFrame, plan: DataFrame, checkpoints: DataFrame, tables: Mapping[str, DataFrame], now: Column, sources: Sequence[Feed] | None = None
) -> LoadResult:
    """Load the pages of every window that is not completed yet, of all sources, and record each window's outcome.

    A window with a page that cannot be read fails with the reason and loads nothing; the other windows complete, so
    one bad page costs one window. Rows carry their window through the parsers and are counted by it. Running it twice
    loads nothing new; failed windows are tried again.
    """
    sources = feeds() if sources is None else sources
    pending = cut_lineage(ingestion.pending_windows(plan, checkpoints).distinct())
    running = ingestion.start_windows(checkpoints, pending, now)
    due = pages.join(pending, ingestion.WINDOW_KEY, "left_semi")
    failures = cut_lineage(
        due.withColumn("error_message", _problem(sources)).where("error_message is not null").groupBy(*ingestion.WINDOW_KEY).agg(F.min("error_message").alias("error_message"))
    )
    good = due.join(failures, ingestion.WINDOW_KEY, "left_anti").withColumn(_AT, F.struct(*ingestion.WINDOW_KEY))
    merged, rejected, counts = dict(tables), {}, []
    for table, target in tables.items():
        mine = [f for f in sources if f.table == table]
        if not mine:
            continue
        read = [_typed(f.parse(good.where(f.holds()), [_AT]), f.schema).withColumn("_precedence", F.lit(i)) for i, f in enumerate(mine)]
        # Used by the rules, the merge and the counts, so the parsed rows are written once.
        rows = cut_lineage(require_record_id(reduce(DataFrame.unionByName, read)))
        accepted, rejected[table] = split_valid(rows, mine[0].rules) if mine[0].rules else (rows, rows.limit(0))
        # One row per record and window.
        others = [c for c in accepted.columns if c not in (*RECORD_KEY, _AT)]
        once = keep_one(accepted, [*RECORD_KEY, _AT], *[F.desc_nulls_last(c) for c in others])
        counts.append(once.groupBy(_AT).agg(F.count("*").alias("rows_loaded")).select(F.lit(table).alias("table"), f"{_AT}.*", "rows_loaded"))
        order = [F.desc("_precedence"), F.desc(f"{_AT}.window_end_date"), *[F.desc_nulls_last(c) for c in others]]
        batch = keep_one(once, RECORD_KEY, *order).drop("_precedence", _AT)
        merged[table] = upsert(target, batch)
    rows = reduce(DataFrame.unionByName, counts)
    completed = pending.join(failures, ingestion.WINDOW_KEY, "left_anti").join(rows.drop("table"), ingestion.WINDOW_KEY, "left")
    done = ingestion.complete_windows(running, completed.withColumn("rows_loaded", F.coalesce("rows_loaded", F.lit(0))), now)
    return LoadResult(merged, ingestion.fail_windows(done, failures, now), rejected, failures, rows)


def load_summary(rows: DataFrame) -> DataFrame:
    """Loaded rows per table and dataset."""
    return rows.groupBy("table", "source_name", "dataset_name").agg(F.sum("rows_loaded").alias("rows_loaded"))
