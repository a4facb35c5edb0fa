"""Registered queries with their reference SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from hourwatt.catalog.sql_views import NUDGE, VIEWS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prefix a statement with the shared views it mentions, directly or through other views."""
    needed: set[str] = set()
    pending = [sql]
    while pending:
        text = pending.pop()
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                pending.append(VIEWS[name])
    ctes = ",\n".join(f"{name} as ({VIEWS[name]})" for name in VIEWS if name in needed)
    if not ctes:
        return sql
    own = re.match(r"with\s+", sql)
    return f"with {ctes},\n{sql[own.end():]}" if own else f"with {ctes}\n{sql}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL only its rows can be checked."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: comparable(function(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql.strip())
        return function

    return register


def comparable(df: DataFrame) -> DataFrame:
    """Plain output types: times as text, decimals as doubles, doubles rounded to 6 digits."""
    columns = []
    for f in df.schema.fields:
        name = f"`{f.name}`"
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            columns.append(f"date_format({name}, 'yyyy-MM-dd HH:mm:ss') as {name}")
        elif isinstance(f.dataType, T.DateType):
            columns.append(f"date_format({name}, 'yyyy-MM-dd') as {name}")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            columns.append(f"round(cast({name} as double) + {NUDGE}D, 6) + 0D as {name}")
        else:
            columns.append(name)
    return df.selectExpr(*columns)
