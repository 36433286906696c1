"""The registry of runnable queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codescope.plans.projections import Source, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# The SQL as written in a query, to be part of another's.
WRITTEN_SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(source)`` under ``key``, with the SQL that must give the same rows."""

    def register(fn: Callable[[Source], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: plain(fn(Source(spark, sf_dir)))
        if sql is not None:
            ORACLES[key] = oracle(sql)
            WRITTEN_SQL[key] = sql
        return fn

    return register


def utc(column: Column) -> Column:
    """A time without zone, read as UTC whatever the session's zone."""
    return F.from_utc_timestamp(column.cast("timestamp"), F.current_timezone())


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, times as microseconds: the same in every engine."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("long").alias(field.name)
        elif isinstance(field.dataType, T.TimestampType):
            column = F.unix_micros(column).alias(field.name)
        elif isinstance(field.dataType, T.TimestampNTZType):
            column = F.unix_micros(utc(column)).alias(field.name)
        columns.append(column)
    return df.select(*columns)
