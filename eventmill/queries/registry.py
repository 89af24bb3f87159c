"""Where queries and their SQL are kept, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None):
    """Keep a query, with the SQL that gives the same rows; None if SQL cannot express it and tests hold it against brute force."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


SECONDS = "epoch_us(ts) / 1e6"
#: Clocks that fall back every 2500 events, as after a restart of the acquisition.
RESET_SECONDS = f"{SECONDS} - 1000000 * floor(event_id / 2500)"


def seconds() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1e6


def reset_seconds() -> Column:
    return seconds() - 1000000 * F.floor(F.col("event_id") / 2500)
