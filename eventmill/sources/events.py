"""Event tables and what is checked when they are read or written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventmill.functions.columns import is_finite
from eventmill.operators.tables import safe_text
from eventmill.sources.acquisition_files import fcs_datasets, fcs_events

__all__ = ["audit", "checked", "fcs_datasets", "fcs_events", "read_csv_events", "to_documents", "write_gated"]

MOST_CHANNELS = 512


def read_csv_events(spark: SparkSession, path: str) -> DataFrame:
    """A table of numbers with unique, non-blank headings; a row of another width or with text raises when it is read."""
    first = spark.read.text(path).limit(1).first()
    if first is None:
        raise ValueError("the file is empty")
    names = [r for r in spark.read.csv(spark.sparkContext.parallelize([first[0].lstrip("﻿")])).first()]
    names = [(n or "").strip() for n in names]
    if not all(names) or len(set(names)) != len(names) or len(names) > MOST_CHANNELS:
        raise ValueError("headings are unique and not blank, 512 at most")
    schema = ", ".join(f"`{n}` double" for n in names)
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", True).option("nanValue", "NaN").csv(path)


def checked(events: DataFrame, sample: str, samples: DataFrame, channels: list[str]) -> DataFrame:
    """``events``, if each sample of ``samples(sample, event_count)`` has its count of rows and all channels are numbers."""
    kinds = dict(events.dtypes)
    if bad := [c for c in channels if kinds.get(c) not in ("double", "float", "int", "bigint")]:
        raise ValueError(f"channels are missing or not numbers: {bad}")
    n = events.groupBy(F.col(sample).alias("sample")).agg(F.count("*").alias("n"))
    off = samples.join(n, "sample", "full").where(~F.col("event_count").eqNullSafe(F.col("n")))
    if not off.isEmpty():
        raise ValueError("a sample has another number of events than it should")
    return events


def audit(events: DataFrame, sample: str, columns: list[str]) -> DataFrame:
    """``sample, rows, bad_<column>``: values that are not finite."""
    return events.groupBy(sample).agg(F.count("*").alias("rows"), *[F.count_if(~F.coalesce(is_finite(F.col(c)), F.lit(False))).alias(f"bad_{c}") for c in columns])


def write_gated(events: DataFrame, sample: str, mask: Column, channels: dict[str, Column], path: str, csv: bool = False) -> None:
    """A population's events on any scale, with a folder for each sample; text is made safe."""
    rows = events.where(mask).select(F.col(sample).alias("sample"), *[c.alias(n) for n, c in channels.items()])
    kinds = dict(rows.dtypes)
    rows = rows.select("sample", *[(safe_text(F.col(n)) if kinds[n] == "string" else F.col(n)).alias(n) for n in channels])
    writer = rows.write.partitionBy("sample")
    (writer.option("header", True).csv if csv else writer.parquet)(path)


def to_documents(rows: DataFrame, name: str = "document") -> DataFrame:
    """Each row as one JSON document, missing values with their keys."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias(name))
