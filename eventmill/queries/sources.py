"""Queries over sources and exports: what is written is read again."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventmill.plans.scratch import scratch_dir
from eventmill.queries.registry import registered, table
from eventmill.sources import acquisition_files


def _written(spark: SparkSession, sf_dir: str) -> str:
    """The events as acquisition files, a sample for each type."""
    acquisition_files.register(spark)
    path = f"{scratch_dir(spark)}/acquisitions-{uuid4().hex}"
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("sample"), F.col("event_id").alias("event"), "user_id", "value")
    rows.sortWithinPartitions("sample", "event").write.format("fcs").options(sample="sample", rowsPerDataset=4096).mode("append").save(path)
    return path


@registered("SELECT event_type AS sample, event_id, user_id, value FROM events")
def acquisition_files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, sf_dir)
    names = acquisition_files.fcs_datasets(spark, path).select("path", "dataset", F.element_at("metadata", "SAMPLE ID").alias("sample"))
    events = acquisition_files.fcs_events(spark, path, "path string, dataset int, event double, user_id double, value double", rowsPerPartition=2048)
    return events.join(F.broadcast(names), ["path", "dataset"]).select("sample", F.col("event").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), "value")


@registered("SELECT event_type AS sample, count(*) AS event_count, CAST(1 AS BOOLEAN) AS intact FROM events GROUP BY event_type")
def acquisition_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, sf_dir)
    listed = spark.createDataFrame([(f["name"], f["sample"]) for f in acquisition_files.manifest(path)["files"]], "name string, sample string")
    files = acquisition_files.verified_files(spark, path).join(listed, "name")
    return files.groupBy("sample").agg(F.sum("rows").alias("event_count"), F.bool_and("intact").alias("intact"))
