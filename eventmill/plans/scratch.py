"""Materialisation in the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Only in a local session
where it is unset, as in tests, a folder of this process is taken instead.
"""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.conf.get("spark.eventmill.scratch", None)
    if not own:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.eventmill.scratch", own)
    return own.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    It cuts the lineage, fixes generated ids, and survives lost executors.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more; other tables stay as they are."""
    for table in tables:
        spark = table.sparkSession
        path_of = spark._jvm.org.apache.hadoop.fs.Path
        own = path_of(scratch_dir(spark)).toUri().getPath()
        for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = path_of(name)
            if path.toUri().getPath().startswith(own + "/"):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
