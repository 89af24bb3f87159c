"""Dense ranks inside classes of which one may hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventmill.plans.scratch import materialize


def salted_rank(rows: DataFrame, key: str, unique: list[str], name: str = "rank") -> DataFrame:
    """Adds ``name``: 0, 1, 2, … inside each value of ``key``, in an order fixed by ``unique``.

    A class of n rows is dealt into about sqrt(n) cells by hash; rows are numbered inside
    their cell, and cells get the prefix sums of their counts. No window holds more than
    about sqrt(n) rows. ``rows`` should be materialised: it is read twice.
    """
    cells = rows.groupBy(key).agg(F.ceil(F.sqrt(F.count("*"))).cast("long").alias("__cells"))
    cell: Column = F.pmod(F.xxhash64(*unique), F.col("__cells"))
    dealt = materialize(rows.join(F.broadcast(cells) if _few(cells) else cells, key).withColumn("__cell", cell).drop("__cells"), "dealt")
    counts = dealt.groupBy(key, "__cell").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(key).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(key, "__cell").orderBy(*unique)
    numbered = dealt.withColumn("__in", F.row_number().over(inside) - 1)
    return numbered.join(starts, [key, "__cell"]).withColumn(name, F.col("__start") + F.col("__in")).drop("__start", "__in", "__cell")


def _few(cells: DataFrame, most: int = 10_000) -> bool:
    return len(cells.select(F.lit(1)).take(most + 1)) <= most
