"""Equi-joins of which one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Rows that one task takes at ease, whatever their keys.
EASY = 10_000


def heavy_keys(counts: DataFrame, on: list[str], count: str, total: int) -> dict[int, int] | None:
    """The cells to cut each key into that has more than a quarter of a partition's share of ``total`` rows, by the key's hash.

    At most 4 x partitions keys can be so heavy, and their cells are 8 x partitions at most:
    this is the proven bound of what the driver holds and of what is replicated. None if all rows are few.
    """
    if total <= EASY:
        return None
    most = max(1, total // (4 * partitions(counts)))
    heavy = counts.where(F.col(count) > most).select(F.xxhash64(*on).alias("key"), F.ceil(F.col(count) / most).cast("int").alias("parts"))
    return {r.key: r.parts for r in heavy.collect()}  # toLocalIterator would run a job for each partition


def join_by_cells(many: DataFrame, one: DataFrame, on: list[str], salt: Column, heavy: dict[int, int] | None, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, at most one row a key, where ``heavy`` keys are dealt into cells by ``salt``.

    Keys of one hash are cut alike on both sides, whether heavy or not. With an empty ``heavy`` the plan is the same, of one cell a key.
    """
    if heavy is None:
        return many.join(one, on, how)
    table = F.create_map(*[F.lit(v) for pair in (heavy or {0: 1}).items() for v in pair])
    parts = F.coalesce(F.try_element_at(table, F.xxhash64(*on)), F.lit(1))
    dealt = many.withColumn("__cell", F.pmod(F.xxhash64(salt), parts).cast("int"))
    if not heavy:
        return dealt.join(one.withColumn("__cell", parts - 1), [*on, "__cell"], how).drop("__cell")
    # only the heavy keys' rows are repeated
    light = one.where(parts == 1).withColumn("__cell", F.lit(0))
    spread = light.unionByName(one.where(parts > 1).withColumn("__cell", F.explode(F.sequence(F.lit(0), parts - 1))))
    return dealt.join(spread, [*on, "__cell"], how).drop("__cell")


def skew_join(many: DataFrame, one: DataFrame, on: list[str], salt: Column, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """``join_by_cells`` with the counts taken from ``counted``, rows with the same keys as ``many``; if None, from ``many``.

    What is counted should be materialised: it is read twice.
    """
    counted = many if counted is None else counted
    counts = counted.groupBy(*on).agg(F.count("*").alias("__n"))
    return join_by_cells(many, one, on, salt, heavy_keys(counts, on, "__n", counted.count()), how)
