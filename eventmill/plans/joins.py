"""Joins in which NULL is a key like others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

#: Groups of which a task holds a row each at ease.
FEW = 50_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on equal or both missing ``keys``, which are there once. Without keys, ``right`` has one row."""
    if not keys:
        return left.join(F.broadcast(right), how=how) if how != "inner" else left.crossJoin(F.broadcast(right))
    named = right.select(*[F.col(f"`{k}`").alias(f"__of_{k}") for k in keys], *[F.col(f"`{c}`") for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`__of_{k}`")) for k in keys])
    return left.join(named, same, how).drop(*[f"__of_{k}" for k in keys])


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``null_safe_join`` of rows with their groups, materialised with a row and the ``count`` of rows each, that gathers no large group in one task.

    Up to ``FEW`` groups are broadcast. Of more, those of over a ``FEW``th of all rows are, so ``FEW`` at most; the others are joined by their keys.
    """
    n, total = groups.agg(F.count("*"), F.sum(count)).first()
    if n <= FEW:
        return null_safe_join(rows, F.broadcast(groups), keys)
    large = F.col(count) > max(1, total // FEW)
    marked = null_safe_join(rows, F.broadcast(groups.where(large).select(*keys, F.lit(True).alias("__large"))), keys, "left")
    one = null_safe_join(marked.where("__large").drop("__large"), F.broadcast(groups.where(large)), keys)
    return one.unionByName(null_safe_join(marked.where("__large IS NULL").drop("__large"), groups.where(~large), keys))
