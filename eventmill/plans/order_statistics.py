"""Exact percentiles and ranks of groups of which one may hold most rows.

``percentile`` gathers all distinct values of a group in one task. Here sums below each value are
taken in cells between approximate quantiles, and percentiles between two of them.
Equal values are counted before anything is sorted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventmill.plans.joins import null_safe_join
from eventmill.plans.scratch import materialize

CELLS, ACCURACY = 64, 1000


def _celled(rows: DataFrame, keys: list[str], value: str, weights: list[str]) -> DataFrame:
    """``keys, value, __cell`` and the sums of ``weights``, a row for each distinct value."""
    told = rows.where(F.col(value).isNotNull())
    # the cuts need not be exact, so they are taken of distinct values
    distinct = materialize(told.groupBy(*keys, value).agg(*[F.sum(w).alias(w) for w in weights]), "distinct")
    cuts = distinct.groupBy(*keys).agg(F.percentile_approx(value, [k / CELLS for k in range(1, CELLS)], ACCURACY).alias("__cuts"))
    cuts = cuts.select(*[F.col(k).alias(f"__{k}") for k in keys], "__cuts")
    same = F.lit(True)
    for k in keys:
        same = same & distinct[k].eqNullSafe(cuts[f"__{k}"])
    joined = distinct.join(cuts, same) if keys else distinct.crossJoin(F.broadcast(cuts))  # one row
    cell = F.size(F.filter("__cuts", lambda c: c <= F.col(value)))
    return joined.withColumn("__cell", cell).drop("__cuts", *[f"__{k}" for k in keys])


def with_sums_below(rows: DataFrame, keys: list[str], value: str, weights: list[str]) -> DataFrame:
    """A row for each group and distinct value, with ``<weight>_below``, the sum over lesser values, and ``<weight>_total``."""
    told = materialize(_celled(rows, keys, value, weights), "cells")
    cells = told.groupBy(*keys, "__cell").agg(*[F.sum(w).alias(f"__{w}") for w in weights])
    up = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)  # CELLS rows a group
    every = Window.partitionBy(*keys)
    starts = cells.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        F.col("__cell").alias("__at"),
        *[F.coalesce(F.sum(f"__{w}").over(up), F.lit(0)).alias(f"__start_{w}") for w in weights],
        *[F.sum(f"__{w}").over(every).alias(f"{w}_total") for w in weights],
    )
    same = F.col("__cell") == F.col("__at")
    for k in keys:
        same = same & told[k].eqNullSafe(starts[f"__{k}"])
    inside = Window.partitionBy(*keys, "__cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = told.join(starts, same)
    out = out.withColumns({f"{w}_below": F.col(f"__start_{w}") + F.coalesce(F.sum(w).over(inside), F.lit(0)) for w in weights})
    return out.drop("__cell", "__at", *[f"__{k}" for k in keys], *[f"__start_{w}" for w in weights])


#: Ranks are told apart by sketches to this share of a group.
BRACKET = 10_000
#: Values of a group that are sorted as one array; larger groups are sketched.
SMALL = 20_000


def percentiles(rows: DataFrame, keys: list[str], value: Column, shares: list[float], deviation: bool = False) -> DataFrame:
    """``keys, n, q``: the count of the values that are not NULL, and their percentiles by linear interpolation, as ``percentile`` gives them.

    With ``deviation`` also ``mad``, the median distance from the median. Groups of up to ``SMALL`` values are sorted each for
    itself. Of a larger one, a sketch brackets each wanted rank; one more pass counts what lies below the brackets and the
    values inside them, so it hands on a few ten-thousandths of its values, equal ones as one, and no task holds its rows.
    """
    places = [lambda n, x=float(x): F.lit(x) * (n - 1) for x in shares]
    return _by_size(rows, keys, value, shares, places, deviation)


def order_statistics(rows: DataFrame, keys: list[str], value: Column, shares: list[float], ranks: list[Callable[[Column], Column]]) -> DataFrame:
    """``keys, n, q`` as ``percentiles``, where ``q`` are the values of ``ranks(n)``, from 0, which lie within one and a half of ``shares`` of the group; NULL for a rank outside."""
    return _by_size(rows, keys, value, shares, ranks, False)


def _by_size(rows: DataFrame, keys: list[str], value: Column, shares: list[float], places: list[Callable[[Column], Column]], deviation: bool) -> DataFrame:
    told = rows.select(*keys, value.alias("__v")).where("__v IS NOT NULL")
    if not keys:
        return _of_large(told, keys, shares, places, deviation)
    sizes = materialize(told.groupBy(*keys).agg(F.count("*").alias("__n")), "sizes")
    large, small = sizes.agg(F.count_if(F.col("__n") > SMALL), F.count_if(F.col("__n") <= SMALL)).first()
    if not large:
        return _of_small(told, keys, places, deviation)
    if not small:
        return _of_large(told, keys, shares, places, deviation)
    # there is at most one large group in SMALL rows
    sided = null_safe_join(told, F.broadcast(sizes.where(F.col("__n") > SMALL)), keys, "left")
    parts = [sided.where(c).drop("__n") for c in ("__n IS NULL", "__n IS NOT NULL")]
    return _of_small(parts[0], keys, places, deviation).unionByName(_of_large(parts[1], keys, shares, places, deviation))


def _mixed(place: Column, low: Column, high: Column) -> Column:
    """The value at a place between two ranks, with weights as Spark's percentile takes them."""
    part = place - F.floor(place)
    return F.when(part == 0, low.cast("double")).otherwise((1 - part) * low + part * high)


def _of_small(told: DataFrame, keys: list[str], places: list[Callable[[Column], Column]], deviation: bool) -> DataFrame:
    at = lambda values, place: _mixed(place, F.get(values, F.floor(place).cast("int")), F.get(values, F.ceil(place).cast("int")))
    n = F.col("n")
    held = told.groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("__v")).alias("__all"))
    if not deviation:
        return held.select(*keys, "n", F.array(*[at(F.col("__all"), p(n)) for p in places]).alias("q"))
    middle = at(F.col("__all"), 0.5 * (n - 1))
    held = held.withColumn("__m", middle).withColumn("__off", F.sort_array(F.transform("__all", lambda v: F.abs(v - F.col("__m")))))
    return held.select(*keys, "n", F.array(*[at(F.col("__all"), p(n)) for p in places]).alias("q"), at(F.col("__off"), 0.5 * (n - 1)).alias("mad"))


def _of_large(told: DataFrame, keys: list[str], shares: list[float], places: list[Callable[[Column], Column]], deviation: bool) -> DataFrame:
    if deviation:
        half = [*shares, 0.5], [*places, lambda n: 0.5 * (n - 1)]
        got = materialize(_of_large(told, keys, *half, False), "quantiles")
        middle = got.select(*keys, F.col("q")[len(shares)].alias("__m"))
        off = null_safe_join(told, F.broadcast(middle), keys).select(*keys, F.abs(F.col("__v") - F.col("__m")).alias("__v"))
        mads = _of_large(off, keys, [0.5], [lambda n: 0.5 * (n - 1)], False).select(*keys, F.col("q")[0].alias("mad"))
        return null_safe_join(got.withColumn("q", F.slice("q", 1, len(shares))), mads, keys)
    around = [min(1.0, max(0.0, s + d)) for s in shares for d in (-2 / BRACKET, 2 / BRACKET)]
    cuts = materialize(told.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("__v", around, BRACKET).alias("__cuts")), "brackets")
    if not keys:
        cuts = cuts.where("n > 0")
    # a row a large group: a join by the keys would gather its rows in one task
    placed = null_safe_join(told, F.broadcast(cuts.drop("n")), keys)
    v = F.col("__v")
    each = [F.struct(F.lit(k).alias("s"), F.when(v < F.col("__cuts")[2 * k], -1).when(v > F.col("__cuts")[2 * k + 1], 1).otherwise(0).alias("side")) for k in range(len(shares))]
    sided = placed.select(*keys, "__v", F.explode(F.array(*each)).alias("e")).select(*keys, "__v", "e.*")
    counted = sided.groupBy(*keys, "s", "side", F.when(F.col("side") == 0, v).alias("__at")).agg(F.count("*").alias("c"), F.min("__v").alias("least"), F.max("__v").alias("most"))
    # of what lies below only the greatest can be wanted, of what lies above the least
    counted = counted.select(*keys, "s", F.when(F.col("side") < 0, F.col("most")).otherwise(F.col("least")).alias("v"), "c")
    up = Window.partitionBy(*keys, "s").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = null_safe_join(counted.withColumn("upto", F.sum("c").over(up)), F.broadcast(cuts.drop("__cuts")), keys)
    wanted = lambda n: F.element_at(F.array(*[p(n).cast("double") for p in places]), F.col("s") + 1)
    low, high = (f(wanted(F.col("n"))) + 1 for f in (F.floor, F.ceil))
    held = lambda r: F.max(F.when((F.col("upto") >= r) & (F.col("upto") - F.col("c") < r), F.col("v")))
    got = ranked.groupBy(*keys, "s").agg(F.max("n").alias("n"), held(low).alias("lo"), held(high).alias("hi"))
    mixed = _mixed(wanted(F.col("n")), F.col("lo"), F.col("hi"))
    found = got.groupBy(*keys).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("s", mixed.alias("q")))).alias("__q"))
    return found.select(*keys, "n", F.transform("__q", lambda x: x.q).alias("q"))
