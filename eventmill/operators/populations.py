"""Counts and statistics of populations, one scan and one shuffle for all gates of all samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventmill.functions.columns import finite
from eventmill.operators.gates import Gate, masks
from eventmill.plans.joins import null_safe_join
from eventmill.plans.order_statistics import percentiles


def gate_counts(events: DataFrame, sample: str, gates: list[Gate]) -> DataFrame:
    """``sample, population, n, pct_parent, pct_total``: a row for each sample and gate."""
    by = masks(gates)
    wide = events.groupBy(F.col(sample).alias("sample")).agg(F.count("*").alias("total"), *[F.count_if(m).alias(f"g{k}") for k, m in enumerate(by.values())])
    at = {n: k for k, n in enumerate(by)}
    parent = {g.name: F.col(f"g{at[g.parent]}") if g.parent else F.col("total") for g in gates}
    rows = F.array(*[F.struct(F.lit(n).alias("population"), F.col(f"g{k}").alias("n"), parent[n].alias("of")) for n, k in at.items()])
    return wide.select("sample", "total", F.explode(rows).alias("r")).select(
        "sample", "r.population", "r.n", (100.0 * F.col("r.n") / F.nullif(F.col("r.of"), F.lit(0))).alias("pct_parent"), (100.0 * F.col("r.n") / F.nullif(F.col("total"), F.lit(0))).alias("pct_total")
    )


def summary(events: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Counts, moments and quantiles of the finite values of each group; undefined ones are NULL."""
    v = finite(value)
    rows = events.select(*keys, v.alias("v"))
    first = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count("v").alias("n_finite"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("sd"),
        F.min("v").alias("least"),
        F.max("v").alias("most"),
        F.avg(F.when(F.col("v") > 0, F.log("v"))).alias("log_mean"),
    )
    quantiles = percentiles(rows, keys, F.col("v"), [0.05, 0.5, 0.95], deviation=True).drop("n")
    m = F.col("q")[1]
    return null_safe_join(first, quantiles, keys, "left").select(
        *keys,
        "n",
        "n_finite",
        "mean",
        m.alias("median"),
        F.col("q")[0].alias("p5"),
        F.col("q")[2].alias("p95"),
        "sd",
        "least",
        "most",
        (100.0 * F.col("sd") / F.nullif(F.abs("mean"), F.lit(0.0))).alias("cv"),
        "mad",
        (148.26 * F.col("mad") / F.nullif(F.abs(m), F.lit(0.0))).alias("robust_cv"),
        F.when(F.col("least") > 0, F.exp("log_mean")).alias("geometric_mean"),
    )


def histogram(events: DataFrame, keys: list[str], value: Column, low: float, high: float, bins: int) -> DataFrame:
    """Counts of bins [low, high], the last one closed; empty bins are not listed."""
    width = (high - low) / bins
    b = F.least(F.floor((value - low) / width), F.lit(bins - 1)).cast("int")
    return events.where(finite(value).between(low, high)).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))


def population_histogram(events: DataFrame, key: str, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """Every bin of [low, high] of every population with its count ``n``, and what the view leaves out.

    ``total`` has all rows, ``n_finite`` the finite values, ``below`` and ``above`` those outside the
    view; ``cdf_n`` counts the finite values up to the bin's upper edge, below the view too.
    """
    v, width = finite(value), (high - low) / bins
    place = F.when(v < low, -1).when(v > high, bins).when(v.isNotNull(), F.least(F.floor((v - low) / width), F.lit(bins - 1))).cast("int")
    upto = F.when(v.isNotNull(), F.greatest(F.lit(0), F.least(F.ceil((v - low) / width) - 1, F.lit(bins)))).cast("int")
    cells = events.select(F.col(key).alias("key"), place.alias("place"), upto.alias("upto")).groupBy("key", "place", "upto").agg(F.count("*").alias("c"))
    part = lambda ok: F.coalesce(F.sum(F.when(ok, F.col("c"))), F.lit(0))
    k, at, edge = F.col("key"), F.col("place"), F.col("upto")
    # the cells of a population are a few for each bin, whatever its rows
    held = cells.groupBy("key").agg(F.sum("c").alias("total"), part(at.isNotNull()).alias("n_finite"), part(at == -1).alias("below"), part(at == bins).alias("above"), F.collect_list(F.struct("place", "upto", "c")).alias("cells"))
    of = lambda ok: F.aggregate(F.filter("cells", ok), F.lit(0).cast("long"), lambda a, x: a + x["c"])
    b = F.col("bin")
    return held.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).select(k.alias(key), "bin", of(lambda x: x["place"] == b).alias("n"), of(lambda x: x["upto"] <= b).alias("cdf_n"), "total", "n_finite", "below", "above")


def time_bins(events: DataFrame, key: str, t: Column, value: Column, bins: int, threshold: float, least: int) -> DataFrame:
    """Every time bin of every population with its counts; statistics of fewer than ``least`` finite values are NULL."""
    rows = events.select(F.col(key).alias("key"), finite(t).alias("t"), finite(value).alias("v"))
    span = rows.agg(F.min("t").alias("t0"), ((F.max("t") - F.min("t")) / bins).alias("w"))
    place = F.least(F.coalesce(F.floor((F.col("t") - F.col("t0")) / F.nullif(F.col("w"), F.lit(0.0))), F.lit(0)), F.lit(bins - 1)).cast("int")
    v, n = F.col("v"), F.count("v")
    enough = lambda c: F.when(n >= least, c)
    got = rows.where("t IS NOT NULL").join(F.broadcast(span)).groupBy("key", place.alias("bin")).agg(
        F.count("*").alias("events"), n.alias("n"), F.count_if(v > threshold).alias("responders"),
        enough(F.avg("v")).alias("mean"), enough(F.percentile("v", 0.5)).alias("median"), enough(100.0 * F.count_if(v > threshold) / F.nullif(n, F.lit(0))).alias("pct_positive"),
    )
    grid = rows.select(F.col("key").alias("of")).distinct().withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    all_bins = grid.join(got, F.col("of").eqNullSafe(F.col("key")) & (F.col("at") == F.col("bin")), "left")
    return all_bins.select(F.col("of").alias(key), F.col("at").alias("bin"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("events", "n", "responders")], "mean", "median", "pct_positive")


def pivot(rows: DataFrame, left: str, right: str, value: Column) -> DataFrame:
    """``left, right, n, mean, median`` of the finite values: a row for each pair of a ``left`` and a ``right`` value.

    The values of both columns are those of the rows, NULL among them; a pair without rows has n 0.
    """
    cells = rows.groupBy(left, right).agg(F.count(v := finite(value)).alias("n"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"))
    a, b = (rows.select(F.col(c).alias(f"all_{c}")).distinct() for c in (left, right))
    here = F.col(f"all_{left}").eqNullSafe(F.col(left)) & F.col(f"all_{right}").eqNullSafe(F.col(right))
    return a.crossJoin(b).join(cells, here, "left").select(F.col(f"all_{left}").alias(left), F.col(f"all_{right}").alias(right), F.coalesce("n", F.lit(0)).alias("n"), "mean", "median")


def ks_to_control(events: DataFrame, population: str, value: Column, control: str, width: float = 1.0) -> DataFrame:
    """``population, distance, n_control, n``: the Kolmogorov-Smirnov distance of every other population to the control, over finite values.

    The distance is met just before or at a value of the population, so the control's
    distribution is read at these values only, by prefix sums over cells of ``width``.
    """
    is_control = F.coalesce(F.col("population") == control, F.lit(False))
    rows = events.select(F.col(population).alias("population"), finite(value).alias("v")).where("v IS NOT NULL")
    g = rows.groupBy("population", "v").agg(F.count("*").alias("n")).withColumns({"cell": F.floor(F.col("v") / width), "c": F.when(is_control, F.col("n")).otherwise(0)})
    cells = g.groupBy("population", "cell").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    up, each = Window.orderBy("cell"), Window.partitionBy("population")
    before = (Window.unboundedPreceding, -1)
    held = cells.groupBy("cell").agg(F.sum("c").alias("c"))
    held = held.select(F.col("cell").alias("at"), F.coalesce(F.sum("c").over(up.rowsBetween(*before)), F.lit(0)).alias("c0"), F.sum("c").over(Window.partitionBy(F.lit(0))).alias("n_control"))
    own = cells.select(F.col("population").alias("of"), F.col("cell").alias("own_at"), F.coalesce(F.sum("n").over(each.orderBy("cell").rowsBetween(*before)), F.lit(0)).alias("n0"), F.sum("n").over(each).alias("total"))
    inside = Window.partitionBy("cell").orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    mine = Window.partitionBy("cell", "population").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    f = g.withColumns({"cc": F.sum("c").over(inside), "tie": F.sum("c").over(Window.partitionBy("cell", "v")), "nn": F.sum("n").over(mine)})
    f = f.where(~is_control).join(held, F.col("cell") == F.col("at")).join(own, (F.col("cell") == F.col("own_at")) & F.col("population").eqNullSafe(F.col("of")))
    fc, fb = F.col("c0") + F.col("cc"), F.col("n0") + F.col("nn")
    apart = F.greatest(F.abs(fc / F.col("n_control") - fb / F.col("total")), F.abs((fc - F.col("tie")) / F.col("n_control") - (fb - F.col("n")) / F.col("total")))
    return f.groupBy("population").agg(F.max(F.when(F.col("n_control") > 0, apart)).alias("distance"), F.max("n_control").alias("n_control"), F.max("total").alias("n"))


def holm_and_bh(tests: DataFrame, p: str, keys: list[str], test: str) -> DataFrame:
    """Adjusted p-values of each family of tests; a test without p has none and takes no rank. Equal p are ordered by ``test``."""
    told = tests.where(F.col(p).isNotNull())
    family = Window.partitionBy(*keys)
    rows = told.withColumns({"m": F.count(p).over(family), "r": F.row_number().over(family.orderBy(p, test))})
    holm = F.max(F.least(F.lit(1.0), F.col(p) * (F.col("m") - F.col("r") + 1))).over(family.orderBy("r"))
    bh = F.min(F.least(F.lit(1.0), F.col(p) * F.col("m") / F.col("r"))).over(family.orderBy(F.desc("r")))
    done = rows.withColumns({"holm": holm, "bh": bh}).drop("m", "r")
    none = tests.where(F.col(p).isNull()).withColumns({"holm": F.lit(None).cast("double"), "bh": F.lit(None).cast("double")})
    return done.unionByName(none)
