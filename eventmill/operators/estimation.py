"""Spillover and spreading matrices from single-stain controls.

Statistics of controls come from one job over all controls and detectors; matrices have a row for
each output and fit on the driver.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from eventmill.functions.columns import finite, is_finite, tempered_root
from eventmill.operators.comparison import linear_fits
from eventmill.plans.joins import null_safe_join, with_groups
from eventmill.plans.order_statistics import order_statistics, percentiles
from eventmill.plans.scratch import materialize


def control_statistics(events: DataFrame, control: str, role: str, detectors: dict[str, Column], ranges: dict[str, float] | None = None, minimum_events: int = 1) -> DataFrame:
    """``control, role, detector, n, median, robust_sd, saturated`` over events that are finite in all detectors.

    ``robust_sd`` is 1.4826 MAD; ``saturated`` counts values from 0.9999 of a detector's range on.
    """
    ok = reduce(lambda a, b: a & b, [is_finite(c) for c in detectors.values()])
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("detector"), c.cast("double").alias("v"), F.lit((ranges or {}).get(n)).cast("double").alias("range")) for n, c in detectors.items()]))
    rows = events.where(ok).select(F.col(control).alias("control"), F.col(role).alias("role"), cells.alias("c")).select("control", "role", "c.*")
    keys = ["control", "role", "detector"]
    m = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("v") >= F.col("range") * 0.9999).alias("saturated"))
    q = percentiles(rows, keys, F.col("v"), [0.5], deviation=True).select(*keys, F.col("q")[0].alias("median"), (1.4826 * F.col("mad")).alias("robust_sd"))
    return null_safe_join(m, q, keys).where(F.col("n") >= minimum_events).select(*keys, "n", "median", "robust_sd", "saturated")


def separations(stats: DataFrame, primaries: DataFrame) -> DataFrame:
    """``control, detector, delta, coefficient, separation``: positive less negative medians, over that of the primary detector.

    ``primaries(control, primary)``; a primary of NULL is the detector of the largest difference. A control without
    positive separation has NULL coefficients. ``separation`` is the primary's difference over its larger robust deviation.
    """
    keys = ["control", "detector"]
    pos, neg = (stats.where(F.col("role") == r).select(*keys, F.col("median").alias(f"m_{r}"), F.col("robust_sd").alias(f"s_{r}")) for r in ("positive", "negative"))
    d = pos.join(neg, keys).withColumn("delta", F.col("m_positive") - F.col("m_negative")).join(primaries, "control", "left")
    peak = F.max_by("detector", "delta").over(Window.partitionBy("control"))  # detectors of one control
    d = d.withColumn("primary", F.coalesce("primary", peak))
    own = d.where(F.col("detector") == F.col("primary")).select("control", F.col("delta").alias("signal"), F.greatest("s_positive", "s_negative").alias("noise"), F.greatest(F.lit(1.0), F.abs("m_positive"), F.abs("m_negative")).alias("size"))
    told = d.join(own, "control")
    good = F.col("signal") > 1e-10 * F.col("size")
    return told.select("control", "detector", "delta", F.when(good, F.col("delta") / F.nullif(F.col("signal"), F.lit(0.0))).alias("coefficient"), F.when(good & (F.col("noise") > 0), F.col("signal") / F.nullif(F.col("noise"), F.lit(0.0))).alias("separation"))


def matrix_of(coefficients: DataFrame, controls: list[str], detectors: list[str]) -> np.ndarray:
    """The matrix of outputs by detectors; a control without separation is refused."""
    held = {(r.control, r.detector): r.coefficient for r in coefficients.collect()}  # outputs x detectors
    out = np.array([[held.get((c, d)) if held.get((c, d)) is not None else np.nan for d in detectors] for c in controls], dtype=float)
    if not np.isfinite(out).all():
        raise ValueError("a control has no positive separation from its negative population")
    return out


def signature_cosines(signatures: np.ndarray, names: list[str]) -> list[tuple[str, str, float]]:
    """Cosines between signatures, of each pair once."""
    unit = signatures / np.linalg.norm(signatures, axis=1, keepdims=True)
    c = unit @ unit.T
    return [(names[j], names[i], float(c[i, j])) for i in range(len(names)) for j in range(i)]


def autofluorescence_row(stats: DataFrame, control: str, detectors: list[str], background: np.ndarray | None = None) -> np.ndarray:
    """A reference of unstained events: its medians less the background over their peak."""
    held = {r.detector: r.median for r in stats.where(F.col("control") == control).collect()}
    response = np.array([held[d] for d in detectors], float) - (0 if background is None else background)
    if response.max() <= 1e-10 * max(1.0, np.abs(response).max()):
        raise ValueError("the reference has no signal over its background")
    return response / response.max()


def angle_to_span(row: np.ndarray, others: np.ndarray) -> float:
    """Degrees between a signature and the span of the others: small if it cannot be told apart."""
    unit = row / np.linalg.norm(row)
    q, _ = np.linalg.qr(others.T)
    return float(np.degrees(np.arcsin(min(1.0, np.linalg.norm(unit - q @ (q.T @ unit))))))


def equal_count_bins(events: DataFrame, keys: list[str], value: str, order: list[str], bins: int) -> DataFrame:
    """``events`` with ``bin``: stretches of the order by ``value`` whose sizes differ by one at most, the larger ones first.

    Ranks come from sums below in cells of values and from the order of equal values.
    """
    from eventmill.plans.order_statistics import with_sums_below

    below = with_sums_below(events.select(*keys, F.col(value).alias("__v"), F.lit(1).alias("c")), keys, "__v", ["c"])
    below = below.select(*[F.col(k).alias(f"__{k}") for k in keys], "__v", "c_below", "c_total")
    same = F.col(value) == F.col("__v")
    for k in keys:
        same = same & events[k].eqNullSafe(below[f"__{k}"])
    tied = F.row_number().over(Window.partitionBy(*keys, value).orderBy(*order)) - 1
    ranked = events.withColumn("__tied", tied).join(below, same)
    rank, n = F.col("c_below") + F.col("__tied"), F.col("c_total")
    small, extra = F.floor(n / bins), n % bins
    head = (small + 1) * extra
    place = F.when(rank < head, F.floor(rank / (small + 1))).otherwise(extra + F.floor((rank - head) / F.nullif(small, F.lit(0))))
    return ranked.withColumn("bin", place.cast("int")).drop("__tied", "__v", "c_below", "c_total", *[f"__{k}" for k in keys])


def spreading(events: DataFrame, control: str, primary: str, outputs: dict[str, Column], order: list[str], bins: int = 256, significance: float = 0.05) -> DataFrame:
    """``control, secondary, coefficient, status, baseline_noise, p_value``: how a stain's signal widens the other outputs.

    Events of a control are cut into bins of equal counts by its primary output. The 84th less the 50th percentile of
    a secondary is fitted on the signed root of the primary's median; then, less the noise at zero, again through
    the origin. ``primary`` names the output of a control's own stain.
    """
    cells = F.array(*[F.struct(F.lit(n).alias("secondary"), finite(c).alias("v")) for n, c in outputs.items()])
    own = F.when(F.lit(False), F.lit(None).cast("double"))
    for n, c in outputs.items():
        own = own.when(F.col(primary) == n, finite(c))
    ok = reduce(lambda a, b: a & b, [is_finite(c) for c in outputs.values()])
    rows = events.where(ok).select(F.col(control).alias("control"), F.col(primary).alias("primary"), own.alias("x"), cells.alias("cells"), *order)
    cut = equal_count_bins(rows, ["control"], "x", order, bins)
    long = cut.select("control", "primary", "bin", "x", F.explode("cells").alias("c")).select("control", "primary", "bin", "x", "c.*").where("secondary <> primary")
    b = long.groupBy("control", "secondary", "bin").agg(F.percentile("x", 0.5).alias("x"), F.percentile("v", [0.5, 0.84]).alias("q"))
    b = materialize(b.select("control", "secondary", "bin", tempered_root(F.col("x")).alias("x"), (F.col("q")[1] - F.col("q")[0]).alias("sd")), "spread")
    keys = ["control", "secondary"]
    first = linear_fits(b, keys, F.col("x"), F.col("sd")).select(*keys, F.col("intercept").alias("baseline_noise"))
    moved = b.join(first, keys).withColumn("adjusted", tempered_root(F.col("sd") * F.col("sd") - F.col("baseline_noise") * F.col("baseline_noise")))
    final = linear_fits(moved, keys, F.col("x"), F.col("adjusted"), intercept=False).join(first, keys)
    status = F.when(F.col("slope") <= 0, "negative").when(F.col("p_value") >= significance, "not significant").otherwise("positive")
    return final.select(*keys, F.when(status == "positive", F.col("slope")).otherwise(0.0).alias("coefficient"), status.alias("status"), "baseline_noise", "p_value")


def trimmed_pairs(rows: DataFrame, keys: list[str], x: str, y: str, fraction: float = 0.01, minimum: int = 3) -> DataFrame:
    """Rows strictly between the order statistics at ``fraction`` from both ends, on both axes.

    A constant axis is not trimmed. Where too few are left by the second axis, its ends stay inside.
    """
    named = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))
    rows = rows.where(named)
    many = lambda n: F.rint(n * fraction).cast("long")
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    for axis in (x, y):
        ends = order_statistics(rows, keys, F.col(axis), [fraction, 1 - fraction, 0.0, 1.0], [lambda n: many(n) - 1, lambda n: n - many(n), lambda n: F.lit(0), lambda n: n - 1])
        q, n = F.col("q"), F.col("n")
        ends = ends.select(*keys, q[0].alias(f"lo_{axis}"), q[1].alias(f"hi_{axis}"), (q[2] == q[3]).alias(f"flat_{axis}"), many(n).alias(f"count_{axis}"))
        groups = groups.join(ends, keys)
    groups = materialize(groups, "ends")
    bare = rows.columns
    free = lambda a: (F.col(f"count_{a}") == 0) | F.col(f"flat_{a}")
    open_ = lambda a: (F.col(a) > F.col(f"lo_{a}")) & (F.col(a) < F.col(f"hi_{a}"))
    closed = lambda a: F.col(a).between(F.col(f"lo_{a}"), F.col(f"hi_{a}"))
    inside = {"__x": free(x) | open_(x), "__y": free(y) | open_(y), "__tied": free(y) | closed(y)}
    told = with_groups(rows, groups, keys, "n").withColumns(inside)
    few = told.groupBy(*keys).agg((F.count_if(F.col("__x") & F.col("__y")) < minimum).alias("__few"), (F.count_if(F.col("__x") & F.col("__tied")) >= minimum).alias("__enough"))
    groups = materialize(groups.join(few, keys), "ends")
    told = with_groups(rows, groups, keys, "n").withColumns(inside)
    return told.where(F.col("__x") & F.when(F.col("__few") & F.col("__enough"), F.col("__tied")).otherwise(F.col("__y"))).select(*bare)


#: Huber's constant, the median residual of a normal variable, and the change of residuals that settles a line.
HUBER, NORMAL_MEDIAN, SETTLED = 1.345, 0.6745, 1e-4


def huber_lines(rows: DataFrame, keys: list[str], x: str, y: str, rounds: int = 100) -> DataFrame:
    """``keys, n, intercept, slope, iterations, converged``: lines with Huber's weights, k 1.345 times a scale from the median residual.

    A round takes the medians of residuals and then one sum of weighted moments, over all groups at once; how far residuals have moved
    follows from the lines and the moments of the rows, which do not change. Groups that have settled keep
    their line; those that do not in ``rounds`` get the least-squares line.
    """
    z = materialize(rows.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "points")
    fixed = z.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("vxy"))
    slope = F.col("vxy") / F.nullif(F.col("vx"), F.lit(0.0))
    # height: the line at the mean of x
    line = fixed.withColumns({"slope": slope, "height": F.when(slope.isNotNull(), F.col("my")), "iterations": F.lit(0), "settled": slope.isNull()})
    line = materialize(line.withColumn("slope0", F.col("slope")), "lines")
    for k in range(1, rounds + 1):
        still = line.where("NOT settled")
        if still.isEmpty():
            break
        dx = F.col("x") - F.col("mx")
        r = null_safe_join(z, still.select(*keys, "mx", "slope", "height"), keys).withColumn("r", F.col("y") - F.col("height") - F.col("slope") * dx)
        scale = percentiles(r, keys, F.abs("r"), [0.5]).select(*keys, (F.col("q")[0] / NORMAL_MEDIAN).alias("scale"))
        w = F.when(F.col("scale") > 0, F.least(F.lit(1.0), HUBER * F.col("scale") / F.greatest(F.abs("r"), F.lit(1e-300)))).otherwise(1.0)
        m = null_safe_join(r, scale, keys).select(*keys, "scale", w.alias("w"), dx.alias("u"), F.col("r"))
        # the line of residuals, which adds to the last one
        s = m.groupBy(*keys).agg(F.max("scale").alias("scale"), *[F.sum(e).alias(n) for n, e in {"s0": F.col("w"), "s1": F.col("w") * F.col("u"), "s2": F.col("w") * F.col("u") * F.col("u"), "t0": F.col("w") * F.col("r"), "t1": F.col("w") * F.col("u") * F.col("r")}.items()])
        more = (F.col("t1") - F.col("s1") * F.col("t0") / F.col("s0")) / F.nullif(F.col("s2") - F.col("s1") * F.col("s1") / F.col("s0"), F.lit(0.0))
        step = s.select(*keys, "scale", more.alias("more"), ((F.col("t0") - more * F.col("s1")) / F.col("s0")).alias("lift"))
        told = null_safe_join(line, step, keys, "left")
        open_ = ~F.col("settled")
        off = F.col("my") - F.col("height")
        before = off * off + F.col("vy") - 2 * F.col("slope") * F.col("vxy") + F.col("slope") * F.col("slope") * F.col("vx")
        change = F.sqrt((F.col("lift") * F.col("lift") + F.col("more") * F.col("more") * F.col("vx")) / F.greatest(F.lit(1e-20) / F.col("n"), before))
        exact = F.col("scale") <= 2.220446049250313e-16 * F.greatest(F.lit(1.0), F.abs("slope"))
        moves = open_ & ~exact & F.col("more").isNotNull()
        line = materialize(
            told.select(
                *keys, "n", "mx", "my", "vx", "vy", "vxy", "slope0",
                F.when(moves, F.col("slope") + F.col("more")).otherwise(F.col("slope")).alias("slope"),
                F.when(moves, F.col("height") + F.col("lift")).otherwise(F.col("height")).alias("height"),
                F.when(open_, k).otherwise(F.col("iterations")).alias("iterations"),
                (F.col("settled") | exact | F.coalesce(change <= SETTLED, F.lit(False))).alias("settled"),
            ),
            "lines",
        )
    own = F.col("settled") & F.col("slope").isNotNull()
    final = F.when(own, F.col("slope")).otherwise(F.col("slope0"))
    at_mean = F.when(own, F.col("height")).otherwise(F.col("my"))
    return line.select(*keys, "n", (at_mean - final * F.col("mx")).alias("intercept"), final.alias("slope"), "iterations", F.col("settled").alias("converged"))


def embedded_matrix(keyword: Column) -> Column:
    """Struct(names, matrix) of an embedded spillover text ``n, names ..., n x n values``; NULL if its size or a value is wrong."""
    parts = F.transform(F.split(keyword, ","), lambda x: F.trim(x))
    n = parts[0].try_cast("int")
    names = F.slice(parts, F.lit(2), n)
    values = F.transform(F.slice(parts, n + 2, n * n), lambda x: x.try_cast("double"))
    ok = (n > 0) & (F.size(parts) == 1 + n + n * n) & (F.size(F.array_distinct(names)) == n) & ~F.exists(values, lambda v: v.isNull() | F.isnan(v))
    rows = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(values, k * n + 1, n))
    return F.when(ok, F.struct(names.alias("names"), rows.alias("matrix")))


def preprocessed(channels: dict[str, Column], timestep: float | None = None, amplifier: dict[str, tuple[float, float, float]] | None = None, gain: dict[str, float] | None = None, time: str = "Time") -> dict[str, Column]:
    """Acquired values as measurements: time by its step, a log amplifier (decades, offset, range) by 10^(d v / r) z, else over its gain."""
    out = {}
    for n, c in channels.items():
        if n.lower() == time.lower() and timestep is not None:
            out[n] = c * timestep
        elif amplifier and n in amplifier and amplifier[n][0] > 0:
            d, z, r = amplifier[n]
            out[n] = F.pow(F.lit(10.0), c * (d / r)) * (z or 1.0)
        else:
            out[n] = c / (gain or {}).get(n, 1.0)
    return out
