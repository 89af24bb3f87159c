"""Time courses: time bins of every sample, smoothing inside measured runs, and named time ranges."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from eventmill.functions.columns import finite
from eventmill.operators.gates import responder, time_range
from eventmill.plans.order_statistics import percentiles

STATISTICS = ("median", "mean", "geometric_mean", "percentile", "percent_positive")


def checked_edges(low: float, high: float, bins: int) -> list[float]:
    """Edges that are exact at both ends; an error if neighbours cannot be told apart."""
    edges = [low * (1 - k / bins) + high * (k / bins) for k in range(bins + 1)]
    edges[0], edges[-1] = low, high
    if not all(map(math.isfinite, edges)) or any(b <= a for a, b in zip(edges, edges[1:])):
        raise ValueError("time bins are narrower than numbers are exact; take fewer bins or wider bounds")
    return edges


def edge(low: Column, high: Column, k: Column, bins: int) -> Column:
    return F.when(k == 0, low).when(k == bins, high).otherwise(low * (1 - k / bins) + high * (k / bins))


def bin_of(t: Column, low: Column, high: Column, bins: int) -> Column:
    """The bin of a time, its lower edge included and the last bin closed; NULL outside."""
    guess = F.greatest(F.lit(0), F.least(F.floor((t - low) / F.nullif(high - low, F.lit(0.0)) * bins), F.lit(bins - 1)))
    right = F.when(t < edge(low, high, guess, bins), guess - 1).when((guess + 1 < bins) & (t >= edge(low, high, guess + 1, bins)), guess + 1).otherwise(guess)
    return F.when((t >= low) & (t <= high), right).cast("int")


def bin_lookup(v: Column, edges: list[float]) -> Column:
    """The interval of irregular ascending edges that holds a value, the last one closed; NULL outside.

    The number of edges that are not above it is found by halving, so the edges may be many.
    """
    bounds = F.array(*map(F.lit, edges))
    steps = [1 << k for k in reversed(range(len(edges).bit_length()))]
    at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, s: F.when((low + s <= len(edges)) & (F.get(bounds, low + s - 1) <= v), low + s).otherwise(low))
    return F.when((v >= edges[0]) & (v <= edges[-1]), F.least(at, F.lit(len(edges) - 1)) - 1).cast("int")


def domains(events: DataFrame, sample: str, clock: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """``sample, low, high``: the given bounds, or those of all finite times of a sample; NULL if they do not increase."""
    t = finite(F.col(clock))
    d = events.groupBy(sample).agg(F.lit(low).cast("double").alias("a") if low is not None else F.min(t).alias("a"), F.lit(high).cast("double").alias("b") if high is not None else F.max(t).alias("b"))
    ok = F.col("a") < F.col("b")
    return d.select(sample, F.when(ok, F.col("a")).alias("low"), F.when(ok, F.col("b")).alias("high"))


def baseline_threshold(events: DataFrame, sample: str, clock: str, signal: Column, population: Column, start: float, end: float, percentile: float) -> DataFrame:
    """``sample, threshold, baseline_count``: a percentile of the signal before a response; the last acquired time is inside."""
    last = events.groupBy(sample).agg(F.max(finite(F.col(clock))).alias("__last"))
    rows = events.join(last, sample)
    t = F.col(clock)
    inside = population & (t >= start) & F.when(F.lit(end) >= F.col("__last"), t <= end).otherwise(t < end)
    told = percentiles(rows.withColumn("__v", F.when(inside, finite(signal))), [sample], F.col("__v"), [percentile / 100])
    return last.select(sample).join(told, sample, "left").select(sample, F.col("q")[0].alias("threshold"), F.coalesce("n", F.lit(0)).alias("baseline_count"))


def time_course(
    events: DataFrame,
    sample: str,
    clock: str,
    signal: Column,
    population: Column,
    bins: int,
    statistic: str = "median",
    minimum_events: int = 1,
    percentile: float = 50.0,
    thresholds: DataFrame | None = None,
    above_only: bool = False,
    low: float | None = None,
    high: float | None = None,
) -> DataFrame:
    """Every time bin of every sample: ``sample, bin, start, end, center, population_count, finite_count, selected_count, responder_count, raw_value``.

    ``thresholds(sample, threshold)`` make responders; without a threshold their figures are NULL.
    A statistic of fewer than ``minimum_events`` values is NULL, a geometric mean also with values up to 0.
    """
    if statistic not in STATISTICS:
        raise ValueError(f"no statistic {statistic!r}")
    if low is not None and high is not None:
        checked_edges(low, high, bins)
    dom = domains(events, sample, clock, low, high).where("low IS NOT NULL")
    dom = dom.join(thresholds.select(sample, "threshold"), sample, "left") if thresholds is not None else dom.withColumn("threshold", F.lit(None).cast("double"))
    rows = events.where(population).select(sample, finite(F.col(clock)).alias("__t"), finite(signal).alias("__v")).where("__t IS NOT NULL").join(dom, sample)
    v = F.col("__v")
    rows = rows.withColumns({"__bin": bin_of(F.col("__t"), F.col("low"), F.col("high"), bins), "__up": v > F.col("threshold")}).where("__bin IS NOT NULL")
    chosen = F.when(F.col("__up"), v) if above_only else v
    n = F.count(chosen)
    value = {
        "median": F.percentile(chosen, 0.5),
        "percentile": F.percentile(chosen, percentile / 100),
        "mean": F.avg(chosen),
        "geometric_mean": F.when(F.min(chosen) > 0, F.exp(F.avg(F.log(F.when(chosen > 0, chosen))))),
        "percent_positive": F.when(F.max("threshold").isNotNull(), 100.0 * F.count_if("__up") / F.nullif(F.count(v), F.lit(0))),
    }[statistic]
    got = rows.groupBy(sample, F.col("__bin").alias("bin")).agg(F.count("*").alias("population_count"), F.count(v).alias("finite_count"), F.count_if("__up").alias("responders"), n.alias("chosen"), F.when(n >= minimum_events, value).alias("raw_value"))
    grid = dom.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    a, b = edge(F.col("low"), F.col("high"), F.col("bin"), bins), edge(F.col("low"), F.col("high"), F.col("bin") + 1, bins)
    counted = lambda c: F.coalesce(c, F.lit(0))
    told = grid.join(got, [sample, "bin"], "left")
    has = F.col("threshold").isNotNull()
    selected = F.when(has, counted("chosen")) if above_only else counted("chosen")
    return told.select(sample, "bin", a.alias("start"), b.alias("end"), (a / 2 + b / 2).alias("center"), counted("population_count").alias("population_count"), counted("finite_count").alias("finite_count"), selected.alias("selected_count"), F.when(has, counted("responders")).alias("responder_count"), "raw_value")


def smoothed(course: DataFrame, sample: str, width: int = 3, sigma: float | None = None) -> DataFrame:
    """Adds ``value``: the raw values averaged over ``width`` bins, or by Gaussian weights of ``sigma`` bins, never across a gap."""
    by = Window.partitionBy(sample).orderBy("bin")  # the bins of a sample
    runs = course.withColumn("__run", F.col("bin") - F.count("raw_value").over(by))
    radius = width // 2
    w = Window.partitionBy(sample, "__run", F.col("raw_value").isNull()).orderBy("bin").rowsBetween(-radius, radius)
    if sigma is None:
        value = F.avg("raw_value").over(w)
    else:
        near = F.collect_list(F.struct("bin", "raw_value")).over(w)
        told = runs.withColumn("__near", near)
        weight = lambda p: F.exp(-0.5 * F.pow((p["bin"] - F.col("bin")) / sigma, F.lit(2.0)))
        zero = F.lit(0.0)
        value = F.aggregate("__near", zero, lambda s, p: s + p["raw_value"] * weight(p)) / F.nullif(F.aggregate("__near", zero, lambda s, p: s + weight(p)), zero)
        runs = told
    return runs.withColumn("value", F.when(F.col("raw_value").isNotNull(), value)).drop("__run", "__near")


def with_ranges(rows: DataFrame, t: Column, ranges: list[tuple[str, float, float]], domain: tuple[float, float] | None = None) -> DataFrame:
    """A row for each named range that holds it; ranges may overlap, and rows in none of them go."""
    held = F.array_compact(F.array(*[F.when(time_range(t, a, b, domain), F.struct(F.lit(n).alias("name"), F.lit(float(a)).alias("from"), F.lit(float(b)).alias("to"))) for n, a, b in ranges]))
    return rows.withColumn("__range", F.explode(held)).withColumns({"range": F.col("__range.name"), "range_start": F.col("__range.from"), "range_end": F.col("__range.to")}).drop("__range")


def range_counts(events: DataFrame, sample: str, clock: str, signal: Column, population: Column, ranges: list[tuple[str, float, float]], domain: tuple[float, float], threshold: float) -> DataFrame:
    """``sample, range, population_count, finite_count, responder_count``."""
    inside = with_ranges(events.where(population), F.col(clock), ranges, domain)
    return inside.groupBy(sample, "range").agg(F.count("*").alias("population_count"), F.count(finite(signal)).alias("finite_count"), F.count_if(responder(signal, threshold)).alias("responder_count"))


def curve_summaries(course: DataFrame, sample: str, ranges: list[tuple[str, float, float]]) -> DataFrame:
    """``sample, range, points, peak, peak_time, mean, slope, auc, covered_duration`` of the curve of ``value`` over bin centers.

    The area runs over neighbouring measured bins only, cut and interpolated at the range's ends.
    """
    by = Window.partitionBy(sample).orderBy("bin")  # the bins of a sample
    c = course.select(sample, "bin", "center", "value", "end", F.lead("center").over(by).alias("next_center"), F.lead("value").over(by).alias("next_value"), F.max("end").over(Window.partitionBy(sample)).alias("__last"))
    named = F.array(*[F.struct(F.lit(n).alias("range"), F.lit(float(a)).alias("from"), F.lit(float(b)).alias("to")) for n, a, b in ranges])
    r = c.withColumn("r", F.explode(named)).select(*c.columns, "r.*")
    at = F.col("center")
    point = F.col("value").isNotNull() & (at >= F.col("from")) & F.when(F.col("to") >= F.col("__last"), at <= F.col("to")).otherwise(at < F.col("to"))
    y, x = F.when(point, F.col("value")), F.when(point, at)
    left, right = F.greatest(at, F.col("from")), F.least(F.col("next_center"), F.col("to"))
    both = F.col("value").isNotNull() & F.col("next_value").isNotNull() & (left < right)
    level = lambda t: F.col("value") + (F.col("next_value") - F.col("value")) * ((t - at) / F.nullif(F.col("next_center") - at, F.lit(0.0)))
    span = F.when(both, right - left)
    area = F.when(both, (level(left) + level(right)) / 2 * (right - left))
    return r.groupBy(sample, "range").agg(
        F.count(y).alias("points"),
        F.max(y).alias("peak"),
        F.min_by(x, F.struct(-y, x)).alias("peak_time"),
        F.avg(y).alias("mean"),
        F.when(F.count(y) >= 2, F.regr_slope(y, x)).alias("slope"),
        F.sum(area).alias("auc"),
        F.coalesce(F.sum(span), F.lit(0.0)).alias("covered_duration"),
    )


def peaks(values: np.ndarray, prominence: float, distance: int = 3) -> list[int]:
    """Middles of the local maxima that rise by ``prominence`` over their surroundings, the higher of two that are close."""
    n = len(values)
    found, i = [], 1
    while i < n - 1:
        j = i
        while j < n - 1 and values[j + 1] == values[i]:
            j += 1
        if values[i - 1] < values[i] and j < n - 1 and values[j + 1] < values[i]:
            found.append((i + j) // 2)
        i = j + 1
    kept: list[int] = []
    for p in sorted(found, key=lambda p: (-values[p], -p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    out = []
    for p in sorted(kept):
        lows = []
        for side in (values[:p][::-1], values[p + 1 :]):
            higher = np.flatnonzero(side > values[p])
            reach = side[: higher[0]] if len(higher) else side
            lows.append(min(reach.min(), values[p]) if len(reach) else values[p])
        if values[p] - max(lows) >= prominence:
            out.append(p)
    return out


def suggested_ranges(course: DataFrame, sample: str, most: int = 8, prominence: float | None = None) -> DataFrame:
    """``sample, range, start, end``: cuts at the lowest bin between consecutive peaks of each measured run; a sample has its bins only."""

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        v, center = rows["value"].to_numpy(dtype=float), rows["center"].to_numpy()
        good = np.isfinite(v)
        turns = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(int)))
        cuts: set[float] = set()
        for a, b in zip(turns[::2], turns[1::2]):
            part = v[a:b] / max(np.abs(v[a:b]).max(), 1e-300)
            effect = prominence / max(np.abs(v[a:b]).max(), 1e-300) if prominence is not None else max(np.ptp(part) * 0.1, 1e-12)
            top = peaks(part, effect)
            cuts |= {center[a + p + int(np.argmin(part[p : q + 1]))] for p, q in zip(top, top[1:])}
        bounds = [rows["start"].iloc[0], *sorted(cuts)[: most - 1], rows["end"].iloc[-1]]
        named = [(rows[sample].iloc[0], f"Range {k + 1}", x, y) for k, (x, y) in enumerate(zip(bounds, bounds[1:])) if x < y]
        return pd.DataFrame(named, columns=[sample, "range", "start", "end"])

    kind = course.schema[sample].dataType.simpleString()
    return course.groupBy(sample).applyInPandas(cut, f"{sample} {kind}, range string, start double, end double")
