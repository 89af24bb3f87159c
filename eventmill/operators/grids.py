"""Density grids of two channels: extents, smoothing, highest-density regions, peaks, density and magnetic gates.

A grid has at most a few hundred bins an axis. Events become cells in one aggregation;
everything after it works on cells, and what needs whole neighbourhoods runs on the driver
on an array of that bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from eventmill.functions.columns import finite, is_finite
from eventmill.plans.order_statistics import percentiles

MOST_BINS = 512


class Uncovered(ValueError):
    """The view holds less than the wanted share of all events, so no region of it does."""


def extents(events: DataFrame, keys: list[str], value: Column, full: bool = False) -> DataFrame:
    """``keys, low, high``: the view of an axis, 0.1 to 99.9 % or all of the finite values, padded by 4 %; without values 0 to 1."""
    rows = events.select(*keys, finite(value).alias("v"))
    every = rows.groupBy(*keys).agg(F.max(F.abs("v")).alias("scale"), F.min("v").alias("a"), F.max("v").alias("b"))
    if full:
        told = every.withColumns({"lo": F.col("a"), "hi": F.col("b")})
    else:
        q = percentiles(rows, keys, F.col("v"), [0.001, 0.999])
        told = (every.join(q, keys, "left") if keys else every.crossJoin(F.broadcast(q))).withColumns({"lo": F.col("q")[0], "hi": F.col("q")[1]})
    s = F.greatest("scale", F.lit(1e-300))
    # the padding of a single value is of its scale, and 1 at least
    pad = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) * 0.04).otherwise(F.greatest(F.lit(1.0), F.abs("lo") * 0.1) + 0 * s)
    return told.select(*keys, F.coalesce(F.col("lo") - pad, F.lit(0.0)).alias("low"), F.coalesce(F.col("hi") + pad, F.lit(1.0)).alias("high"))


def cell(v: Column, low: float, high: float, bins: int) -> Column:
    """The bin of a value on [low, high], the last one closed; NULL outside."""
    return F.when(is_finite(v) & v.between(low, high), F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1)).cast("int"))


def grid_counts(events: DataFrame, keys: list[str], x: Column, y: Column, bounds: tuple[float, float, float, float], bins: int) -> DataFrame:
    """``keys, bx, by, n`` of the cells that hold events."""
    rows = events.select(*keys, cell(x, bounds[0], bounds[1], bins).alias("bx"), cell(y, bounds[2], bounds[3], bins).alias("by"))
    return rows.where("bx IS NOT NULL AND by IS NOT NULL").groupBy(*keys, "bx", "by").agg(F.count("*").alias("n"))


def smoothed(cells: DataFrame, keys: list[str], bins: int, sigma: float) -> DataFrame:
    """``keys, bx, by, n, density``: Gaussian weights over cells, nothing beyond the edges, scaled to the same total.

    Each cell gives its count to its neighbours along one axis, then along the other; a cell that nothing reaches is not listed.
    """
    reach = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights /= weights.sum()
    offsets = F.array(*[F.struct(F.lit(int(d)).alias("d"), F.lit(float(w)).alias("w")) for d, w in zip(range(-reach, reach + 1), weights)])
    told = cells.select(*keys, "bx", "by", F.col("n").cast("double").alias("v"))
    for axis in ("bx", "by"):
        spread = told.withColumn("o", F.explode(offsets))
        spread = spread.withColumns({axis: F.col(axis) + F.col("o.d"), "v": F.col("v") * F.col("o.w")}).where(F.col(axis).between(0, bins - 1))
        told = spread.groupBy(*keys, "bx", "by").agg(F.sum("v").alias("v"))
    joined = told.join(cells, [*keys, "bx", "by"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy(*keys)  # cells of one grid
    return joined.withColumn("density", F.col("v") * F.sum("n").over(w) / F.nullif(F.sum("v").over(w), F.lit(0.0))).drop("v")


def coverages(spacing: float | str) -> list[float]:
    """Shares of events for contours: every ``spacing`` percent, or halves of 95 % for ``log``."""
    return sorted([0.95 / 2**i for i in range(10)] if spacing == "log" else [k * float(spacing) / 100 for k in range(1, int(100 / float(spacing)))])


def highest_density(cells: DataFrame, keys: list[str], shares: list[float], denominator: DataFrame | None = None, density: str = "n") -> DataFrame:
    """``keys, coverage, threshold, cells, events, estimated, tied``: the densest cells that together reach each share of events.

    Cells as dense as the last one are inside. ``denominator(keys, total)`` counts events outside the grid too;
    a share that the grid does not reach has no threshold.
    """
    levels = cells.groupBy(*keys, density).agg(F.count("*").alias("k"), F.sum("n").alias("held"))
    down = Window.partitionBy(*keys).orderBy(F.desc(density)).rowsBetween(Window.unboundedPreceding, 0)  # densities of one grid
    mass = F.col(density) * F.col("k")
    run = levels.select(*keys, density, "k", F.sum(mass).over(down).alias("run"), F.sum("k").over(down).alias("cells_run"), F.sum("held").over(down).alias("events_run"), F.sum(mass).over(Window.partitionBy(*keys)).alias("inside"))
    if denominator is None:
        run = run.withColumn("total", F.col("inside"))
    else:
        run = run.join(denominator.select(*keys, "total"), keys) if keys else run.crossJoin(F.broadcast(denominator.select("total")))
    many = run.withColumn("coverage", F.explode(F.array(*map(F.lit, shares))))
    reached = F.col("run") >= F.col("coverage") * F.col("total") - 1e-9
    got = many.groupBy(*keys, "coverage").agg(F.max(F.when(reached, F.struct(F.col(density).alias("threshold"), "cells_run", "events_run", "run", "k"))).alias("r"), F.max("total").alias("total"))
    return got.select(*keys, "coverage", F.col("r.threshold").alias("threshold"), F.col("r.cells_run").alias("cells"), F.col("r.events_run").alias("events"), (F.col("r.run") / F.nullif(F.col("total"), F.lit(0))).alias("estimated"), F.col("r.k").alias("tied"))


def bands(cells: DataFrame, levels: DataFrame, keys: list[str], density: str = "n") -> DataFrame:
    """``cells`` with ``band``, the number of thresholds that a cell reaches; 0 lies outside the outermost one."""
    cuts = levels.where("threshold IS NOT NULL").groupBy(*keys).agg(F.array_sort(F.collect_set("threshold")).alias("cuts"))
    told = cells.join(cuts, keys, "left") if keys else cells.crossJoin(F.broadcast(cuts))  # one row
    return told.withColumn("band", F.size(F.filter(F.coalesce("cuts", F.array().cast(cuts.schema["cuts"].dataType)), lambda c: c <= F.col(density)))).drop("cuts")


def outliers(events: DataFrame, banded: DataFrame, x: Column, y: Column, bounds: tuple[float, float, float, float], bins: int) -> DataFrame:
    """Finite events outside the outermost region or the grid, by the cell that they fall into."""
    rows = events.where(is_finite(x) & is_finite(y)).withColumns({"__bx": cell(x, bounds[0], bounds[1], bins), "__by": cell(y, bounds[2], bounds[3], bins)})
    inside = banded.where("band > 0").select(F.col("bx").alias("__bx"), F.col("by").alias("__by"))
    return rows.join(F.broadcast(inside), ["__bx", "__by"], "left_anti").drop("__bx", "__by")  # at most bins^2 cells


def to_array(cells: DataFrame, bins: int, value: str = "n") -> np.ndarray:
    """The grid of one view on the driver, [by, bx]: at most ``MOST_BINS`` squared."""
    if bins > MOST_BINS:
        raise ValueError("the grid is too fine for the driver")
    out = np.zeros((bins, bins))
    for r in cells.select("bx", "by", value).collect():
        out[r["by"], r["bx"]] = r[value]
    return out


def local_peaks(grid: np.ndarray) -> list[tuple[int, int]]:
    """(by, bx) of cells with more than 0 that no neighbour exceeds; of a plateau its first cell."""
    padded = np.pad(grid, 1, constant_values=-np.inf)
    around = np.stack([padded[1 + a : 1 + a + grid.shape[0], 1 + b : 1 + b + grid.shape[1]] for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)])
    top = (grid > 0) & (grid >= around.max(0))
    out, seen = [], np.zeros(grid.shape, bool)
    for j, i in zip(*np.nonzero(top)):
        if seen[j, i]:
            continue
        whole, flat, todo = True, [], [(j, i)]
        seen[j, i] = True
        while todo:
            a, b = todo.pop()
            flat.append((a, b))
            for c in range(max(0, a - 1), min(grid.shape[0], a + 2)):
                for d in range(max(0, b - 1), min(grid.shape[1], b + 2)):
                    if grid[c, d] > grid[j, i]:
                        whole = False
                    elif grid[c, d] == grid[j, i] and not seen[c, d]:
                        seen[c, d] = True
                        todo.append((c, d))
        if whole:
            out.append(min(flat))
    return out


def connected_region(included: np.ndarray, seed: tuple[int, int]) -> np.ndarray:
    """The cells of ``included`` that reach the seed side by side."""
    region = np.zeros(included.shape, bool)
    if not included[seed]:
        return region
    region[seed] = True
    while True:
        grown = region.copy()
        grown[1:] |= region[:-1]
        grown[:-1] |= region[1:]
        grown[:, 1:] |= region[:, :-1]
        grown[:, :-1] |= region[:, 1:]
        grown &= included
        if (grown == region).all():
            return region
        region = grown


def region_rings(region: np.ndarray, bounds: tuple[float, float, float, float]) -> tuple[list[tuple[float, float]], list[list[tuple[float, float]]]]:
    """The outer ring and the holes of cells [by, bx] that hang together side by side, as corners in the axes' units.

    The sides between a cell of the region and one outside are laid end to end, the region on their left. Where two cells touch
    at a corner alone, a ring stays with its cell, so rings do not cross. Straight corners are left out.
    """
    rows, columns = region.shape
    padded = np.pad(region, 1)
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for j, i in zip(*np.nonzero(region), strict=True):
        sides = (((i, j), (i + 1, j), (j, i + 1)), ((i + 1, j), (i + 1, j + 1), (j + 1, i + 2)), ((i + 1, j + 1), (i, j + 1), (j + 2, i + 1)), ((i, j + 1), (i, j), (j + 1, i)))
        for start, end, neighbour in sides:
            if not padded[neighbour]:
                after.setdefault((int(start[0]), int(start[1])), []).append((int(end[0]), int(end[1])))
    rings = []
    while after:
        at = next(iter(after))
        ring, way = [], (0, 0)
        while at in after:
            ways = after[at]
            # the sharpest turn to the left keeps to the same cell
            turn = max(range(len(ways)), key=lambda k: way[0] * (ways[k][1] - at[1]) - way[1] * (ways[k][0] - at[0]))
            to = ways.pop(turn)
            if not ways:
                del after[at]
            step = (to[0] - at[0], to[1] - at[1])
            if step != way:
                ring.append(at)
            at, way = to, step
        rings.append(ring)
    width, height = (bounds[1] - bounds[0]) / columns, (bounds[3] - bounds[2]) / rows
    area = [sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, [*r[1:], r[0]], strict=True)) for r in rings]
    real = [[(bounds[0] + x * width, bounds[2] + y * height) for x, y in r] for r in rings]
    outer = [r for r, a in zip(real, area, strict=True) if a > 0]
    if len(outer) != 1:
        raise ValueError("the cells do not hang together")
    return outer[0], [r for r, a in zip(real, area, strict=True) if a < 0]


def dense_region(events: DataFrame, x: Column, y: Column, bounds: tuple[float, float, float, float], bins: int, coverage: float, seed: tuple[float, float], sigma: float = 0.0) -> np.ndarray:
    """The cells [by, bx] of the highest-density region of a share of events that hang together with a seed point's."""
    cells = grid_counts(events, [], x, y, bounds, bins)
    value = "n"
    if sigma > 0:
        cells, value = smoothed(cells, [], bins, sigma), "density"
    total = events.agg(F.count_if(is_finite(x) & is_finite(y)).alias("total"))
    level = highest_density(cells, [], [coverage], total, value).first()
    if level is None or level.threshold is None:
        raise Uncovered("the view holds too few events for this coverage")
    grid = to_array(cells, bins, value)
    at = tuple(min(bins - 1, max(0, int((v - lo) / (hi - lo) * bins))) for v, lo, hi in ((seed[1], *bounds[2:]), (seed[0], *bounds[:2])))
    return connected_region(grid >= level.threshold, at)


def density_gate(events: DataFrame, x: Column, y: Column, bounds: tuple[float, float, float, float], bins: int, coverage: float, seed: tuple[float, float], sigma: float = 0.0) -> Column:
    """Membership in the cells of ``dense_region``."""
    region = dense_region(events, x, y, bounds, bins, coverage, seed, sigma)
    inside = [int(j) * bins + int(i) for j, i in zip(*np.nonzero(region))]
    where = cell(y, bounds[2], bounds[3], bins) * bins + cell(x, bounds[0], bounds[1], bins)
    return F.coalesce(where.isin(inside), F.lit(False))


def density_polygon(events: DataFrame, x: Column, y: Column, bounds: tuple[float, float, float, float], bins: int, coverage: float, seed: tuple[float, float], sigma: float = 0.0) -> tuple[list[tuple[float, float]], list[list[tuple[float, float]]]]:
    """``dense_region`` as outer ring and holes, for ``gates.polygon_with_holes``: a gate that can be kept, shown and copied.

    It holds the events of the cells, but for such that lie exactly on a side.
    """
    region = dense_region(events, x, y, bounds, bins, coverage, seed, sigma)
    if not region.any():
        raise ValueError("the seed lies outside the region")
    return region_rings(region, bounds)


def magnetic_shift(events: DataFrame, shape: Callable[[Column, Column], Column], x: Column, y: Column, center: tuple[float, float], size: tuple[float, float], most_shift: float, divisions: int = 32) -> tuple[float, float]:
    """How far a gate's shape moves to the nearest local maximum of its own counts, within ``most_shift`` sizes; (0, 0) if none is better.

    Cells of size / ``divisions`` are counted once. Counts of the moved shape come from cells, and the best place
    and its neighbours are counted exactly in one pass; the result never holds fewer events than the anchor.
    """
    step = (size[0] / divisions, size[1] / divisions)
    reach = int(math.ceil(most_shift * divisions))
    half = reach + divisions
    bx = F.floor((x - (center[0] - half * step[0])) / step[0]).cast("int")
    by = F.floor((y - (center[1] - half * step[1])) / step[1]).cast("int")
    n = 2 * half
    cells = events.where(is_finite(x) & is_finite(y)).select(bx.alias("bx"), by.alias("by")).where(F.col("bx").between(0, n - 1) & F.col("by").between(0, n - 1)).groupBy("bx", "by").agg(F.count("*").alias("n"))
    grid = np.zeros((n, n))
    for r in cells.collect():  # n squared at most
        grid[r["by"], r["bx"]] = r["n"]
    # the shape on cell centers, as the gate itself sees them
    spark = events.sparkSession
    points = spark.range(divisions * divisions).select(F.col("id").alias("k"), (center[0] - size[0] / 2 + (F.col("id") % divisions + 0.5) * step[0]).alias("px"), (center[1] - size[1] / 2 + (F.floor(F.col("id") / divisions) + 0.5) * step[1]).alias("py"))
    mask = np.zeros((divisions, divisions))
    for r in points.where(shape(F.col("px"), F.col("py"))).collect():
        mask[r.k // divisions, r.k % divisions] = 1.0
    start = half - divisions // 2
    counts = np.zeros((2 * reach + 1, 2 * reach + 1))
    for a, b in zip(*np.nonzero(mask)):
        counts += grid[start - reach + a : start + reach + 1 + a, start - reach + b : start + reach + 1 + b]
    peaks = sorted(local_peaks(counts), key=lambda p: ((p[0] - reach) ** 2 + (p[1] - reach) ** 2, p))
    near = [p for p in peaks if math.hypot(p[0] - reach, p[1] - reach) <= most_shift * divisions]
    if not near:
        return 0.0, 0.0
    j, i = near[0]
    tries = [(0.0, 0.0)] + [((i + b - reach) * step[0], (j + a - reach) * step[1]) for a in (-1, 0, 1) for b in (-1, 0, 1) if math.hypot(j + a - reach, i + b - reach) <= most_shift * divisions]
    exact = events.agg(*[F.count_if(shape(x - dx, y - dy)).alias(f"t{k}") for k, (dx, dy) in enumerate(tries)]).first()
    best = max(range(len(tries)), key=lambda k: (exact[k], -math.hypot(*tries[k]), -k))
    return tries[best] if exact[best] > exact[0] else (0.0, 0.0)


def view_counts(events: DataFrame, keys: list[str], x: Column, y: Column | None, bounds: tuple[float, ...]) -> DataFrame:
    """``keys, n, n_finite, visible, outside``: what a view with closed bounds shows of a population."""
    axes = [(x, *bounds[:2])] + ([(y, *bounds[2:])] if y is not None else [])
    good = reduce(lambda a, b: a & b, [is_finite(c) for c, _, _ in axes])
    seen = reduce(lambda a, b: a & b, [c.between(lo, hi) for c, lo, hi in axes])
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(good).alias("n_finite"), F.count_if(good & seen).alias("visible"), F.count_if(good & ~F.coalesce(seen, F.lit(False))).alias("outside"))


def backgate_counts(events: DataFrame, keys: list[str], plotted: Column, highlighted: Column, x: Column, y: Column, bounds: tuple[float, float, float, float]) -> DataFrame:
    """``keys, plotted, highlighted, percent, visible``: a population marked in the plot of another one, over finite events."""
    shown = plotted & is_finite(x) & is_finite(y)
    marked = shown & highlighted
    told = events.groupBy(*keys).agg(F.count_if(shown).alias("plotted"), F.count_if(marked).alias("highlighted"), F.count_if(marked & x.between(*bounds[:2]) & y.between(*bounds[2:])).alias("visible"))
    return told.withColumn("percent", 100.0 * F.col("highlighted") / F.nullif(F.col("plotted"), F.lit(0)))


def display_sample(events: DataFrame, ids: list[str], limit: int, seed: int = 42) -> DataFrame:
    """At most ``limit`` events for display, the same ones each time: those of the least hashes, found without sorting all."""
    return events.withColumn("__hash", F.xxhash64(*ids, F.lit(seed))).orderBy("__hash", *ids).limit(limit).drop("__hash")


def quotas(counts: dict[object, int], most: int) -> dict[object, int]:
    """Equal shares of ``most`` events for sources; what one cannot give goes to the others, first sources first."""
    out = dict.fromkeys(counts, 0)
    left = min(most, sum(counts.values()))
    while left:
        open_sources = [k for k in counts if out[k] < counts[k]]
        share, rest = divmod(left, len(open_sources))
        for at, k in enumerate(open_sources):
            add = min(share + (at < rest), counts[k] - out[k])
            out[k] += add
            left -= add
    return out


def balanced_sample(events: DataFrame, sample: str, ids: list[str], most: int, seed: int = 42, by_id: bool = False) -> DataFrame:
    """Events of every source up to its quota, by the least hashes, or the first by id."""
    counts = {r[0]: r[1] for r in events.groupBy(sample).count().orderBy(sample).collect()}  # one row a source
    held = quotas(counts, most)
    kind = events.schema[sample].dataType.simpleString()
    table = events.sparkSession.createDataFrame(list(held.items()), f"__s {kind}, __quota long")
    order = ids if by_id else [F.xxhash64(*ids, F.lit(seed)), *ids]
    # a cell of a source keeps its first rows, then the source; so no window holds a whole source
    told = events.join(F.broadcast(table), F.col(sample).eqNullSafe(F.col("__s"))).withColumn("__cell", F.pmod(F.xxhash64(*ids), F.lit(256)))
    first = F.row_number().over(Window.partitionBy("__s", "__cell").orderBy(*order))
    few = told.withColumn("__in", first).where("__in <= __quota")
    rank = F.row_number().over(Window.partitionBy("__s").orderBy(*order))
    return few.withColumn("__rank", rank).where("__rank <= __quota").drop("__s", "__quota", "__cell", "__in", "__rank")


def proportional_sample(events: DataFrame, ids: list[str], most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` events of all sources together, each with the same chance."""
    return display_sample(events, ids, most, seed)


def evenly_spaced(events: DataFrame, order: str, most: int) -> DataFrame:
    """Events at evenly spaced ranks of ``order``, the first and the last among them; all if there are no more than ``most``."""
    n = events.count()
    if n <= most:
        return events
    at = sorted({int(v) for v in np.linspace(0, n - 1, most)})
    block = F.floor(F.col(order) / 100_000)
    counts = events.groupBy(block.alias("__block")).agg(F.count("*").alias("__n"))
    starts = counts.select("__block", F.coalesce(F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))  # one row a block
    inside = F.row_number().over(Window.partitionBy("__block").orderBy(order)) - 1
    ranked = events.withColumn("__block", block).withColumn("__in", inside).join(starts, "__block").withColumn("__rank", (F.col("__start") + F.col("__in")).cast("long"))
    picked = events.sparkSession.createDataFrame([(v,) for v in at], "__rank long")
    return ranked.join(F.broadcast(picked), "__rank").drop("__block", "__in", "__start", "__rank")
