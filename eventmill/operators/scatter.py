"""Automatic clean-up of scatter: the cells or beads of single-stain controls by the density of two channels.

For each control: trim the margins, find the peak of a wide kernel density outside the debris
corner, keep what is nearer to it than to other peaks, look again with a narrower kernel inside
three robust deviations, and gate the events whose own density passes a level by their convex
hull. All controls go through each step in the same jobs. A task adds up the products of its
events' kernels on a grid of 100 x 100, since a Gaussian of two axes is a product; it hands on
one grid a control, and one hull a control.

Defined results: events that are not finite in both channels are in no gate; a NULL control is
a control; a control for which a step fails (too few events, constant scatter, no peak,
collinear events) has no vertices and its ``reason``; an empty table gives no controls.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from eventmill.functions.columns import is_finite
from eventmill.operators.gates import polygon
from eventmill.plans.order_statistics import percentiles
from eventmill.plans.partials import key_of, summed_arrays
from eventmill.plans.scratch import discard, materialize

GRID = 100
#: Least events, margins, debris corner, factor of the normal reference and of the MAD, deviations kept.
LEAST_EVENTS, MARGIN, CORNER, REFERENCE, MAD, KEPT = 20, 0.01, 0.05, 1.06, 1.4826, 3.0
#: Kernel factors and half widths of the windows of the two searches, and the factor of the last density.
SEARCHES, LAST_FACTOR = ((3.0, 3), (2.0, 2)), 1.0


@dataclass
class Cleanup:
    """The gate of one control, and how it was found."""

    vertices: list[tuple[float, float]] = field(default_factory=list)
    peaks: list[tuple[float, float]] = field(default_factory=list)
    peak_counts: list[int] = field(default_factory=list)
    reason: str | None = None


@dataclass
class _View:
    """A density's axes: least and greatest value and kernel width of each."""

    low: np.ndarray
    high: np.ndarray
    width: np.ndarray
    n: int

    @property
    def axes(self) -> list[np.ndarray]:
        return [np.linspace(self.low[k], self.high[k], GRID) for k in (0, 1)]


def _within(rows: DataFrame, boxes: dict[Any, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Rows strictly inside their control's box; a row a control is broadcast."""
    kind = rows.schema["control"].dataType.simpleString()
    told = [(k, *map(float, (lo[0], hi[0], lo[1], hi[1]))) for k, (lo, hi) in boxes.items()]
    small = rows.sparkSession.createDataFrame(told, f"__of {kind}, __x0 double, __x1 double, __y0 double, __y1 double")
    inside = (F.col("x") > F.col("__x0")) & (F.col("x") < F.col("__x1")) & (F.col("y") > F.col("__y0")) & (F.col("y") < F.col("__y1"))
    return rows.join(F.broadcast(small), F.col("control").eqNullSafe(F.col("__of"))).where(inside).select(*rows.columns)


def _by_axis(rows: DataFrame) -> DataFrame:
    return rows.select("control", F.explode(F.array(F.struct(F.lit(0).alias("axis"), F.col("x").alias("v")), F.struct(F.lit(1).alias("axis"), F.col("y").alias("v")))).alias("a")).select("control", "a.*")


def _views(rows: DataFrame, factor: float) -> dict[Any, _View | str]:
    """The axes of each control's density, or why it has none."""
    told = rows.groupBy("control").agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max, F.stddev_samp)])
    quartiles: dict[Any, dict[int, list[float]]] = {}
    for r in percentiles(_by_axis(rows), ["control", "axis"], F.col("v"), [0.25, 0.75]).collect():  # two rows a control
        quartiles.setdefault(r["control"], {})[r["axis"]] = r["q"]
    out: dict[Any, _View | str] = {}
    for r in told.collect():  # a row a control
        if r["n"] < 3:
            out[r["control"]] = "fewer than three events are left"
            continue
        q = quartiles[r["control"]]
        width = np.array([factor * REFERENCE * min(r[f"stddev_samp_{c}"], (q[k][1] - q[k][0]) / 1.34) * r["n"] ** -0.2 for k, c in enumerate("xy")])
        if not (np.isfinite(width) & (width > 0)).all():
            out[r["control"]] = "scatter is constant"
            continue
        out[r["control"]] = _View(np.array([r["min_x"], r["min_y"]]), np.array([r["max_x"], r["max_y"]]), width, r["n"])
    return out


def _densities(rows: DataFrame, views: dict[Any, _View]) -> dict[Any, np.ndarray]:
    """The kernel density of each control on its grid, [x, y]."""

    def products(control: Any, own: pd.DataFrame) -> np.ndarray | None:
        view = views.get(control)
        if view is None:
            return None
        total = np.zeros((GRID, GRID))
        for a in range(0, len(own), 8192):
            part = [own[c].to_numpy()[a : a + 8192] for c in ("x", "y")]
            kx, ky = (np.exp(-0.5 * ((axis[:, None] - v) / w) ** 2) for axis, v, w in zip(view.axes, part, view.width, strict=True))
            total += kx @ ky.T
        return total

    sums = summed_arrays(rows, "control", products)
    return {k: s / (2 * np.pi * views[k].n * views[k].width.prod()) for k, s in sums.items()}


def density_peaks(density: np.ndarray, reach: int) -> np.ndarray:
    """[i, j] of the cells that no cell within ``reach`` exceeds, the densest first, equal ones by column."""
    top = np.pad(density, reach, mode="edge")
    for axis in (0, 1):
        top = np.lib.stride_tricks.sliding_window_view(top, 2 * reach + 1, axis).max(-1)
    found = np.argwhere((density >= top) & (density > 0))
    return found[np.lexsort((found[:, 0], found[:, 1], -density[found[:, 0], found[:, 1]]))]


def _tiles(rows: DataFrame, search: int, target: int, told: dict[Any, Cleanup]) -> DataFrame:
    """The events whose nearest peak is the wanted one."""
    factor, reach = SEARCHES[search]
    views = _passed(_views(rows, factor), told)
    chosen: dict[Any, tuple[np.ndarray, int]] = {}
    for control, density in _densities(rows, views).items():
        view = views[control]
        found = density_peaks(density, reach)
        at = np.column_stack([axis[found[:, k]] for k, axis in enumerate(view.axes)])
        wanted = 0
        if search == 0:
            outside = np.flatnonzero((((at - view.low) / (view.high - view.low)) > CORNER).any(1))
            wanted = int(outside[0]) + target - 1 if len(outside) else len(at)
        if wanted >= len(at):
            told[control].reason = "no such peak"
            continue
        told[control].peaks.append((float(at[wanted, 0]), float(at[wanted, 1])))
        told[control].peak_counts.append(len(at))
        chosen[control] = (at, wanted)

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for value, own in b.groupby("control", dropna=False):
                if (c := chosen.get(key_of(value))) is None:
                    continue
                for a in range(0, len(own), 8192):
                    part = own.iloc[a : a + 8192]
                    away = ((part[["x", "y"]].to_numpy()[:, None, :] - c[0]) ** 2).sum(2)
                    yield part[away.argmin(1) == c[1]]

    return materialize(rows.mapInPandas(kept, rows.schema), "tile")


def _passed(views: dict[Any, _View | str], told: dict[Any, Cleanup]) -> dict[Any, _View]:
    for control, v in views.items():
        if isinstance(v, str):
            told[control].reason = told[control].reason or v
    return {c: v for c, v in views.items() if not isinstance(v, str)}


def interpolated(density: np.ndarray, view_axes: list[np.ndarray], points: np.ndarray) -> np.ndarray:
    """Bilinear values of a grid at points inside it."""
    at, part = [], []
    for k, axis in enumerate(view_axes):
        i = np.clip(np.searchsorted(axis, points[:, k], "right") - 1, 0, len(axis) - 2)
        at.append(i)
        part.append((points[:, k] - axis[i]) / (axis[i + 1] - axis[i]))
    (i, j), (u, v) = at, part
    low = density[i, j] * (1 - v) + density[i, j + 1] * v
    high = density[i + 1, j] * (1 - v) + density[i + 1, j + 1] * v
    return low * (1 - u) + high * u


def convex_hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull, counter-clockwise from the leftmost one; collinear points are no corners."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points
    # only the lowest and the highest point of each x can be corners
    edge = np.ones(len(points), bool)
    edge[1:-1] = (points[1:-1, 0] != points[:-2, 0]) | (points[1:-1, 0] != points[2:, 0])
    points = points[edge].tolist()

    def half(order: list) -> list:
        out: list = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return np.array(half(points)[:-1] + half(points[::-1])[:-1])


def _hulls(rows: DataFrame) -> dict[Any, np.ndarray]:
    """Each control's convex hull, from the hulls of tasks."""
    kind = rows.schema["control"].dataType.simpleString()

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[Any, np.ndarray] = {}
        for b in batches:
            for value, own in b.groupby("control", dropna=False):
                k = key_of(value)
                held[k] = convex_hull(np.concatenate([held.get(k, np.zeros((0, 2))), own[["x", "y"]].to_numpy()]))
        for k, h in held.items():
            yield pd.DataFrame({"control": [k] * len(h), "x": h[:, 0], "y": h[:, 1]})

    few = rows.select("control", "x", "y").mapInPandas(corners, f"control {kind}, x double, y double")
    # hulls of hulls, each of a few corners, until the driver has one a control
    few = few.repartition(16).mapInPandas(corners, few.schema)
    out: dict[Any, list] = {}
    for r in few.toLocalIterator():
        out.setdefault(r["control"], []).append((r["x"], r["y"]))
    return {k: convex_hull(np.array(v)) for k, v in out.items()}


def scatter_cleanup(events: DataFrame, control: str, x: Column, y: Column, ranges: tuple[float, float], threshold: float = 0.33, target: int = 1) -> dict[Any, Cleanup]:
    """For each control the clean-up gate. ``ranges`` end the axes; ``threshold`` is the share between the least and the greatest density of kept events; ``target`` counts peaks outside the corner."""
    rows = events.where(is_finite(x) & is_finite(y)).select(F.col(control).alias("control"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    rows = materialize(rows, "scatter")
    told = {r["control"]: Cleanup() for r in events.select(F.col(control).alias("control")).distinct().collect()}  # controls are few
    boxes: dict[Any, tuple[np.ndarray, np.ndarray]] = {}
    for r in rows.groupBy("control").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).collect():
        low = np.maximum(0.0, [r["x0"], r["y0"]])
        high = np.minimum(ranges, [r["x1"], r["y1"]])
        if r["n"] < LEAST_EVENTS:
            told[r["control"]].reason = "too few finite events"
        elif (high <= low).any():
            told[r["control"]].reason = "no positive range"
        else:
            boxes[r["control"]] = (low + MARGIN * (high - low), low + (1 - MARGIN) * (high - low))
    if not boxes:
        return _ended(told)
    bound = _tiles(_within(rows, boxes), 0, target, told)
    regions = _robust_boxes(bound, boxes)
    discard(bound)
    if not regions:
        return _ended(told)
    tile = _tiles(_within(rows, regions), 1, 1, told)
    views = _passed(_views(tile, LAST_FACTOR), told)
    densities = _densities(tile, views)

    @F.pandas_udf("double")
    def own_density(c: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=c.index)
        for value, own in c.groupby(c, dropna=False):
            if (k := key_of(value)) in densities:
                out[own.index] = interpolated(densities[k], views[k].axes, np.column_stack([x[own.index], y[own.index]]))
        return out

    scored = materialize(tile.withColumn("score", own_density("control", "x", "y")), "scored")
    discard(tile)
    level = scored.groupBy("control").agg((F.min("score") * (1 - threshold) + F.max("score") * threshold).alias("level"))
    own = scored.join(F.broadcast(level.withColumnRenamed("control", "__of")), F.col("control").eqNullSafe(F.col("__of")))  # a row a control
    for c, hull in _hulls(own.where(F.col("score") > F.col("level"))).items():
        if len(hull) < 3:
            told[c].reason = "the events are collinear"
        else:
            told[c].vertices = [(float(a), float(b)) for a, b in hull]
    discard(scored, rows)
    return _ended(told)


def _ended(told: dict[Any, Cleanup]) -> dict[Any, Cleanup]:
    for c in told.values():
        if not c.vertices:
            c.reason = c.reason or "no events pass"
    return told


def _robust_boxes(rows: DataFrame, within: dict[Any, tuple[np.ndarray, np.ndarray]]) -> dict[Any, tuple[np.ndarray, np.ndarray]]:
    """Three robust deviations around each control's medians, not beyond its first box."""
    long = materialize(_by_axis(rows), "axes")
    medians = {(r["control"], r["axis"]): r["q"][0] for r in percentiles(long, ["control", "axis"], F.col("v"), [0.5]).collect()}
    kind = rows.schema["control"].dataType.simpleString()
    centres = rows.sparkSession.createDataFrame([(c, a, m) for (c, a), m in medians.items()], f"__of {kind}, __axis int, __m double")
    off = long.join(F.broadcast(centres), F.col("control").eqNullSafe(F.col("__of")) & (F.col("axis") == F.col("__axis"))).select("control", "axis", F.abs(F.col("v") - F.col("__m")).alias("off"))
    spread = {(r["control"], r["axis"]): KEPT * MAD * r["q"][0] for r in percentiles(off, ["control", "axis"], F.col("off"), [0.5]).collect()}
    discard(long)
    out = {}
    for c in {c for c, _ in medians}:
        m, s = (np.array([d[c, a] for a in (0, 1)]) for d in (medians, spread))
        out[c] = (np.maximum(within[c][0], m - s), np.minimum(within[c][1], m + s))
    return out


def cleaned(control: Column, x: Column, y: Column, gates: dict[Any, Cleanup]) -> Column:
    """Membership of events in their own control's gate, the boundary included."""
    # many rings in one expression stay small as arrays
    parts = [control.eqNullSafe(F.lit(c)) & polygon(x, y, g.vertices, 0) for c, g in gates.items() if g.vertices]
    return F.coalesce(reduce(lambda a, b: a | b, parts, F.lit(False)), F.lit(False))
