"""Spillover matrices and spectral signatures refined until nothing of a stain is left in the other channels.

Every round is one pass over the controls: a task compensates its events by the matrix of the round and adds up, for each
pair of a control's own channel and another one, the moments of a robustly weighted line, the residuals by
logarithmic bucket around the last scale, and both axes by bucket. From the sums follow the next line, the
next scale (a median) and the next trimming bounds, so reweighting and refinement go on together: where they come to rest,
the line is the robust one of the last matrix. What a task hands on has a fixed size.

Defined results: events that are not finite in a detector, or whose control is none of the named ones, are left out; a
control without enough events raises; ``stop_reason`` tells whether the target was reached, the errors no longer
fell, or the rounds ended.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from eventmill.functions.columns import is_finite
from eventmill.functions.scales import NaturalSpline, biex_table
from eventmill.plans.partials import summed_arrays
from eventmill.plans.scratch import discard, materialize

#: Huber's constant, and the median residual of a normal variable.
HUBER, NORMAL_MEDIAN = 1.345, 0.6745
#: Buckets of residuals: so many an octave, so many octaves on either side of the last scale; buckets of an axis.
OCTAVE, OCTAVES, AXIS = 64, 8, 2048
#: Rounds without a smaller error after which the damping falls, and then the refinement ends.
PATIENCE = 10
LEAST_EVENTS = 20


@dataclass
class Refined:
    """The last matrix, and how it came about."""

    matrix: np.ndarray
    stop_reason: str
    rounds: list[dict[str, float]] = field(default_factory=list)

    @property
    def converged(self) -> bool:
        return self.stop_reason == "target_reached"


@dataclass
class _Lines:
    """What a pass knows: for each control (rows) and channel (columns) the line, its scale, and the trimming bounds."""

    intercept: np.ndarray
    slope: np.ndarray
    scale: np.ndarray  # infinite: all weights are 1
    low: np.ndarray
    high: np.ndarray
    low_x: np.ndarray
    high_x: np.ndarray

    @classmethod
    def unknown(cls, k: int, d: int) -> _Lines:
        none, wide = np.zeros((k, d)), np.full((k, d), np.inf)
        return cls(none, none.copy(), wide, -wide, wide.copy(), np.full(k, -np.inf), np.full(k, np.inf))


@dataclass
class _Axis:
    """Buckets that are even on asinh(v / unit), or on v without a unit."""

    low: float
    high: float
    unit: float | None

    def place(self, v: np.ndarray) -> np.ndarray:
        s = v if self.unit is None else np.arcsinh(v / self.unit)
        return np.clip((s - self.low) / (self.high - self.low) * AXIS, 0, AXIS - 1).astype(np.int64)

    def edge(self, place: np.ndarray) -> np.ndarray:
        s = self.low + (self.high - self.low) * place / AXIS
        return s if self.unit is None else self.unit * np.sinh(s)


def _pass(rows: DataFrame, controls: list[str], detectors: list[str], view: Callable[[int, np.ndarray], tuple[np.ndarray, np.ndarray]], lines: _Lines, axis: _Axis) -> np.ndarray:
    """[control, channel]: 6 weighted moments, the buckets of residuals, those of y and those of x. ``view`` gives x and the y of all channels of a control's events."""
    d = lines.slope.shape[1]
    residuals = 2 * OCTAVE * OCTAVES

    def measured(control: Any, own: pd.DataFrame) -> np.ndarray | None:
        if control not in controls:
            return None
        p = controls.index(control)
        total = np.zeros((d, 6 + residuals + 2 * AXIS))
        for a in range(0, len(own), 8192):
            x, y = view(p, own[detectors].to_numpy(float)[a : a + 8192])
            kept = ((x > lines.low_x[p]) & (x < lines.high_x[p]))[:, None] & (y > lines.low[p]) & (y < lines.high[p])
            r = np.abs(y - lines.intercept[p] - lines.slope[p] * x[:, None])
            with np.errstate(divide="ignore", invalid="ignore"):
                w = np.where(r <= HUBER * lines.scale[p], 1.0, HUBER * lines.scale[p] / r) * kept
                at = np.floor(OCTAVE * np.log2(r / lines.scale[p])) + OCTAVE * OCTAVES
            wx = w * x[:, None]
            total[:, 0] += w.sum(0)
            total[:, 1] += wx.sum(0)
            total[:, 2] += (w * y).sum(0)
            total[:, 3] += (wx * x[:, None]).sum(0)
            total[:, 4] += (wx * y).sum(0)
            total[:, 5] += (w * y * y).sum(0)
            at = np.clip(np.nan_to_num(at, nan=0.0, posinf=residuals - 1, neginf=0.0), 0, residuals - 1).astype(np.int64)
            place_y, place_x = axis.place(y), axis.place(x)
            for j in range(d):
                total[j, 6 : 6 + residuals] += np.bincount(at[kept[:, j], j], minlength=residuals)
                total[j, 6 + residuals : 6 + residuals + AXIS] += np.bincount(place_y[:, j], minlength=AXIS)
            total[0, -AXIS:] += np.bincount(place_x, minlength=AXIS)
        return total

    sums = summed_arrays(rows, "control", measured)
    if missing := [c for c in controls if c not in sums or sums[c][:, 0].max() < LEAST_EVENTS]:
        raise ValueError(f"too few events of {missing}")
    return np.array([sums[c] for c in controls])


def _bounds(counts: np.ndarray, trim: float, axis: _Axis) -> tuple[np.ndarray, np.ndarray]:
    """The edges between which all but a share ``trim`` at each end lie, to a bucket; a single bucket is not trimmed."""
    share = np.cumsum(counts, -1) / np.maximum(counts.sum(-1, keepdims=True), 1)
    first, last = (share > trim).argmax(-1), (share >= 1 - trim).argmax(-1)
    flat = (first == last) | (trim <= 0)
    return np.where(flat, -np.inf, axis.edge(first)), np.where(flat, np.inf, axis.edge(last + 1))


def _next(sums: np.ndarray, lines: _Lines, trim: float, axis: _Axis) -> tuple[_Lines, np.ndarray]:
    """The lines that the sums of a pass give, and the counts of kept events."""
    residuals = 2 * OCTAVE * OCTAVES
    n, sx, sy, sxx, sxy, syy = np.moveaxis(sums[..., :6], -1, 0)
    n = np.maximum(n, 1e-300)
    vx = np.maximum(sxx - sx * sx / n, 1e-300)
    slope = (sxy - sx * sy / n) / vx
    intercept = (sy - slope * sx) / n
    held = sums[..., 6 : 6 + residuals]
    count = held.sum(-1)
    share = np.cumsum(held, -1) / np.maximum(count[..., None], 1)
    place = (share >= 0.5).argmax(-1)
    before = np.take_along_axis(np.concatenate([np.zeros((*share.shape[:-1], 1)), share], -1), place[..., None], -1)[..., 0]
    inside = np.take_along_axis(share, place[..., None], -1)[..., 0] - before
    part = np.where(inside > 0, (0.5 - before) / np.maximum(inside, 1e-300), 0.5)
    with np.errstate(invalid="ignore", over="ignore"):
        median = lines.scale * 2.0 ** ((place + part) / OCTAVE - OCTAVES) / NORMAL_MEDIAN
    spread = np.sqrt(np.maximum(syy - sy * sy / n - slope * slope * vx, 0.0) / n)
    scale = np.where(np.isfinite(lines.scale), median, spread)
    scale = np.where(scale > 0, scale, np.inf)  # residuals of nothing weigh alike
    low, high = _bounds(sums[..., 6 + residuals : 6 + residuals + AXIS], trim, axis)
    low_x, high_x = _bounds(sums[:, 0, -AXIS:], trim, axis)
    return _Lines(intercept, slope, scale, low, high, low_x, high_x), count


def _controls(events: DataFrame, control: str, detectors: list[str]) -> tuple[DataFrame, float]:
    """The events of use, and the largest value's size."""
    ok = reduce(lambda a, b: a & b, [is_finite(F.col(d)) for d in detectors])
    rows = materialize(events.where(ok).select(F.col(control).cast("string").alias("control"), *[F.col(d).cast("double").alias(d) for d in detectors]), "controls")
    top = rows.agg(F.max(F.greatest(*[F.abs(d) for d in detectors])) if len(detectors) > 1 else F.max(F.abs(detectors[0]))).first()[0] or 1.0
    return rows, float(top)


def _started(rows: DataFrame, controls: list[str], detectors: list[str], view: Callable, d: int, trim: float, axis: _Axis) -> _Lines:
    """Trimming bounds by one pass, then plain lines inside them by another."""
    lines = _Lines.unknown(len(controls), d)
    first, _ = _next(_pass(rows, controls, detectors, view, lines, axis), lines, trim, axis)
    lines = _Lines(first.intercept, first.slope, np.full_like(first.scale, np.inf), first.low, first.high, first.low_x, first.high_x)
    return _next(_pass(rows, controls, detectors, view, lines, axis), lines, trim, axis)[0]


def refined_spillover(
    events: DataFrame, control: str, detectors: list[str], start: np.ndarray | None = None, rounds: int = 60, tolerance: float = 1e-4, linear_tolerance: float = 1e-2, trim: float = 0.01, damping: float = 0.5, biex: dict[str, float] | None = None
) -> Refined:
    """The matrix (rows: what a stain gives to each detector, 1 to its own) that leaves no slope between stains and other detectors.

    A control is named by its detector. Rounds begin on linear values; with ``biex`` (parameters of the scale) they go on with
    lines on that scale once the largest slope is under ``linear_tolerance``. ``damping`` is the step after a first plateau.
    """
    n = len(detectors)
    matrix = np.eye(n) if start is None else np.asarray(start, float).copy()
    rows, top = _controls(events, control, detectors)
    linear = _Axis(-np.arcsinh(1e4), np.arcsinh(1e4), top / 1e4 or 1.0)
    if biex is not None:
        raw, at = biex_table(**biex)
        spline, scaled = NaturalSpline(raw, at), _Axis(float(at.min()) - 0.5 * np.ptp(at), float(at.max()) + 0.5 * np.ptp(at), None)

    def viewed(m: np.ndarray, on_scale: bool) -> Callable:
        inverse = np.linalg.inv(m)

        def view(p: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            y = values @ inverse
            y = spline(y.ravel()).reshape(y.shape) if on_scale else y
            return y[:, p], y

        return view

    on_scale, step, told = False, 1.0, []
    lines = _started(rows, detectors, detectors, viewed(matrix, False), n, trim, linear)
    best, idle, reached, reason = np.inf, 0, False, "round_limit"
    for k in range(rounds):
        axis = scaled if on_scale else linear
        error = lines.slope.copy()
        if on_scale:  # what the line on the scale means in values, from end to end of the trimmed stain
            x1, x2 = (np.where(np.isfinite(e), e, f)[:, None] for e, f in ((lines.low_x, at.min()), (lines.high_x, at.max())))
            back = lambda v: np.interp(v, at, raw)
            error = (back(lines.intercept + lines.slope * x2) - back(lines.intercept + lines.slope * x1)) / (back(x2) - back(x1))
        np.fill_diagonal(error, 0.0)
        worst, spread = float(np.abs(error).max()), float(error.std(ddof=1)) if n > 1 else 0.0
        told.append({"round": k, "on_scale": float(on_scale), "largest": worst, "spread": spread, "step": step, "condition": float(np.linalg.cond(matrix))})
        if worst <= tolerance and (on_scale or biex is None):
            if reached:
                reason = "target_reached"
                break
            reached = True
        else:
            reached = False
        if biex is not None and not on_scale and worst <= linear_tolerance:
            on_scale, step, best, idle = True, 1.0, np.inf, 0
            lines = _started(rows, detectors, detectors, viewed(matrix, True), n, trim, scaled)
            continue
        if spread < best * (1 - 1e-6):
            best, idle = spread, 0
        else:
            idle += 1
        if idle >= PATIENCE:
            if step < 1.0:
                reason = "plateau"
                break
            step, idle = damping, 0
        matrix = matrix + step * (error @ matrix)
        if not np.isfinite(matrix).all() or (np.abs(np.diag(matrix)) < 1e-12).any():
            raise ValueError("the refinement leaves a stain without its own signal")
        matrix /= np.diag(matrix)[:, None]
        guess = _Lines(lines.intercept, lines.slope * (1 - step), lines.scale, lines.low, lines.high, lines.low_x, lines.high_x)
        lines, _ = _next(_pass(rows, detectors, detectors, viewed(matrix, on_scale), guess, axis), guess, trim, axis)
    discard(rows)
    return Refined(matrix, reason, told)


def refined_signatures(events: DataFrame, control: str, controls: list[str], detectors: list[str], start: np.ndarray, rounds: int = 60, tolerance: float = 1e-5, trim: float = 0.01) -> Refined:
    """Spectral signatures, a row of detectors for each control with a peak of 1, whose robust lines on their own unmixed output they are.

    ``start`` gives the rows of the first round, from medians of positive events, say. There are no more controls than detectors.
    """
    rows, top = _controls(events, control, detectors)
    axis = _Axis(-np.arcsinh(1e4), np.arcsinh(1e4), top / 1e4 or 1.0)
    matrix = np.asarray(start, float)
    matrix = matrix / matrix.max(axis=1, keepdims=True)

    def viewed(m: np.ndarray) -> Callable:
        inverse = np.linalg.pinv(m)
        return lambda p, values: ((values @ inverse)[:, p], values)

    lines = _started(rows, controls, detectors, viewed(matrix), len(detectors), trim, axis)
    told, reason = [], "round_limit"
    for k in range(rounds):
        moved = lines.slope / lines.slope.max(axis=1, keepdims=True)
        worst = float(np.abs(moved - matrix).max())
        told.append({"round": k, "largest": worst, "condition": float(np.linalg.cond(matrix))})
        matrix = moved
        if worst <= tolerance:
            reason = "target_reached"
            break
        guess = _Lines(lines.intercept, matrix, lines.scale, lines.low, lines.high, lines.low_x, lines.high_x)
        lines, _ = _next(_pass(rows, controls, detectors, viewed(matrix), guess, axis), guess, trim, axis)
    discard(rows)
    return Refined(matrix, reason, told)
