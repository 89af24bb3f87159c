"""Cell-cycle and dye-generation models with constraints, a synchronous wave and a measured background.

Spark counts events into histograms of at most ``MOST_BINS`` bins and reads calibrations off the
controls; the fits of samples run side by side, each on its one histogram. Peak parameters move
inside their bounds by least squares of deviances; for each place of the peaks the numbers of
events of the parts are the best that are not negative. Standard errors of shares come from the
information of all free parameters; they are missing where these are not told apart or lie at a bound.

Defined results: events outside the view or not finite are counted in the parameter ``outside``;
an event in a bin that no part reaches belongs to all parts alike;
a sample without events in view has no rows; a NULL sample is a sample.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from eventmill.functions.columns import is_finite
from eventmill.functions.fitting import bounded_least_squares, deviance_residuals, normal_cdf, shares
from eventmill.operators.grids import cell
from eventmill.plans.order_statistics import percentiles

MOST_BINS = 1024
PHASES = ("G1", "S", "G2")
#: Fixed value: MAD to standard deviation.
ROBUST = 1.482602218505602
#: Levels at which S is laid out, and nodes of an integral over a narrow normal variable.
LEVELS, NODES = 96, 48


@dataclass(frozen=True)
class Peak:
    """What is known of a parameter: where to begin, its bounds, or its value."""

    initial: float | None = None
    low: float | None = None
    high: float | None = None
    fixed: float | None = None

    def limits(self, initial: float, low: float, high: float) -> tuple[float, float, float]:
        if self.fixed is not None:
            return self.fixed, self.fixed, self.fixed
        low, high = (low if self.low is None else self.low), (high if self.high is None else self.high)
        if not low <= high:
            raise ValueError("the bounds of a parameter exclude each other")
        return min(max(initial if self.initial is None else self.initial, low), high), low, high


@dataclass(frozen=True)
class CycleModel:
    """Constraints of a cell-cycle fit. ``ratio`` is G2 over G1; ``linked_cv`` gives both peaks one width; ``wave`` adds synchronous cells in S."""

    g1: Peak = field(default_factory=Peak)
    ratio: Peak = field(default_factory=Peak)
    cv1: Peak = field(default_factory=Peak)
    cv2: Peak = field(default_factory=Peak)
    linked_cv: bool = True
    wave: bool = False
    wave_at: Peak = field(default_factory=Peak)
    wave_width: Peak = field(default_factory=Peak)


def _bins_of(edges: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """The share of each normal (rows) in each bin, 1 in all bins together."""
    p = np.diff(normal_cdf((edges - mean[:, None]) / sd[:, None]), axis=1)
    return p / np.maximum(p.sum(1, keepdims=True), 1e-300)


def cycle_parts(edges: np.ndarray, p: dict[str, float], wave: bool) -> np.ndarray:
    """G1, three pieces of a quadratic S that is nowhere negative, the wave if there is one, and G2."""
    t = (np.arange(LEVELS) + 0.5) / LEVELS
    at = p["g1"] * (1 + (p["ratio"] - 1) * t)
    broad = _bins_of(edges, at, at * (p["cv1"] + (p["cv2"] - p["cv1"]) * t))
    heights = [(1 - t) ** 2, 2 * t * (1 - t), t**2]
    if wave:
        heights.append(np.exp(-0.5 * ((t - p["wave_at"]) / p["wave_width"]) ** 2) + 1e-12)
    s = [h @ broad / h.sum() for h in heights]
    ends = _bins_of(edges, np.array([p["g1"], p["g1"] * p["ratio"]]), np.array([p["g1"] * p["cv1"], p["g1"] * p["ratio"] * p["cv2"]]))
    return np.array([ends[0], *s, ends[1]])


def _fit(counts: np.ndarray, limits: dict[str, tuple[float, float, float]], parts_of: Callable[[dict[str, float]], np.ndarray], starts: list[dict[str, float]]) -> tuple[dict[str, float], np.ndarray, np.ndarray, dict]:
    """Parameters, parts, events of each part, and how the fit went: the best of several starts."""
    free = [k for k, (_, low, high) in limits.items() if high > low]
    low, high = (np.array([limits[k][j] for k in free]) for j in (1, 2))

    def told(x: np.ndarray) -> dict[str, float]:
        return {k: v[0] for k, v in limits.items()} | dict(zip(free, map(float, x), strict=True))

    def residual(x: np.ndarray) -> np.ndarray:
        parts = parts_of(told(x))
        return deviance_residuals(shares(parts, counts) @ parts, counts)

    best = None
    for start in starts:
        x = np.array([np.clip(start.get(k, limits[k][0]), *limits[k][1:]) for k in free])
        x, settled = bounded_least_squares(residual, x, low, high) if free else (x, True)
        cost = float((residual(x) ** 2).sum())
        if best is None or cost < best[0]:
            best = cost, x, settled
    cost, x, settled = best
    parts = parts_of(told(x))
    w = shares(parts, counts)
    edge = [k for k, v, a, b in zip(free, x, low, high, strict=True) if min(v - a, b - v) < 1e-4 * (b - a)]
    return told(x), parts, w, {"deviance": cost, "settled": settled, "at_bounds": edge, "x": x, "free": free, "told": told, "span": high - low}


def _share_errors(counts: np.ndarray, w: np.ndarray, parts: np.ndarray, groups: list[list[int]], fit: dict, parts_of: Callable) -> list[float]:
    """Standard errors of the groups' shares from the Poisson information of peaks and events together; NaN where it is singular."""
    held = np.flatnonzero(w > 0)
    columns = [parts[k] for k in held]
    for j, k in enumerate(fit["free"]):
        h = 1e-5 * fit["span"][j] * (1 if k not in fit["at_bounds"] else -1)
        moved = fit["x"].copy()
        moved[j] += h
        columns.append((w @ parts_of(fit["told"](moved)) - w @ parts) / h)
    jacobian = np.array(columns).T / np.sqrt(np.maximum(w @ parts, 1e-3))[:, None]
    scale = np.sqrt((jacobian**2).sum(0))
    if fit["at_bounds"] or not (scale > 0).all() or np.linalg.matrix_rank(jacobian / scale, 1e-7) < jacobian.shape[1]:
        return [math.nan] * len(groups)
    inverse = np.linalg.inv((jacobian / scale).T @ (jacobian / scale)) / np.outer(scale, scale)
    total = w.sum()
    out = []
    for g in groups:
        gradient = np.zeros(jacobian.shape[1])
        own = w[g].sum() / total
        gradient[: len(held)] = [((k in g) - own) / total for k in held]
        out.append(float(np.sqrt(max(gradient @ inverse @ gradient, 0.0))))
    return out


def _posteriors(mixed: np.ndarray) -> np.ndarray:
    """Each part's share of a bin; where no part reaches, equal shares, so that no event is lost."""
    total = mixed.sum(0)
    return np.where(total > 0, mixed / np.where(total > 0, total, 1.0), 1 / len(mixed))


def fit_cycle(edges: np.ndarray, counts: np.ndarray, model: CycleModel = CycleModel()) -> tuple[dict[str, float], np.ndarray]:
    """Parameters with shares and their errors, and the phases' posteriors by bin, of one DNA histogram."""
    middle = (edges[1:] + edges[:-1]) / 2
    soft = np.convolve(counts, np.ones(5) / 5, mode="same")
    first = float(middle[soft.argmax()])
    # the highest peak is G1, unless there is a peak at half of it
    half = np.abs(middle - first / 2).argmin()
    if soft[half] > 0.2 * soft.max() and soft[half] >= soft[max(0, half - 3) : half + 4].max() * 0.9:
        first = float(middle[half])
    first = model.g1.fixed or model.g1.initial or first
    limits = {"g1": model.g1.limits(first, first * 0.85, first * 1.15), "ratio": model.ratio.limits(2.0, 1.75, 2.15), "cv1": model.cv1.limits(0.06, 0.005, 0.3)}
    if not model.linked_cv:
        limits["cv2"] = model.cv2.limits(limits["cv1"][0], 0.005, 0.3)
    starts: list[dict[str, float]] = [{}, {"cv1": 0.03}, {"cv1": 0.12}]
    if model.wave:
        limits |= {"wave_at": model.wave_at.limits(0.5, 0.03, 0.97), "wave_width": model.wave_width.limits(0.1, 0.02, 0.4)}
        starts = [s | {"wave_at": at} for s in starts[:2] for at in (0.25, 0.5, 0.75)]

    def parts_of(p: dict[str, float]) -> np.ndarray:
        return cycle_parts(edges, p if "cv2" in p else p | {"cv2": p["cv1"]}, model.wave)

    p, parts, w, fit = _fit(counts, limits, parts_of, starts)
    n = len(parts)
    groups = [[0], list(range(1, n - 1)), [n - 1]]
    mixed = np.array([(w[g, None] * parts[g]).sum(0) for g in groups])
    errors = _share_errors(counts, w, parts, groups, fit, parts_of)
    total = max(w.sum(), 1e-300)
    told = {**p, "cv2": p.get("cv2", p["cv1"]), "deviance": fit["deviance"], "settled": float(fit["settled"])}
    told |= {name: float(w[g].sum() / total) for name, g in zip(PHASES, groups, strict=True)}
    told |= {f"se_{name}": e for name, e in zip(PHASES, errors, strict=True)}
    if model.wave:
        told["wave"] = float(w[4] / total)
    return told, _posteriors(mixed)


# --- dye generations


_Z, _ZW = np.polynomial.hermite_e.hermegauss(NODES)
_ZW = _ZW / _ZW.sum()


@dataclass(frozen=True)
class Background:
    """Normal intensity that every event has besides its dye."""

    mean: float = 0.0
    sd: float = 0.0


@dataclass(frozen=True)
class DyeModel:
    """Constraints of a generation fit; ``ratio`` is what a division leaves of the dye."""

    undivided: Peak = field(default_factory=Peak)
    ratio: Peak = field(default_factory=lambda: Peak(low=0.45, high=0.55))
    cv: Peak = field(default_factory=Peak)
    generations: int = 6


def dye_masses(edges: np.ndarray, median: float, cv: float, background: Background) -> np.ndarray:
    """What of a log-normal dye with normal background falls into each bin of intensities.

    The narrower of the two is integrated over nodes, the other one in closed form.
    """
    sigma = math.sqrt(math.log1p(cv * cv))
    if background.sd > median * cv:
        dye = median * np.exp(sigma * _Z)
        return _ZW @ np.diff(normal_cdf((edges - background.mean - dye[:, None]) / background.sd), axis=1)
    free = edges - background.mean - background.sd * _Z[:, None] if background.sd > 0 else (edges - background.mean)[None]
    below = np.where(free > 0, normal_cdf(np.log(np.maximum(free, 1e-300) / median) / sigma), 0.0)
    return (_ZW if background.sd > 0 else np.ones(1)) @ np.diff(below, axis=1)


def generation_parts(edges: np.ndarray, p: dict[str, float], background: Background, generations: int) -> np.ndarray:
    dye = p["undivided"] - background.mean
    rows = np.array([dye_masses(edges, dye * p["ratio"] ** k, p["cv"], background) for k in range(generations + 1)])
    return rows / np.maximum(rows.sum(1, keepdims=True), 1e-300)


def fit_dye(edges: np.ndarray, counts: np.ndarray, model: DyeModel, background: Background = Background()) -> tuple[dict[str, float], np.ndarray]:
    """Parameters with the share of each generation and its error, and posteriors by bin."""
    start = model.undivided.fixed or model.undivided.initial
    if start is None or not start > background.mean:
        raise ValueError("the undivided intensity is known and above the background")
    dye = start - background.mean
    limits = {"undivided": model.undivided.limits(start, background.mean + 0.75 * dye, background.mean + 1.33 * dye), "ratio": model.ratio.limits(0.5, 0.45, 0.55), "cv": model.cv.limits(0.25, 0.03, 0.8)}

    def parts_of(p: dict[str, float]) -> np.ndarray:
        return generation_parts(edges, p, background, model.generations)

    p, parts, w, fit = _fit(counts, limits, parts_of, [{}, {"cv": 0.12}])
    errors = _share_errors(counts, w, parts, [[k] for k in range(len(parts))], fit, parts_of)
    total = max(w.sum(), 1e-300)
    told = {**p, "background": background.mean, "background_sd": background.sd, "deviance": fit["deviance"], "settled": float(fit["settled"])}
    told |= {f"g{k}": float(v / total) for k, v in enumerate(w)} | {f"se_g{k}": e for k, e in enumerate(errors)}
    return told, _posteriors(w[:, None] * parts)


# --- on tables


def _counted(events: DataFrame, sample: str, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """``sample, bin, n``; bin -1 has what is outside the view or not finite."""
    if bins > MOST_BINS:
        raise ValueError(f"a histogram has {MOST_BINS} bins at most")
    rows = events.select(F.col(sample).alias("sample"), F.coalesce(cell(value, low, high, bins), F.lit(-1)).alias("bin"))
    return rows.groupBy("sample", "bin").agg(F.count("*").alias("n"))


def _fits(held: DataFrame, bins: int, fit: Callable[[np.ndarray], tuple[dict[str, float], np.ndarray]]) -> DataFrame:
    kind = held.schema["sample"].dataType.simpleString()
    schema = f"sample {kind}, bin int, part int, posterior double, n long, parameters map<string,double>"

    def of(rows: pd.DataFrame) -> pd.DataFrame:  # the bins of one sample
        inside = rows[rows["bin"] >= 0]
        if inside.empty:
            return pd.DataFrame(columns=["sample", "bin", "part", "posterior", "n", "parameters"])
        counts = np.zeros(bins)
        counts[inside["bin"]] = inside["n"]
        told, posterior = fit(counts)
        told["outside"] = float(rows.loc[rows["bin"] < 0, "n"].sum())
        at, part = np.divmod(np.arange(bins * len(posterior)), len(posterior))
        return pd.DataFrame({"sample": rows["sample"].iloc[0], "bin": at.astype(np.int32), "part": part.astype(np.int32), "posterior": posterior[part, at], "n": counts[at].astype(np.int64), "parameters": [{k: float(v) for k, v in told.items()}] * len(at)})

    return held.groupBy("sample").applyInPandas(of, schema)


def cell_cycle(events: DataFrame, sample: str, dna: Column, low: float, high: float, bins: int = 256, model: CycleModel = CycleModel()) -> DataFrame:
    """``sample, bin, part, posterior, n, parameters``: the chance of G1, S and G2 (parts 0, 1, 2) in each bin."""
    edges = np.linspace(low, high, bins + 1)
    return _fits(_counted(events, sample, dna, low, high, bins), bins, lambda c: fit_cycle(edges, c, model))


def measured_background(events: DataFrame, unstained: Column, dye: Column) -> Background:
    """Median, 0 at least, and robust deviation of the unstained events."""
    rows = events.where(unstained & is_finite(dye)).select(dye.cast("double").alias("v"))
    m = percentiles(rows, [], F.col("v"), [0.5]).first()
    if m is None or not m["n"]:
        raise ValueError("there are no unstained events")
    off = percentiles(rows.select(F.abs(F.col("v") - m["q"][0]).alias("v")), [], F.col("v"), [0.5]).first()
    return Background(max(0.0, m["q"][0]), ROBUST * off["q"][0])


def measured_dye(events: DataFrame, undivided: Column, dye: Column, background: Background, bins: int = 256) -> tuple[float, float]:
    """Intensity and cv of undivided events, by a fit of one generation to their histogram."""
    rows = events.where(undivided & is_finite(dye)).select(dye.cast("double").alias("v"))
    q = percentiles(rows, [], F.col("v"), [0.0005, 0.1587, 0.5, 0.8413, 0.9995]).first()
    if q is None or not q["n"] or not q["q"][2] > background.mean:
        raise ValueError("undivided events lie above the background")
    low, below, middle, above, high = q["q"]
    counts = np.zeros(bins)
    for r in _counted(rows.withColumn("sample", F.lit(0)), "sample", F.col("v"), low, high, bins).where("bin >= 0").collect():  # a row a bin
        counts[r["bin"]] = r["n"]
    edges, dye_of = np.linspace(low, high, bins + 1), middle - background.mean
    spread = math.sqrt(max(((above - below) / 2) ** 2 - background.sd**2, 1e-6 * dye_of**2)) / dye_of
    limits = {"undivided": (middle, background.mean + 0.25 * dye_of, background.mean + 4 * dye_of), "cv": (min(max(spread, 0.006), 0.9), 0.005, 1.0)}
    p, *_ = _fit(counts, limits, lambda p: generation_parts(edges, p | {"ratio": 0.5}, background, 0), [{}])
    return p["undivided"], p["cv"]


def dye_generations(events: DataFrame, sample: str, dye: Column, low: float, high: float, cofactor: float, model: DyeModel = DyeModel(), undivided: Column | None = None, unstained: Column | None = None, bins: int = 256) -> DataFrame:
    """``sample, bin, part, posterior, n, parameters`` of generations 0, 1, ...; bins are even on asinh(dye / ``cofactor``).

    ``unstained`` events measure the background, ``undivided`` ones where generation 0 lies and how wide it is; both begin the fit,
    and what ``model`` fixes stays.
    """
    background = Background() if unstained is None else measured_background(events, unstained, dye)
    if undivided is not None:
        at, cv = measured_dye(events, undivided, dye, background)
        first, wide = model.undivided, model.cv
        model = DyeModel(Peak(at if first.initial is None else first.initial, first.low, first.high, first.fixed), model.ratio, Peak(cv if wide.initial is None else wide.initial, wide.low, wide.high, wide.fixed), model.generations)
    a, b = math.asinh(low / cofactor), math.asinh(high / cofactor)
    edges = cofactor * np.sinh(np.linspace(a, b, bins + 1))
    scaled = F.asinh(dye / cofactor)
    return _fits(_counted(events, sample, scaled, a, b, bins), bins, lambda c: fit_dye(edges, c, model, background))
