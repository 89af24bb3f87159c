"""Column expressions: finiteness, scales, unmixing, ratios.

NaN and infinite values stay in the data. Spark orders NaN above all numbers, so every
predicate and aggregate goes through ``is_finite`` or ``finite``.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, functions as F

from eventmill.functions.scales import table_scale

NAN, INF = float("nan"), float("inf")


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def finite(c: Column) -> Column:
    """The value, or NULL where it is not finite: for aggregates."""
    return F.when(is_finite(c), c)


def or_nan(ok: Column, value: Column) -> Column:
    return F.when(ok, value).otherwise(F.lit(NAN))


def asinh(c: Column) -> Column:
    """asinh by symmetry: Spark's own loses large negative values."""
    return F.signum(c) * F.asinh(F.abs(c))


def clamp(c: Column, low: float | None, high: float | None) -> Column:
    """Infinite values go to the bounds, NaN stays."""
    if low is not None:
        c = F.when(F.isnan(c), c).otherwise(F.greatest(c, F.lit(low)))
    if high is not None:
        c = F.when(F.isnan(c), c).otherwise(F.least(c, F.lit(high)))
    return c


def scale(c: Column, kind: str, inverse: bool = False, low: float | None = None, high: float | None = None, **p: float) -> Column:
    """A channel on a display scale; ``low`` and ``high`` clamp the result, not that of an inverse.

    Values that are not finite become NaN, but a linear scale keeps infinite ones, and with
    a bound they are clamped; -Inf has no logarithm.
    """
    ln10 = math.log(10.0)
    match kind, inverse:
        case "linear", _:
            out = c
        case "log", False:
            out = F.when(c > 0, F.log10(c)).otherwise(F.lit(NAN))
        case "log", True:
            out = F.pow(F.lit(10.0), c)
        case "asinh", False:
            out = asinh(c / p.get("cofactor", 150.0))
        case "asinh", True:
            out = F.sinh(c) * p.get("cofactor", 150.0)
        case "gml_linear", False:
            out = (c + p["a"]) / (p["t"] + p["a"])
        case "gml_linear", True:
            out = c * (p["t"] + p["a"]) - p["a"]
        case "gml_log", False:
            out = F.when(c > 0, F.log10(c / p["t"]) / p["m"] + 1.0).otherwise(F.lit(NAN))
        case "gml_log", True:
            out = p["t"] * F.pow(F.lit(10.0), (c - 1.0) * p["m"])
        case "gml_asinh", False:
            out = (asinh(c * (math.sinh(p["m"] * ln10) / p["t"])) + p["a"] * ln10) / ((p["m"] + p["a"]) * ln10)
        case "gml_asinh", True:
            out = F.sinh(c * ((p["m"] + p["a"]) * ln10) - p["a"] * ln10) * (p["t"] / math.sinh(p["m"] * ln10))
        case "wsp_log", False:
            out = (F.log10(F.greatest(c, F.lit(p["offset"]))) - math.log10(p["offset"])) / p["m"]
        case "wsp_log", True:
            out = F.pow(F.lit(10.0), c * p["m"] + math.log10(p["offset"]))
        case "wsp_biex" | "refinement_biex" | "logicle" | "hyperlog", _:
            out = table_scale(kind, c, inverse, **p)
        case _:
            raise ValueError(f"no scale {kind!r}")
    out = or_nan(c.isNotNull() if kind == "linear" else is_finite(c), out)
    if inverse or low is None and high is None:
        return out
    out = F.when(c == INF, c).otherwise(out)
    if kind not in ("log", "gml_log"):
        out = F.when(c == -INF, c).otherwise(out)
    return clamp(out, low, high)


def linear_unmix(columns: list[Column], operator: np.ndarray) -> list[Column]:
    """``values @ operator`` with literal coefficients; a row with a value that is not finite becomes NaN."""
    ok = reduce(lambda a, b: a & b, map(is_finite, columns))
    return [or_nan(ok, reduce(lambda a, b: a + b, [c * float(operator[i, j]) for i, c in enumerate(columns)])) for j in range(operator.shape[1])]


def compensate(columns: list[Column], spill: np.ndarray) -> list[Column]:
    """Undo a spillover matrix: measured = true @ spill."""
    spill = np.asarray(spill, float)
    if spill.shape[0] != spill.shape[1] or np.linalg.cond(spill) > 1e8:
        raise ValueError("the spillover matrix is not square or cannot be inverted")
    return linear_unmix(columns, np.linalg.inv(spill))


def spectral_unmix(columns: list[Column], signatures: np.ndarray, weights: np.ndarray | None = None, background: np.ndarray | None = None) -> list[Column]:
    """Weighted least squares onto signatures (outputs x detectors), the background taken off first."""
    a = np.asarray(signatures, float)
    w = np.ones(a.shape[1]) if weights is None else np.asarray(weights, float)
    if a.ndim != 2 or len(a) > a.shape[1] or len(w) != a.shape[1] or not (np.isfinite(a).all() and (w > 0).all()):
        raise ValueError("signatures are outputs x detectors, with as many detectors or more, and positive weights")
    if np.linalg.matrix_rank(a) < len(a) or np.linalg.cond(a) > 1e8:
        raise ValueError("the signatures cannot be told apart")
    root = np.sqrt(w)
    operator = root[:, None] * np.linalg.pinv(a * root)
    back = np.zeros(a.shape[1]) if background is None else background
    return linear_unmix([c - float(b) for c, b in zip(columns, back)], operator)


def ratio(x: Column, y: Column, a: float = 1.0, b: float = 0.0, c: float = 0.0, low: float | None = None, high: float | None = None) -> Column:
    """a (x - b) / (y - c), clamped to ``low`` and ``high``; infinite or NaN before that where the denominator is 0."""
    over, under = a * (x - b), y - c
    infinite = F.when(under.cast("double").cast("string") == "-0.0", F.lit(-INF)).otherwise(F.lit(INF))  # no comparison tells -0.0
    out = F.when(under == 0, over * infinite).otherwise(over / F.nullif(under, F.lit(0.0)))
    return clamp(or_nan(x.isNotNull() & y.isNotNull(), out), low, high)


def tempered_root(c: Column) -> Column:
    return c / (F.sqrt(F.abs(c) + 1.0) + 1.0)


def share_of_axis(c: Column, low: float, high: float) -> Column:
    s = max(abs(low), abs(high), 1.0)
    return (c / s - low / s) / (high / s - low / s)
