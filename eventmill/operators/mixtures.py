"""Histograms taken apart into peaks: cell-cycle phases and dye generations.

Events of a sample become a histogram of at most ``MOST_BINS`` bins in one aggregation; the fit of a histogram is
small, and fits of samples run side by side. Posteriors are a row for each bin and part, which events meet by their bin.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from eventmill.operators.grids import cell
from eventmill.plans.order_statistics import percentiles

MOST_BINS = 1024
PHASES = ("G1", "S", "G2")


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.array([math.erfc(-v / math.sqrt(2)) for v in np.ravel(x)]).reshape(np.shape(x))


def peak_shares(edges: np.ndarray, mean: float, sd: float) -> np.ndarray:
    """What of a Gaussian falls into each bin, scaled to 1 inside the edges."""
    p = np.diff(_normal_cdf((edges - mean) / max(sd, 1e-12)))
    return p / max(p.sum(), 1e-300)


def _weights(parts: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Shares of parts that make the counts likeliest, by expectation and maximisation."""
    w = np.full(len(parts), 1.0 / len(parts))
    for _ in range(rounds):
        mixed = np.maximum(w @ parts, 1e-300)
        new = w * (parts @ (counts / mixed)) / max(counts.sum(), 1e-300)
        if np.abs(new - w).max() < 1e-9:
            return new
        w = new
    return w


def _likelihood(parts: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray]:
    w = _weights(parts, counts, 60)
    return float(counts @ np.log(np.maximum(w @ parts, 1e-300))), w


def _climb(value, start: list[float], steps: list[float], rounds: int = 60) -> list[float]:
    """Coordinate search with steps that shrink: a few parameters of one histogram."""
    at, best = list(start), value(start)
    for _ in range(rounds):
        moved = False
        for k in range(len(at)):
            for d in (steps[k], -steps[k]):
                tried = at[:k] + [at[k] + d] + at[k + 1 :]
                v = value(tried)
                if v > best + 1e-9:
                    at, best, moved = tried, v, True
                    break
        if not moved:
            steps = [s / 2 for s in steps]
            if max(s / max(abs(a), 1e-12) for s, a in zip(steps, at)) < 1e-4:
                break
    return at


def phase_parts(edges: np.ndarray, g1: float, ratio: float, cv: float, degree: int = 2) -> np.ndarray:
    """G1, pieces of S and G2 as shares of bins: S is a polynomial between the peaks, broadened like them."""
    g2 = g1 * ratio
    levels = np.linspace(g1, g2, 24)[1:-1]
    broad = np.array([peak_shares(edges, m, cv * m) for m in levels])
    t = (levels - g1) / (g2 - g1)
    s = [np.clip(np.array([math.comb(degree, k) * (1 - x) ** (degree - k) * x**k for x in t]), 0, None) @ broad for k in range(degree + 1)]
    return np.array([peak_shares(edges, g1, cv * g1), *[v / max(v.sum(), 1e-300) for v in s], peak_shares(edges, g2, cv * g2)])


def fit_phases(edges: np.ndarray, counts: np.ndarray, ratio: tuple[float, float] = (1.75, 2.15)) -> tuple[dict, np.ndarray]:
    """Parameters, and phases by bins as posteriors, of one DNA histogram."""
    middle = (edges[1:] + edges[:-1]) / 2
    soft = np.convolve(counts, np.ones(5) / 5, mode="same")
    first = float(middle[soft.argmax()])
    # the highest peak is G1, unless there is a peak at half of it
    if (half := soft[np.abs(middle - first / 2).argmin()]) > 0.4 * soft.max():
        first = float(middle[np.abs(middle - first / 2).argmin()])

    def value(p: list[float]) -> float:
        if p[0] <= 0 or not ratio[0] <= p[1] <= ratio[1] or not 0.005 <= p[2] <= 0.3:
            return -math.inf
        return _likelihood(phase_parts(edges, *p), counts)[0]

    best = _climb(value, [first, 2.0 if ratio[0] <= 2 <= ratio[1] else sum(ratio) / 2, 0.06], [first * 0.04, 0.04, 0.02])
    parts = phase_parts(edges, *best)
    w = _weights(parts, counts)
    mixed = w[:, None] * parts
    own = np.array([mixed[0], mixed[1:-1].sum(0), mixed[-1]])
    posterior = own / np.maximum(own.sum(0), 1e-300)
    shares = own.sum(1)
    return {"g1": best[0], "ratio": best[1], "cv": best[2], **{n: float(x) for n, x in zip(PHASES, shares / shares.sum())}}, posterior


def generation_parts(edges: np.ndarray, undivided: float, sd: float, generations: int) -> np.ndarray:
    """Peaks of log2 intensity, each generation one less than the last."""
    return np.array([peak_shares(edges, undivided - k, sd) for k in range(generations + 1)])


def fit_generations(edges: np.ndarray, counts: np.ndarray, undivided: float, sd: float, generations: int) -> tuple[dict, np.ndarray]:
    """Parameters, and generations by bins as posteriors, of a histogram of log2 intensities, from a control's peak."""

    def value(p: list[float]) -> float:
        return -math.inf if not 0.02 <= p[1] <= 1.0 or abs(p[0] - undivided) > 0.5 else _likelihood(generation_parts(edges, p[0], p[1], generations), counts)[0]

    best = _climb(value, [undivided, sd], [0.05, 0.05])
    parts = generation_parts(edges, best[0], best[1], generations)
    w = _weights(parts, counts)
    mixed = w[:, None] * parts
    return {"undivided": best[0], "sd": best[1]}, mixed / np.maximum(mixed.sum(0), 1e-300)


def histograms(events: DataFrame, sample: str, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """``sample, bin, n`` of the finite values inside the view."""
    if bins > MOST_BINS:
        raise ValueError("a histogram has 1024 bins at most")
    rows = events.select(F.col(sample).alias("sample"), cell(value, low, high, bins).alias("bin"))
    return rows.where("bin IS NOT NULL").groupBy("sample", "bin").agg(F.count("*").alias("n"))


def _fitted(held: DataFrame, low: float, high: float, bins: int, names: list[str], fit) -> DataFrame:
    edges = np.linspace(low, high, bins + 1)
    kind = held.schema["sample"].dataType.simpleString()

    def of(rows: pd.DataFrame) -> pd.DataFrame:  # the bins of one sample
        counts = np.zeros(bins)
        counts[rows["bin"]] = rows["n"]
        told, posterior = fit(edges, counts)
        at, part = np.divmod(np.arange(bins * len(posterior)), len(posterior))
        return pd.DataFrame({"sample": rows["sample"].iloc[0], "bin": at.astype(np.int32), "part": part.astype(np.int32), "posterior": posterior[part, at], "n": counts[at].astype(np.int64), "parameters": [{k: float(v) for k, v in told.items()}] * len(at)})

    return held.groupBy("sample").applyInPandas(of, f"sample {kind}, bin int, part int, posterior double, n long, parameters map<string,double>")


def cell_cycle(events: DataFrame, sample: str, dna: Column, low: float, high: float, bins: int = 256) -> DataFrame:
    """``sample, bin, part, posterior, n, parameters``: the chance of G1, S and G2 (parts 0, 1, 2) in each bin of a sample's DNA histogram."""
    return _fitted(histograms(events, sample, dna, low, high, bins), low, high, bins, list(PHASES), fit_phases)


def proliferation(events: DataFrame, sample: str, dye: Column, control: Column, generations: int = 6, bins: int = 256, low: float = 0.0, high: float = 20.0) -> DataFrame:
    """The same of generations 0, 1, ... of a dye that halves with each division; ``control`` marks undivided events, whose
    log2 median and robust deviation begin the fit."""
    log2 = F.when(dye > 0, F.log2(dye))
    told = percentiles(events.where(control), [], log2, [0.5, 0.1587, 0.8413]).first()
    if told is None or not told["n"]:
        raise ValueError("the control has no events")
    m = told["q"]
    start, sd = m[0], max(0.05, (m[2] - m[1]) / 2)
    return _fitted(histograms(events, sample, log2, low, high, bins), low, high, bins, [], lambda e, c: fit_generations(e, c, start, sd, generations))


def part_counts(posteriors: DataFrame) -> DataFrame:
    """``sample, part, expected, assigned``: posterior sums, and events of the bins where a part is likeliest, the first of equals."""
    best = posteriors.groupBy("sample", "bin").agg(F.min(F.struct(-F.col("posterior"), "part")).alias("b"))
    told = posteriors.join(best, ["sample", "bin"])
    return told.groupBy("sample", "part").agg(F.sum(F.col("posterior") * F.col("n")).alias("expected"), F.sum(F.when(F.col("b.part") == F.col("part"), F.col("n")).otherwise(0)).alias("assigned"))


def event_posteriors(events: DataFrame, sample: str, ids: list[str], value: Column, posteriors: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """``sample, ids, part, posterior`` of every event inside the view, by its bin."""
    rows = events.select(F.col(sample).alias("sample"), *ids, cell(value, low, high, bins).alias("bin")).where("bin IS NOT NULL")
    return rows.join(posteriors.select("sample", "bin", "part", "posterior"), ["sample", "bin"]).drop("bin")


def generation_indices(counts: DataFrame, keys: list[str], generation: str, n: str) -> DataFrame:
    """Division figures of ``keys, generation, n``: precursors are counts over 2^generation.

    ``precursors, precursor_frequency, percent_divided, observed_divided_fraction, division_index, proliferation_index, expansion_index, replication_index``.
    """
    g = F.col(generation)
    p = F.col(n) / F.pow(F.lit(2.0), g)
    divided = g > 0
    s = counts.groupBy(*keys).agg(
        F.sum(p).alias("precursors"), F.sum(F.when(divided, p).otherwise(0.0)).alias("started"), F.sum(n).alias("cells"),
        F.sum(F.when(divided, F.col(n)).otherwise(0)).alias("offspring"), F.sum(F.when(divided, g * p).otherwise(0.0)).alias("divisions"),
    )
    over = lambda a, b: F.col(a) / F.nullif(F.col(b).cast("double"), F.lit(0.0))
    return s.select(
        *keys, "precursors", over("started", "precursors").alias("precursor_frequency"), (100.0 * over("started", "precursors")).alias("percent_divided"), over("offspring", "cells").alias("observed_divided_fraction"), over("divisions", "precursors").alias("division_index"),
        over("divisions", "started").alias("proliferation_index"), over("cells", "precursors").alias("expansion_index"), over("offspring", "started").alias("replication_index"),
    )
