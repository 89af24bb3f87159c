"""Known matrices are recovered from single-stain controls with outliers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventmill.operators import refinement as R

NAMES = [f"D{k}" for k in range(6)]


def controls(spark, mix, names, n=2500, seed=0, noise=15.0):
    rng = np.random.default_rng(seed)
    rows = []
    for k, c in enumerate(names[: len(mix)]):
        stain = np.concatenate([rng.lognormal(8, 0.8, n), rng.normal(0, 30, n // 4)])
        y = stain[:, None] * mix[k] + rng.normal(0, noise, (len(stain), mix.shape[1])) + 50
        bad = rng.random(len(y)) < 0.03  # events with something else in them
        y[bad] += rng.uniform(0, 4000, (bad.sum(), mix.shape[1]))
        rows += [(c, *map(float, v)) for v in y]
    rows += [(names[0], float("nan"), *[1.0] * (mix.shape[1] - 1)), (None, *[1e5] * mix.shape[1]), ("other", *[1e5] * mix.shape[1])]
    columns = names if len(mix) == mix.shape[1] else [f"V{k}" for k in range(mix.shape[1])]
    return spark.createDataFrame(rows, "control string, " + ", ".join(f"{c} double" for c in columns)).repartition(4), columns


def spill(seed=1):
    m = np.random.default_rng(seed).uniform(0.0, 0.25, (6, 6))
    np.fill_diagonal(m, 1.0)
    return m


def test_a_square_matrix_is_recovered(spark):
    want = spill()
    df, _ = controls(spark, want, NAMES)
    got = R.refined_spillover(df, "control", NAMES, tolerance=1e-5)
    assert got.converged and np.abs(got.matrix - want).max() < 1e-3
    assert got.rounds[-1]["largest"] < got.rounds[0]["largest"] / 1000 and len(got.rounds) < 30


def test_the_biexponential_phase_keeps_it(spark):
    want = spill(2)
    df, _ = controls(spark, want, NAMES, n=1500, seed=3)
    got = R.refined_spillover(df, "control", NAMES, tolerance=2e-3, linear_tolerance=0.02, biex={"single": True, "steps": 256, "top": 262144.0})
    assert [r["on_scale"] for r in got.rounds][-1] == 1.0 and got.rounds[0]["on_scale"] == 0.0
    assert np.abs(got.matrix - want).max() < 0.02
    assert got.stop_reason in ("target_reached", "plateau", "round_limit")


def test_rectangular_signatures_are_recovered(spark):
    rng = np.random.default_rng(5)
    want = rng.uniform(0.0, 0.6, (4, 9))
    want[np.arange(4), [0, 3, 5, 8]] = 1.0
    names = ["a", "b", "c", "d"]
    df, columns = controls(spark, want, names, seed=6)
    rough = want + rng.uniform(-0.05, 0.05, want.shape)
    got = R.refined_signatures(df, "control", names, columns, rough)
    assert got.converged and np.abs(got.matrix - want).max() < 1e-3


def test_a_line_is_the_robust_one_of_the_last_matrix(spark):
    """Where the rounds rest, reweighting by hand does not move the slopes."""
    want = spill(4)[:2, :2]
    df, _ = controls(spark, want, NAMES[:2], n=1200, seed=9)
    got = R.refined_spillover(df, "control", NAMES[:2], tolerance=1e-7, trim=0.0, rounds=80)
    for p, j in ((0, 1), (1, 0)):
        raw = np.array([[r.D0, r.D1] for r in df.where(F.col("control") == NAMES[p]).where(~F.isnan("D0")).collect()])
        y = raw @ np.linalg.inv(got.matrix)
        a, b = np.polyfit(y[:, p], y[:, j], 1)[::-1]
        for _ in range(200):
            r = y[:, j] - a - b * y[:, p]
            s = np.median(np.abs(r)) / 0.6745
            w = np.minimum(1, 1.345 * s / np.maximum(np.abs(r), 1e-300))
            b, a = np.polyfit(y[:, p], y[:, j], 1, w=np.sqrt(w))
        assert abs(b) < 2e-5


def test_what_cannot_be_refined(spark):
    df, _ = controls(spark, spill()[:2, :2], NAMES[:2], n=100)
    with pytest.raises(ValueError):
        R.refined_spillover(df.where("control = 'D0'"), "control", NAMES[:2])
