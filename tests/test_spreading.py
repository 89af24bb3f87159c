"""A known widening is recovered, and queries without SQL are held to plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventmill.operators import estimation as E


def test_a_known_widening_is_recovered(spark):
    rng = np.random.default_rng(3)
    n, k, noise = 12_000, 0.6, 20.0
    x = rng.uniform(0, 40_000, n)
    y = rng.normal(0, np.sqrt(noise**2 + k * k * x))
    still = rng.normal(0, noise, n)
    df = spark.createDataFrame([(i, "c", "p", float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, still))], "id int, control string, primary string, p double, q double, r double")
    got = {r.secondary: r for r in E.spreading(df, "control", "primary", {c: F.col(c) for c in "pqr"}, ["id"], 64).collect()}
    assert set(got) == {"q", "r"}
    assert got["q"].status == "positive" and got["q"].coefficient == pytest.approx(0.994 * k, rel=0.08)
    assert got["r"].coefficient < 0.05


def test_controls_are_those_of_a_plain_median(spark):
    rng = np.random.default_rng(4)
    rows = [(c, r, float(v)) for c in ("a", None) for r, m in (("positive", 900), ("negative", 10)) for v in rng.normal(m, 50, 301)]
    df = spark.createDataFrame(rows + [("a", "positive", float("nan"))], "control string, role string, v double")
    for r in E.control_statistics(df, "control", "role", {"v": F.col("v")}, {"v": 1000.0}).collect():
        v = np.array([x for c, role, x in rows if c == r.control and role == r.role])
        assert r.n == 301 and r.median == pytest.approx(np.median(v)) and r.robust_sd == pytest.approx(1.4826 * np.median(np.abs(v - np.median(v)))) and r.saturated == (v >= 999.9).sum()
