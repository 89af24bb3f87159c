"""Peak models: known shares are recovered, constraints hold, and errors are of the right size."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventmill.functions import fitting
from eventmill.operators import peak_models as P


def cells(rng, n, shares, wave=0.0, cv=0.05, ratio=2.0, g1=100.0):
    k = rng.choice(3, n, p=shares)
    t = np.where(rng.random(n) < wave, np.clip(rng.normal(0.4, 0.07, n), 0, 1), rng.random(n))
    dna = g1 * np.where(k == 0, 1.0, np.where(k == 2, ratio, 1 + (ratio - 1) * t))
    return dna * (1 + cv * rng.normal(size=n)), k


EDGES = np.linspace(0, 300, 257)


@pytest.mark.parametrize("wave", [0.0, 0.6])
def test_known_phases_are_recovered(wave):
    rng = np.random.default_rng(3)
    dna, k = cells(rng, 40_000, (0.45, 0.35, 0.2), wave)
    counts = np.histogram(dna, EDGES)[0].astype(float)
    told, posterior = P.fit_cycle(EDGES, counts, P.CycleModel(wave=wave > 0))
    true = [(k == j).mean() for j in range(3)]
    assert [told[p] for p in P.PHASES] == pytest.approx(true, abs=0.02)
    assert told["g1"] == pytest.approx(100, abs=1) and told["ratio"] == pytest.approx(2, abs=0.03) and told["cv1"] == pytest.approx(0.05, abs=0.005)
    assert posterior.shape == (3, 256) and np.allclose(posterior.sum(0)[counts > 0], 1)
    assert all(0.0005 < told[f"se_{p}"] < 0.02 for p in P.PHASES if not math.isnan(told[f"se_{p}"]))
    if wave:
        assert told["wave_at"] == pytest.approx(0.4, abs=0.05) and told["wave"] == pytest.approx(0.35 * 0.6, abs=0.05)
        plain, _ = P.fit_cycle(EDGES, counts, P.CycleModel())
        assert plain["deviance"] > told["deviance"] + 100  # without the wave it does not fit


def test_constraints_hold():
    rng = np.random.default_rng(4)
    counts = np.histogram(cells(rng, 20_000, (0.5, 0.3, 0.2), ratio=1.9)[0], EDGES)[0].astype(float)
    told, _ = P.fit_cycle(EDGES, counts, P.CycleModel(ratio=P.Peak(fixed=1.95), cv1=P.Peak(low=0.06, high=0.1)))
    assert told["ratio"] == 1.95 and 0.06 <= told["cv1"] <= 0.1 and told["cv1"] == told["cv2"] and math.isnan(told["se_S"])
    free, _ = P.fit_cycle(EDGES, counts, P.CycleModel(linked_cv=False))
    assert free["ratio"] == pytest.approx(1.9, abs=0.03) and free["cv2"] != free["cv1"]
    low, _ = P.fit_cycle(EDGES, counts, P.CycleModel(g1=P.Peak(initial=104, low=102, high=110)))
    assert 102 <= low["g1"] <= 110
    with pytest.raises(ValueError):
        P.fit_cycle(EDGES, counts, P.CycleModel(g1=P.Peak(low=5, high=4)))


def test_errors_are_those_of_repeated_samples():
    rng = np.random.default_rng(5)
    got = [P.fit_cycle(EDGES, np.histogram(cells(rng, 4000, (0.5, 0.3, 0.2))[0], EDGES)[0].astype(float)) for _ in range(12)]
    spread = np.std([t["G1"] for t, _ in got], ddof=1)
    told = np.nanmedian([t["se_G1"] for t, _ in got])
    assert told / 2.5 < spread < told * 2.5


def dyed(rng, n, shares, background, sd, first=1000.0, cv=0.15):
    k = rng.choice(len(shares), n, p=shares)
    sigma = math.sqrt(math.log1p(cv * cv))
    return first * 0.5**k * np.exp(sigma * rng.normal(size=n)) + rng.normal(background, sd, n), k


def test_generations_under_a_background(spark):
    rng = np.random.default_rng(6)
    shares = (0.15, 0.2, 0.25, 0.25, 0.15)
    rows = []
    truth = {}
    for s in ("a", None):
        x, k = dyed(rng, 20_000, shares, 200.0, 20.0)
        truth[s] = [(k == j).mean() for j in range(5)]
        rows += [(s, "cells", float(v)) for v in x]
    rows += [("c", "undivided", float(v)) for v in dyed(rng, 4000, (1.0,), 200.0, 20.0)[0]]
    rows += [("u", "unstained", float(v)) for v in rng.normal(200, 20, 4000)]
    rows += [("a", "cells", float("nan")), ("a", "cells", 1e9)]
    df = spark.createDataFrame(rows, "sample string, kind string, dye double")
    is_kind = lambda k: F.col("kind") == k
    background = P.measured_background(df, is_kind("unstained"), F.col("dye"))
    assert background.mean == pytest.approx(200, abs=2) and background.sd == pytest.approx(20, abs=1.5)
    at, cv = P.measured_dye(df, is_kind("undivided"), F.col("dye"), background)
    assert at == pytest.approx(1200, rel=0.02) and cv == pytest.approx(0.15, abs=0.02)
    mine = df.where("kind = 'cells'").unionByName(df.where("kind <> 'cells'").withColumn("sample", F.lit("control")))
    out = P.dye_generations(mine, "sample", F.col("dye"), -100.0, 4000.0, 150.0, P.DyeModel(generations=4), is_kind("undivided"), is_kind("unstained"), 200)
    told = {r.sample: r.parameters for r in out.where("bin = 0 AND part = 0").collect()}
    for s, want in truth.items():
        assert [told[s][f"g{k}"] for k in range(5)] == pytest.approx(want, abs=0.02)
    assert told["a"]["outside"] == 2 and told[None]["outside"] == 0
    # the same fit that knows of no background does not find them
    x = np.array([r[2] for r in rows if r[0] is None and r[1] == "cells"])
    edges = 150 * np.sinh(np.linspace(math.asinh(-100 / 150), math.asinh(4000 / 150), 201))
    blind, _ = P.fit_dye(edges, np.histogram(x, edges)[0].astype(float), P.DyeModel(undivided=P.Peak(initial=1200.0), generations=4))
    assert max(abs(blind[f"g{k}"] - w) for k, w in enumerate(truth[None])) > 0.05


def test_small_solvers():
    rng = np.random.default_rng(7)
    for _ in range(20):
        a, b = rng.normal(size=(12, 4)), rng.normal(size=12)
        x = fitting.nonnegative(a, b)
        pull = a.T @ (b - a @ x)
        assert (x >= 0).all() and (pull <= 1e-8).all() and np.abs(pull[x > 0]).max(initial=0) < 1e-8
    x, settled = fitting.bounded_least_squares(lambda v: np.array([10 * (v[1] - v[0] ** 2), 1 - v[0]]), np.array([-1.2, 1.0]), np.array([-2.0, -2]), np.array([2.0, 2]), 200)
    assert settled and x == pytest.approx([1, 1], abs=1e-4)
    x, _ = fitting.bounded_least_squares(lambda v: np.array([10 * (v[1] - v[0] ** 2), 1 - v[0]]), np.array([-1.2, 0.1]), np.array([-2.0, -2]), np.array([0.5, 2]), 200)
    assert x == pytest.approx([0.5, 0.25], abs=1e-4)
    assert fitting.normal_cdf(np.array([-1.0, 0.0, 2.5])) == pytest.approx([0.158655254, 0.5, 0.993790335], abs=1e-8)


def test_cycle_of_a_table(spark):
    rng = np.random.default_rng(8)
    dna, k = cells(rng, 8000, (0.5, 0.3, 0.2))
    df = spark.createDataFrame([("s", float(v)) for v in dna] + [(None, float(v)) for v in dna] + [("void", float("nan"))], "sample string, dna double")
    out = P.cell_cycle(df, "sample", F.col("dna"), 0.0, 300.0, 256)
    got = {r.sample: r for r in out.groupBy("sample").agg(F.sum(F.col("posterior") * F.col("n")).alias("n"), F.first("parameters").alias("p")).collect()}
    assert set(got) == {"s", None} and got["s"].n == pytest.approx(8000) and got[None].p["S"] == pytest.approx((k == 1).mean(), abs=0.03)


def test_queries_lose_no_event(spark):
    from eventmill.queries import estimation

    folder = "/root/testdata/sf0.001"
    total = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()}
    for query in (estimation.constrained_phases, estimation.background_generations):
        rows = query(spark, folder).collect()
        for s, n in total.items():
            mine = [r for r in rows if r["sample"] == s]
            assert sum(r["expected"] for r in mine) + mine[0]["outside"] == pytest.approx(n) and sum(r["assigned"] for r in mine) + mine[0]["outside"] == n
