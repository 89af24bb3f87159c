"""Percentiles of groups below and above the size that is sorted as one array."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventmill.operators import estimation as E
from eventmill.plans import joins as J, order_statistics as O

SHARES = [0.0, 0.05, 0.5, 0.9, 1.0]


def groups(spark):
    rng = np.random.default_rng(3)
    told = {"small": rng.normal(size=49), "edge": rng.normal(size=50), "large": rng.normal(size=4001), "tied": rng.integers(0, 3, 700).astype(float), None: rng.normal(size=901).round(1), "one": np.array([2.5])}
    return told, spark.createDataFrame([(g, float(v)) for g, vs in told.items() for v in vs] + [("void", None)], "g string, v double").repartition(3)


@pytest.mark.parametrize("most", [0, 50, 10**6])
def test_percentiles_and_deviations(spark, monkeypatch, most):
    monkeypatch.setattr(O, "SMALL", most)
    told, df = groups(spark)
    got = {r.g: r for r in O.percentiles(df, ["g"], F.col("v"), SHARES, deviation=True).collect()}
    assert set(got) == set(told)
    for g, vs in told.items():
        assert got[g].n == len(vs) and got[g].q == pytest.approx(np.quantile(vs, SHARES), abs=1e-12)
        assert got[g].mad == pytest.approx(np.median(np.abs(vs - np.median(vs))), abs=1e-12)


@pytest.mark.parametrize("most", [0, 50, 10**6])
def test_order_statistics_are_the_values_of_their_ranks(spark, monkeypatch, most):
    monkeypatch.setattr(O, "SMALL", most)
    told, df = groups(spark)
    count = lambda n: F.rint(n * 0.01).cast("long")
    got = {r.g: r.q for r in O.order_statistics(df, ["g"], F.col("v"), [0.01, 0.99], [lambda n: count(n) - 1, lambda n: n - count(n)]).collect()}
    for g, vs in told.items():
        c, at = round(len(vs) * 0.01), np.sort(vs)
        assert got[g] == ([at[c - 1], at[len(vs) - c]] if c else [None, None])


def test_no_task_gathers_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(O, "SMALL", 50)
    _, df = groups(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = O.percentiles(df.where("length(g) = 5 OR g = 'tied'"), ["g"], F.col("v"), SHARES)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # a sort merge join on the groups brings a group's rows to one task
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("few", [0, 2, 50_000])
@pytest.mark.parametrize("most", [0, 10**6])
def test_trimmed_pairs_without_gathering_a_group(spark, monkeypatch, most, few):
    monkeypatch.setattr(O, "SMALL", most)
    monkeypatch.setattr(J, "FEW", few or 1)
    rng = np.random.default_rng(5)
    told = {"a": rng.normal(size=(900, 2)), "b": rng.integers(0, 30, (700, 2)).astype(float), "c": np.column_stack([np.full(250, 3.0), rng.normal(size=250)]), "d": rng.normal(size=(20, 2))}
    df = spark.createDataFrame([(g, float(x), float(y)) for g, v in told.items() for x, y in v], "g string, x double, y double").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = E.trimmed_pairs(df, ["g"], "x", "y")
        plan = kept._jdf.queryExecution().executedPlan().toString()
        got = {g: sorted((r.x, r.y) for r in kept.where(F.col("g") == g).collect()) for g in told}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert few != 50_000 or "SortMergeJoin" not in plan
    for g, v in told.items():
        count, inside = round(len(v) * 0.01), np.ones(len(v), bool)
        for axis in v.T:
            at = np.sort(axis)
            if count and at[0] < at[-1]:
                inside &= (axis > at[count - 1]) & (axis < at[len(v) - count])
        assert got[g] == sorted(map(tuple, v[inside].tolist()))
