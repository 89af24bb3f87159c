"""A NULL sample is a sample like others, in every operator that groups by it; and the faults that a review found."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventmill.operators import acquisition as A, cohorts as H, comparison as C, estimation as E, gates as G, plates, populations, tables as T
from eventmill.plans.order_statistics import percentiles


def events(spark):
    rng = np.random.default_rng(0)
    rows = []
    for s in ("a", None):  # the same events under both names
        rng = np.random.default_rng(0)
        rows += [(s, k, float(k // 2), float(v)) for k, v in enumerate(rng.normal(50, 9, 60))]
    rows += [("void", 0, None, float("nan"))]
    return spark.createDataFrame(rows, "sample string, event_id long, t double, v double")


def same_for_null(rows, key="sample"):
    by = {}
    for r in rows:
        d = r.asDict(recursive=True)
        by.setdefault(d.pop(key), []).append(str(sorted(d.items(), key=str)))
    assert None in by and sorted(by[None]) == sorted(by["a"])


def test_statistics_of_a_null_sample(spark):
    e = events(spark)
    same_for_null(populations.summary(e, ["sample"], F.col("v")).collect())
    void = populations.summary(e, ["sample"], F.col("v")).where("sample = 'void'").first()
    assert void.n == 1 and void.n_finite == 0 and void["median"] is None and void.mad is None
    columns = [T.Statistic("n"), T.Statistic("total", "percent_total"), T.Statistic("parent", "percent_parent"), *[T.Statistic(k, k, F.col("v"), 30.0) for k in (*T.ONE_PASS, *T.ORDER, *T.TWO_PASS)]]
    got = T.statistics_table(e, "sample", [G.Gate("g", G.interval(F.col("v"), 45.0, None)), G.Gate("none", G.interval(F.col("v"), 1e9, None), "g")], columns)
    same_for_null(got.drop("path").collect())
    root = got.where("sample IS NULL AND place = 0").first()
    v = [r.v for r in e.where("sample IS NULL").collect()]
    assert root.n == 60 and root["median"] == pytest.approx(np.median(v)) and root.percentile == pytest.approx(np.percentile(v, 30))
    assert root.mad == pytest.approx(np.median(np.abs(v - np.median(v)))) and root.total == 100.0
    empty = got.where("sample IS NULL AND population = 'none'").first()
    assert empty.n == 0 and empty.mad is None and empty.finite_count == 0
    controls = E.control_statistics(e.withColumn("role", F.lit("positive")), "sample", "role", {"v": F.col("v"), "t": F.col("t")})
    same_for_null(controls.collect(), "control")


def test_acquisition_of_a_null_sample(spark):
    e = events(spark)
    same_for_null(A.time_diagnostics(e, "sample", F.col("t")).collect())
    assert A.time_diagnostics(e, "sample", F.col("t")).where("sample IS NULL").first().tick == 1.0
    same_for_null(A.with_bins(e, "sample", 10).collect())
    same_for_null(A.unwrapped_clock(e, "sample", F.col("t")).collect())
    same_for_null(A.rate_bins(A.with_bins(e, "sample", 10), "sample", F.col("t")).collect())


def test_leave_one_out_against_plain_distances(spark):
    rng = np.random.default_rng(2)
    rows = [(s, float(v)) for s, m, n in (("a", 0, 40), ("b", 1, 70), (None, 3, 25), ("c", 0, 1)) for v in rng.normal(m, 1, n).round(1)]
    df = spark.createDataFrame(rows + [("a", float("nan"))], "sample string, v double")
    got = {r.population: r for r in C.leave_one_out_distances(df, "sample", F.col("v")).collect()}
    for s in ("a", "b", None, "c"):
        own, rest = (np.sort([v for k, v in rows if (k == s) is same]) for same in (True, False))
        at = np.unique([v for _, v in rows])
        d = np.abs(np.searchsorted(own, at, "right") / len(own) - np.searchsorted(rest, at, "right") / len(rest)).max()
        assert (got[s].n, got[s].n_control, got[s].reason) == (len(own), len(rest), None) and got[s].ks_distance == pytest.approx(d)
    alone = C.leave_one_out_distances(df.where("sample = 'a'"), "sample", F.col("v")).first()
    assert alone.reason and alone.ks_distance is None and alone.n_control == 0
    plan = C.leave_one_out(df, "sample", F.col("v"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


@pytest.mark.parametrize("n", [1, 2, 3, 10, 999, 30_000])
def test_percentiles_are_exact(spark, n):
    rng = np.random.default_rng(n)
    shares = [0.0, 0.001, 0.05, 0.5, 0.9, 0.999, 1.0]
    groups = {"spread": rng.normal(size=n), "tied": rng.integers(0, 4, n).astype(float), None: np.full(n, 7.0)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("void", None)], "g string, v double").repartition(3)
    got = {r.g: r for r in percentiles(df, ["g"], F.col("v"), shares).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g].n == n and got[g].q == pytest.approx(np.quantile(vs, shares), abs=1e-12)
    whole = percentiles(df, [], F.col("v"), [0.25]).first()
    assert whole.q == pytest.approx([np.quantile(np.concatenate(list(groups.values())), 0.25)])


def test_origins_out_of_order_are_found(spark):
    rows = [(0, 1, 5), (1, 1, 4), (2, 1, 6), (3, 2, 1), (4, 2, 2), (5, 2, 2)]
    df = spark.createDataFrame(rows, "merged_id long, CF_Source int, CF_EventID long")
    assert {tuple(r) for r in H.unordered_origins(df).collect()} == {(1, 4, 1), (2, 2, 2)}
    assert H.unordered_origins(df.where("merged_id IN (0, 2, 3, 4)")).collect() == []


def test_trees_are_copied_by_path(spark):
    x = F.col("x")
    tree = [G.Gate("cells", G.interval(x, 0.0, 9.0)), G.Gate("low", G.interval(x, None, 4.0), "cells"), G.Gate("high", None, "cells", operands=("low",), op="not")]
    own = [G.Gate("low", G.interval(x, 100.0, None)), G.Gate("cells", G.interval(x, 0.0, 6.0))]
    got = G.propagated(tree, {"s": own})["s"]
    assert G.paths(got) == {"low": ("low",), "cells": ("cells",), "low (2)": ("cells", "low (2)"), "high": ("cells", "high")}
    assert next(g for g in got if g.name == "high").operands == ("low (2)",)
    df = spark.createDataFrame([(float(v),) for v in range(12)], "x double")
    m = G.masks(got)
    assert [df.where(m[n]).count() for n in ("low", "cells", "low (2)", "high")] == [0, 6, 4, 2]
    replaced = G.propagated(tree, {"s": own}, replace_existing=True)["s"]
    assert df.where(G.masks(replaced)["cells"]).count() == 9 and df.where(G.masks(replaced)["low"]).count() == 0
    assert len({g.name for g in replaced}) == len(replaced) == 4
    bound = G.quality_population("good", F.col("flags"), F.col("bin"), exclusions=("time",))
    with pytest.raises(ValueError):
        G.propagated([bound], {"s": []})


def test_too_many_measures_are_refused(spark):
    many = spark.createDataFrame([("A01", f"m{k:03d}", 1.0) for k in range(65)], "well string, measure string, value double")
    with pytest.raises(ValueError):
        plates.measurement_table(many)
    assert len(plates.measurement_table(many.where("measure < 'm064'")).columns) == 65
