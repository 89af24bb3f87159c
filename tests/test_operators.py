import importlib.util
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventmill.functions.columns import compensate, is_finite, ratio, scale, spectral_unmix
from eventmill.functions.formulas import compile_formula, in_order
from eventmill.operators import gates as G, populations as P
from eventmill.plans.components import connected_components
from eventmill.plans.ranks import salted_rank
from eventmill.plans.scratch import materialize

NAN = float("nan")


@pytest.fixture(scope="module")
def boundary(spark):
    rows = [(-2.0, -2.0), (0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (3.0, 0.0), (0.0, 3.0), (4.0, 4.0), (NAN, 1.0)]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, X double, Y double")


def _ids(df, test):
    return sorted(r.id for r in df.where(test).collect())


def test_gate_boundaries(boundary):
    x, y = F.col("X"), F.col("Y")
    assert _ids(boundary, G.interval(x, 0.0, 3.0)) == [1, 2, 3, 5]
    assert _ids(boundary, G.box([(x, 0.0, 3.0), (y, 0.0, 3.0)])) == [1, 2, 3]
    assert _ids(boundary, G.polygon(x, y, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])) == [1, 2, 3]
    assert _ids(boundary, G.quadrant(x, y, (0.0, 0.0), 2)) == [1, 2, 3, 4, 5, 6]


def test_complement_holds_rows_that_are_not_finite(boundary):
    x = F.col("X")
    m = G.masks([G.Gate("a", G.interval(x, 0.0)), G.Gate("not a", G.interval(x, 0.0), complement=True), G.Gate("n", operands=("a",), op="not")])
    assert _ids(boundary, m["not a"]) == _ids(boundary, m["n"]) == [0, 7]
    assert _ids(boundary, is_finite(x)) == list(range(7))
    with pytest.raises(ValueError):
        G.masks([G.Gate("a", parent="b"), G.Gate("b", parent="a")])


def test_labels_part_the_plane(boundary):
    x, y = F.col("X"), F.col("Y")
    spider = boundary.select(G.spider_label(x, y, (0.5, 0.5)).alias("l")).collect()
    curly = boundary.select(G.curly_label(x, y, (0.5, 0.5), (0.1, 0.1)).alias("l")).collect()
    assert [r.l is None for r in spider] == [r.l is None for r in curly] == [False] * 7 + [True]


@pytest.mark.parametrize("kind,p", [("log", {}), ("asinh", {}), ("gml_linear", dict(t=1000.0, a=10.0)), ("gml_log", dict(t=1000.0, m=4.0)), ("gml_asinh", dict(t=1000.0, m=4.0, a=1.0)), ("wsp_log", dict(offset=1.0, m=4.0))])
def test_scales_invert(spark, kind, p):
    df = spark.createDataFrame([(v,) for v in (1.5, 20.0, 900.0)], "v double")
    back = scale(scale(F.col("v"), kind, **p), kind, inverse=True, **p)
    assert all(math.isclose(r.v, r.b, rel_tol=1e-9) for r in df.select("v", back.alias("b")).collect())


def test_infinite_values_meet_the_bounds(spark):
    inf = float("inf")
    df = spark.createDataFrame([(inf,), (-inf,), (NAN,), (1.0,)], "v double")
    v = F.col("v")
    got = lambda c: [r.c for r in df.select(c.alias("c")).collect()]
    for kind, p, want in (("linear", {}, [5.0, -2.0]), ("asinh", {}, [5.0, -2.0]), ("wsp_log", dict(offset=1.0, m=4.0), [5.0, -2.0]), ("log", {}, [5.0, NAN]), ("gml_log", dict(t=1000.0, m=4.0), [5.0, NAN])):
        assert np.array_equal(got(scale(v, kind, low=-2.0, high=5.0, **p))[:3], [*want, NAN], equal_nan=True)
    assert np.array_equal(got(scale(v, "linear")), [inf, -inf, NAN, 1.0], equal_nan=True)
    assert np.array_equal(got(scale(v, "asinh"))[:3], [NAN] * 3, equal_nan=True)
    rows = spark.createDataFrame([(3.0, 0.0), (-3.0, 0.0), (0.0, 0.0), (3.0, -0.0), (6.0, 2.0), (inf, 2.0)], "x double, y double")
    free, bounded = zip(*rows.select(ratio(F.col("x"), F.col("y")), ratio(F.col("x"), F.col("y"), low=-9.0, high=2.0)).collect())
    assert np.array_equal(free, [inf, -inf, NAN, -inf, 3.0, inf], equal_nan=True)
    assert np.array_equal(bounded, [2.0, -9.0, NAN, -9.0, 2.0, 2.0], equal_nan=True)


def test_unmixing_recovers(spark):
    truth, spill = np.array([[10.0, 3.0]]), np.array([[1.0, 0.2], [0.1, 1.0]])
    df = spark.createDataFrame([tuple(map(float, (truth @ spill)[0])), (NAN, 1.0)], "a double, b double")
    cols = [F.col("a"), F.col("b")]
    for out in (compensate(cols, spill), spectral_unmix(cols, spill, np.array([2.0, 1.0]))):
        good, bad = df.select(*[c.alias(n) for c, n in zip(out, "xy")]).collect()
        assert np.allclose([good.x, good.y], truth[0]) and math.isnan(bad.x)
    with pytest.raises(ValueError):
        compensate(cols, np.ones((2, 2)))


def test_formulas(spark):
    df = spark.createDataFrame([(4.0, -1.0)], "a double, b double")
    c = {"a": F.col("a"), "b": F.col("b")}
    for text, want in {"sqrt(a) + 2 ** 3": 10.0, "max(a, b, 7)": 7.0, "ifelse(0 < a < 5 and not b > 0, 1, 2)": 1.0, "log(b)": NAN, "a / 0": NAN, "coalesce(log(b), 5)": 5.0}.items():
        got = df.select(compile_formula(text, c).alias("v")).first().v
        assert got == want or math.isnan(got) and math.isnan(want)
    for bad in ("__import__('os')", "a.b", "c + 1", "[a]"):
        with pytest.raises(ValueError):
            compile_formula(bad, c)
    assert in_order({"x": "y + 1", "y": "a"}) == ["y", "x"]
    with pytest.raises(ValueError):
        in_order({"x": "y", "y": "x"})


def test_pivot_has_every_value(spark):
    rows = [("a", "F", 1.0), ("a", "P", 2.0), ("a", "P", 4.0), ("b", "O", 5.0), (None, "F", NAN)]
    got = P.pivot(spark.createDataFrame(rows, "k string, s string, v double"), "k", "s", F.col("v")).collect()
    assert {(r.k, r.s): (r.n, r["mean"]) for r in got} == {(k, s): (0, None) for k in ("a", "b", None) for s in "FOP"} | {("a", "F"): (1, 1.0), ("a", "P"): (2, 3.0), ("b", "O"): (1, 5.0)}


def test_histogram_counts_what_the_view_leaves_out(spark):
    rows = [("a", v) for v in (-5.0, 0.0, 1.0, 2.0, 9.0, NAN, float("inf"))] + [("b", None)]
    got = {(r.k, r.bin): r for r in P.population_histogram(spark.createDataFrame(rows, "k string, v double"), "k", F.col("v"), 0.0, 4.0, 4).collect()}
    assert set(got) == {(k, b) for k in "ab" for b in range(4)}
    assert [got["a", b].n for b in range(4)] == [1, 1, 1, 0] and [got["a", b].cdf_n for b in range(4)] == [3, 4, 4, 4]
    assert got["a", 0][4:] == (7, 5, 1, 1) and got["b", 3][2:] == (0, 0, 1, 0, 0, 0)


def test_sparse_and_empty_time_bins_stay(spark):
    rows = [("a", float(t), 1.0 + t) for t in (0, 0, 0, 3)] + [("b", 4.0, NAN)]
    got = {(r.k, r.bin): tuple(r)[2:] for r in P.time_bins(spark.createDataFrame(rows, "k string, t double, v double"), "k", F.col("t"), F.col("v"), 4, 2.0, 2).collect()}
    want = {(k, b): (0, 0, 0, None, None, None) for k in "ab" for b in range(4)}
    assert got == want | {("a", 0): (3, 3, 0, 1.0, 1.0, 0.0), ("a", 3): (1, 1, 1, None, None, None), ("b", 3): (1, 0, 0, None, None, None)}


def test_every_population_meets_the_control(spark):
    rng = np.random.default_rng(3)
    v = {k: np.round(rng.normal(m, 3.0, n), 1) for k, m, n in (("a", 0, 90), ("control", 1, 150), ("m", 4, 60), ("z", -9, 7))}
    got = {r.population: r for r in P.ks_to_control(spark.createDataFrame([(k, float(x)) for k, xs in v.items() for x in [*xs, NAN]], "k string, v double"), "k", F.col("v"), "control").collect()}
    assert set(got) == {"a", "m", "z"}
    for k, r in got.items():
        at = np.concatenate([v[k], v["control"]])
        want = max(abs(np.mean(v[k] <= x) - np.mean(v["control"] <= x)) for x in at)
        assert math.isclose(r.distance, want, abs_tol=1e-12) and (r.n, r.n_control) == (len(v[k]), 150)


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 102), (102, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
    assert connected_components(edges.limit(0)).count() == 0


def test_salted_rank(spark):
    rows = materialize(spark.range(500).selectExpr("id", "if(id % 3 = 0, 1, id % 7) AS k"), "rows")
    by = {}
    for r in salted_rank(rows, "k", ["id"]).collect():
        by.setdefault(r.k, []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    if importlib.util.find_spec("eventmill.llm") is None:
        assert not any(k.startswith("op") for k in e.queries())
