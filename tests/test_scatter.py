"""The clean-up of scatter against a plain version that holds everything in one array."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventmill.operators import scatter as S


def plain_density(d, factor):
    axes = [np.linspace(d[:, k].min(), d[:, k].max(), 100) for k in (0, 1)]
    w = []
    for k in (0, 1):
        lo, hi = np.quantile(d[:, k], [0.25, 0.75])
        w.append(factor * 1.06 * min(np.std(d[:, k], ddof=1), (hi - lo) / 1.34) * len(d) ** -0.2)
    gx, gy = np.meshgrid(*axes, indexing="ij")
    total = np.zeros((100, 100))
    for a, b in d:
        total += np.exp(-0.5 * ((gx - a) / w[0]) ** 2 - 0.5 * ((gy - b) / w[1]) ** 2)
    return axes, total / (2 * np.pi * len(d) * w[0] * w[1])


def plain_tile(d, factor, reach, target, corner):
    axes, z = plain_density(d, factor)
    peaks = []
    for j in range(100):
        for i in range(100):
            if z[i, j] > 0 and z[i, j] >= z[max(0, i - reach) : i + reach + 1, max(0, j - reach) : j + reach + 1].max():
                peaks.append((-z[i, j], j, i))
    at = np.array([[axes[0][i], axes[1][j]] for _, j, i in sorted(peaks)])
    wanted = 0
    if corner:
        wanted = int(np.flatnonzero((((at - d.min(0)) / np.ptp(d, axis=0)) > 0.05).any(1))[0]) + target - 1
    return d[[np.hypot(*(at - p).T).argmin() == wanted for p in d]], at[wanted], len(at)


def plain_cleanup(points, ranges, threshold=0.33):
    d = points[np.isfinite(points).all(1)]
    low, high = np.maximum(0, d.min(0)), np.minimum(ranges, d.max(0))
    a, b = low + 0.01 * (high - low), low + 0.99 * (high - low)
    bound, first, n1 = plain_tile(d[((d > a) & (d < b)).all(1)], 3.0, 3, 1, True)
    m = np.median(bound, axis=0)
    s = 3 * 1.4826 * np.median(np.abs(bound - m), axis=0)
    region = d[((d > np.maximum(a, m - s)) & (d < np.minimum(b, m + s))).all(1)]
    tile, second, n2 = plain_tile(region, 2.0, 2, 1, False)
    axes, z = plain_density(tile, 1.0)
    score = []
    for p in tile:
        i, j = (min(98, int(np.searchsorted(axes[k], p[k], "right")) - 1) for k in (0, 1))
        u, v = ((p[k] - axes[k][q]) / (axes[k][q + 1] - axes[k][q]) for k, q in ((0, i), (1, j)))
        score.append((1 - u) * (1 - v) * z[i, j] + u * (1 - v) * z[i + 1, j] + (1 - u) * v * z[i, j + 1] + u * v * z[i + 1, j + 1])
    score = np.array(score)
    inside = tile[score > (1 - threshold) * score.min() + threshold * score.max()]
    return inside, first, second, (n1, n2)


def in_hull(points, corners):
    """On the left of every side of a counter-clockwise ring, or on it."""
    after = np.roll(corners, -1, axis=0)
    side = after - corners
    turn = side[:, 0] * (points[:, None, 1] - corners[:, 1]) - side[:, 1] * (points[:, None, 0] - corners[:, 0])
    return (turn >= -1e-9 * np.abs(side).sum(1) * 1e3).all(1)


def controls():
    rng = np.random.default_rng(6)
    out = {}
    for name, centre in (("a", (400, 300)), ("b", (600, 500)), (None, (300, 600))):
        cells = rng.normal(centre, (40, 30), (900, 2))
        debris = rng.exponential(20, (500, 2))
        other = rng.normal((800, 800), 25, (200, 2))
        out[name] = np.concatenate([cells, debris, other, [[np.nan, 1.0], [np.inf, 2.0], [5.0, np.nan]]])
    return out


def test_gates_equal_a_plain_version(spark):
    data = controls()
    rows = [(c, k, float(p[0]), float(p[1])) for c, pts in data.items() for k, p in enumerate(pts)]
    rows += [("few", k, 1.0 * k, 2.0) for k in range(5)] + [("flat", k, 7.0, 1.0 + k) for k in range(50)]
    df = spark.createDataFrame(rows, "sample string, k int, x double, y double").repartition(5)
    gates = S.scatter_cleanup(df, "sample", F.col("x"), F.col("y"), (1000.0, 1000.0))
    assert gates["few"].reason == "too few finite events" and gates["flat"].reason == "no positive range" and not gates["flat"].vertices
    inside = {(r.sample, r.k) for r in df.where(S.cleaned(F.col("sample"), F.col("x"), F.col("y"), gates)).collect()}
    for c, pts in data.items():
        dense, first, second, counts = plain_cleanup(pts, np.array([1000.0, 1000.0]))
        assert gates[c].peaks == [pytest.approx(tuple(first)), pytest.approx(tuple(second))] and tuple(gates[c].peak_counts) == counts
        corners = np.array(gates[c].vertices)
        assert {tuple(p) for p in corners} <= {tuple(p) for p in dense}
        assert in_hull(dense, corners).all()
        finite = np.isfinite(pts).all(1)
        want = {(c, int(k)) for k in np.flatnonzero(finite)[in_hull(pts[finite], corners)]}
        assert {m for m in inside if m[0] == c} == want and 300 < len(want) < 1000
    assert not [m for m in inside if m[0] in ("few", "flat")]


def test_hull_and_empty_table(spark):
    rng = np.random.default_rng(1)
    for pts in (rng.integers(0, 6, (60, 2)).astype(float), rng.normal(size=(200, 2))):
        hull = S.convex_hull(pts)
        assert in_hull(pts, hull).all() and {tuple(p) for p in hull} <= {tuple(p) for p in pts}
        assert all(not in_hull(pts, np.delete(hull, k, 0)).all() for k in range(len(hull)))
    assert len(S.convex_hull(np.array([[0.0, 0], [1, 1], [2, 2], [3, 3]]))) == 2
    df = spark.createDataFrame([], "sample string, x double, y double")
    assert S.scatter_cleanup(df, "sample", F.col("x"), F.col("y"), (1.0, 1.0)) == {}


def test_the_query_equals_a_plain_version_of_its_table(spark):
    from eventmill.queries import estimation

    folder = "/root/testdata/sf0.001"
    got = {r.control: (r.events, r.kept) for r in estimation.scatter_cleanup(spark, folder).collect()}
    rows = estimation._scatter(spark, folder).toPandas()
    for c, own in rows.groupby("control"):
        pts = own[["x", "y"]].to_numpy()
        dense, *_ = plain_cleanup(pts, np.array([1200.0, 1200.0]))
        assert got[c] == (len(pts), int(in_hull(pts, S.convex_hull(dense)).sum()))
