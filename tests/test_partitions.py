"""Angular and curved partitions, and the biexponential scale, by what defines them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventmill.functions.scales import Biexponential, biex_table
from eventmill.operators import gates as G


def points(spark, rows):
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(rows)], "id int, x double, y double").orderBy("id")


def test_arms_and_what_lies_beside_them(spark):
    """A point on each arm, and points a little off it to both sides."""
    centre, scale, angles = (-3.0, 8.0), (4.0, 0.5), (0.7, 1.9, 3.6, 6.1)
    rows, want = [], []
    for k, a in enumerate(angles):
        for off, label in ((1e-6, G.SECTORS[k]), (-1e-6, G.SECTORS[k - 1])):
            for r in (0.01, 3.0):
                rows.append((centre[0] + scale[0] * r * math.cos(a + off), centre[1] + scale[1] * r * math.sin(a + off)))
                want.append(label)
    rows.append(centre)
    want.append(G.CENTRE_OWNER)
    got = [r.s for r in points(spark, rows).select(G.spider_label(F.col("x"), F.col("y"), centre, scale, angles).alias("s")).collect()]
    assert got == want


def test_upright_arms_are_owned(spark):
    c = (2.5, -1.0)
    rows = [(c[0] + 4, c[1]), (c[0], c[1] + 4), (c[0] - 4, c[1]), (c[0], c[1] - 4), (c[0], float("nan")), (float("inf"), c[1])]
    got = [r.s for r in points(spark, rows).select(G.spider_label(F.col("x"), F.col("y"), c).alias("s")).collect()]
    assert got == [*G.ARM_OWNERS, None, None]
    # upright arms part the plane as quadrants do
    rng = np.random.default_rng(11)
    df = points(spark, rng.integers(-4, 5, (300, 2)) / 2 + np.array(c))
    both = df.select(G.spider_label(F.col("x"), F.col("y"), c).alias("s"), *[G.quadrant(F.col("x"), F.col("y"), c, k).alias(f"q{k}") for k in (1, 2, 3, 4)]).collect()
    assert all(r[f"q{k}"] == (r.s == k) for r in both for k in (1, 2, 3, 4))


def test_a_turned_partition_is_the_partition_turned(spark):
    rng = np.random.default_rng(12)
    p = rng.normal(size=(400, 2))
    angles, by = (0.3, 1.1, 2.9, 5.0), 1.3
    turned = p @ np.array([[math.cos(by), math.sin(by)], [-math.sin(by), math.cos(by)]])
    label = lambda rows, a: [r.s for r in points(spark, rows).select(G.spider_label(F.col("x"), F.col("y"), (0.0, 0.0), (1.0, 1.0), a).alias("s")).collect()]
    assert label(p, angles) == label(turned, tuple((a + by) % (2 * math.pi) for a in angles))


def test_curved_thresholds_by_points_on_them(spark):
    """Points right on a threshold belong to its upper side; a nudge below they do not."""
    cx, cy, kx, ky = 40.0, -6.0, 3.0, 0.5
    rows, want = [], []
    for s in (1.0, 25.0, 400.0, 10_000.0):
        x = cx + kx * math.sqrt(s)  # the threshold of x where y = s
        for dx, right in ((1e-6, True), (-1e-6, False)):
            rows.append((x + dx, s))
            want.append(right)
    got = [r.s for r in points(spark, rows).select(G.curly_label(F.col("x"), F.col("y"), (cx, cy), (kx, ky)).alias("s")).collect()]
    assert [s in (2, 3) for s in got] == want
    flat = points(spark, [(cx, cy), (cx - 1, cy), (cx, -50.0), (39.0, -50.0)])
    assert [r.s for r in flat.select(G.curly_label(F.col("x"), F.col("y"), (cx, cy), (kx, ky)).alias("s")).collect()] == [2, 1, 3, 4]
    # without a rise they are plain quadrants
    rng = np.random.default_rng(13)
    df = points(spark, rng.normal(0, 60, (300, 2)))
    both = df.select(G.curly_label(F.col("x"), F.col("y"), (cx, cy), (0.0, 0.0)).alias("s"), *[G.quadrant(F.col("x"), F.col("y"), (cx, cy), k).alias(f"q{k}") for k in (1, 2, 3, 4)]).collect()
    assert all(r[f"q{k}"] == (r.s == k) for r in both for k in (1, 2, 3, 4))
    with pytest.raises(ValueError):
        G.curly_label(F.col("x"), F.col("y"), (0.0, 0.0), (-1.0, 1.0))


@pytest.mark.parametrize("negative, width", [(0.0, -10.0), (1.0, -100.0), (0.5, -3.2)])
def test_the_biexponential_meets_its_conditions(negative, width):
    raw, at = biex_table(negative=negative, width=width)
    f = Biexponential(4.418540, negative, math.log10(-width), 262144.000029, 4096)
    z = f.zero
    assert raw[z] == 0 and np.allclose(raw[z + 1 : 2 * z + 1], -raw[z - 1 :: -1][: z])
    # the growing part reaches the top at the end of the axis
    assert f.p * math.exp(f.b * (1 - z / 4097)) == pytest.approx(262144.000029)
    # both parts bend alike in the centre of the middle, where they meet
    decades = f.b / math.log(10)
    t = math.log10(-width) / (2 * decades) + (max(negative, 0) + math.log10(-width) / 2) / decades - z / 4097
    assert f.p * math.exp(f.b * t) == pytest.approx(f.n * math.exp(-f.d * t))
    assert 2 * math.log(f.d / f.b) + math.log10(-width) / (2 * decades) * (f.d + f.b) == pytest.approx(0, abs=1e-9)
    assert (np.diff(raw) > 0).all() and at[-1] == 4096


def test_queries_recover_the_mixture(spark):
    from eventmill.queries import estimation

    folder = "/root/testdata/sf0.001"
    got = {(r.stain, r.detector): r.coefficient for r in estimation.refined_spillover(spark, folder).collect()}
    want = {(a, b): estimation._SPILL[i, j] for i, a in enumerate("XYZ") for j, b in enumerate("XYZ")}
    # quantities follow prices, so a trace of the noise is spill
    assert all(abs(got[k] - want[k]) < 5e-3 for k in want)
    shares = {(r.stain, r.detector): r.share for r in estimation.refined_signatures(spark, folder).collect()}
    assert all(abs(v - want[k]) < 5e-3 for k, v in shares.items()) and len(shares) == 6
