"""Rings of a density region against its cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventmill.operators import gates as G, grids as D


def inside(point, ring):
    """Whether a ray to the right crosses the ring an odd number of times."""
    x, y = point
    return sum((a[1] <= y < b[1] or b[1] <= y < a[1]) and x < a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for a, b in zip(ring, [*ring[1:], ring[0]])) % 2 == 1


def test_rings_hold_the_centres_of_the_cells():
    rng = np.random.default_rng(1)
    seen = 0
    for _ in range(200):
        grid = rng.random((7, 9)) < 0.62
        seeds = np.argwhere(grid)
        region = D.connected_region(grid, tuple(seeds[rng.integers(len(seeds))]))
        outer, holes = D.region_rings(region, (-2.0, 7.0, 10.0, 24.0))
        seen += len(holes) > 1
        for j in range(7):
            for i in range(9):
                centre = (-2.0 + i + 0.5, 10.0 + 2 * (j + 0.5))
                assert (inside(centre, outer) and not any(inside(centre, h) for h in holes)) == region[j, i]
    assert seen > 10


def test_corners_and_shapes():
    square = np.zeros((4, 4), bool)
    square[1:3, 1:3] = True
    outer, holes = D.region_rings(square, (0.0, 4.0, 0.0, 4.0))
    assert sorted(outer) == [(1.0, 1.0), (1.0, 3.0), (3.0, 1.0), (3.0, 3.0)] and holes == []
    ring = np.ones((5, 5), bool)
    ring[1, 1] = ring[2, 2] = ring[3, 3] = False  # holes that touch at corners
    outer, holes = D.region_rings(ring, (0.0, 5.0, 0.0, 5.0))
    assert len(outer) == 4 and sum(map(len, holes)) >= 8
    with pytest.raises(ValueError):
        D.region_rings(np.array([[True, False, True]]), (0.0, 3.0, 0.0, 1.0))


def test_polygon_and_cells_are_one_gate(spark):
    rng = np.random.default_rng(2)
    angle, radius = rng.uniform(0, 2 * np.pi, 6000), rng.normal(5, 0.6, 6000)
    p = np.column_stack([radius * np.cos(angle), radius * np.sin(angle)])  # a ring has a hole
    df = spark.createDataFrame([(float(a), float(b)) for a, b in p] + [(float("nan"), 0.0)], "x double, y double")
    view = (-9.01, 9.02, -9.03, 9.04)
    args = (df, F.col("x"), F.col("y"), view, 24, 0.85, (5.0, 0.0))
    outer, holes = D.density_polygon(*args)
    assert holes
    both = df.select(D.density_gate(*args).alias("cells"), G.polygon_with_holes(F.col("x"), F.col("y"), outer, holes).alias("rings"))
    assert both.where("cells <> rings").count() == 0 and both.where("cells").count() > 4800
