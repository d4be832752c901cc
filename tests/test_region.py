"""Regions by cells against plain ray casting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rfrank.operators import region
from rfrank.sources import regions


def covers(rings, x, y):
    inside = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (x1, y1) == (x2, y2):
                continue
            if (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return True
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1):
                inside = not inside
    return inside


def star(rng, cx, cy, n, near, far):
    return [[cx + r * math.cos(a), cy + r * math.sin(a)] for a, r in ((2 * math.pi * i / n, rng.uniform(near, far)) for i in range(n))]


def plain(shapes, points):
    return [next((name for _, name, rings in shapes if covers(rings, x, y)), None) for x, y in points]


SHAPES = "region_no int, region string, rings array<array<array<double>>>"


@pytest.mark.parametrize("n", [1, 3, 10, None])
@pytest.mark.parametrize("seed", [1, 2])
def test_stars_squares_and_holes(spark, seed, n):
    rng = random.Random(seed)
    square = lambda x, y, d: [[float(p), float(q)] for p, q in ((x, y), (x + d, y), (x + d, y + d), (x, y + d))]
    shapes = [
        (0, "star", [star(rng, 3, 2, 40, 2, 9), star(rng, 3, 2, 9, 0.5, 1.5)]), (1, "squares", [square(-10, -10, 20), square(-8, -8, 4), [*square(12, 0, 3), [12.0, 0.0]]]), (2, "far", [star(rng, 170, -60, 12, 1, 12)]),
        (3, "thin", [[[-40.0, 10.0], [40.0, 10.5], [40.0, 10.0]]]), (4, "comb", [[[20.0, 20.0], *[[20 + i / 4, 20.0 + 5 * (i % 2)] for i in range(1, 40)], [30.0, 18.0]]]),
    ]
    points = [(rng.uniform(-20, 20), rng.uniform(-20, 30)) for _ in range(1500)] + [(rng.uniform(155, 185), rng.uniform(-75, -45)) for _ in range(300)]
    points += [(rng.randrange(-24, 48) / 2, rng.randrange(-24, 64) / 2) for _ in range(1500)]
    points += [p for _, _, rings in shapes for ring in rings for p in map(tuple, ring)]  # vertices
    points += [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for _, _, rings in shapes for ring in rings for a, b in zip(ring, ring[1:], strict=False)]
    edges = regions.edges(spark.createDataFrame(shapes, SHAPES))
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, lon double, lat double")
    got = {r.i: r.region for r in region.classify(frame, edges, cells_per_degree=n).collect()}
    assert [got[i] for i in range(len(points))] == plain(shapes, points)
    assert len({*got.values()}) > 5


def test_a_border_of_many_edges_is_met_by_few(spark):
    """10^5 edges: no point tests more than a few dozen of them, and most test none."""
    ring = [[20 * math.cos(2 * math.pi * i / 100_000) * (1 + 0.05 * math.sin(40 * 2 * math.pi * i / 100_000)), 20 * math.sin(2 * math.pi * i / 100_000)] for i in range(100_000)]
    edges = regions.edges(spark.createDataFrame([(0, "r", [ring])], SHAPES)).cache()
    n = region.fineness(edges)
    _, cells = region.cover(edges, n)
    most = cells.select(F.explode("near").alias("r")).agg(F.max(F.size("r.edges"))).first()[0]
    assert edges.count() == 100_000 and most <= 64
    rng = random.Random(5)
    points = [(rng.uniform(-22, 22), rng.uniform(-22, 22)) for _ in range(400)] + [(x * 0.999, y * 0.999) for x, y in ring[::1000]]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, lon double, lat double")
    got = {r.i: r.region for r in region.classify(frame, edges).collect()}
    assert [got[i] for i in range(len(points))] == plain([(0, "r", [ring])], points)
    edges.unpersist()


def test_points_without_coordinates_and_no_regions(spark):
    edges = regions.edges(spark.createDataFrame([(0, "r", [[[-1.0, -1.0], [1.0, -1.0], [1.0, 1.0], [-1.0, 1.0]]])], SHAPES))
    points = spark.createDataFrame([(0.0, 0.0), (None, 0.0), (0.0, None), (float("nan"), 0.0), (0.0, float("nan")), (5.0, 5.0)], "lon double, lat double")
    assert [r.region for r in region.classify(points, edges).collect()].count("r") == 1
    assert region.classify(points, edges.limit(0)).filter("region is not null").count() == 0
    assert region.classify(points.limit(0), edges).count() == 0
