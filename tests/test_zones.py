"""Ring collections, interior points, bins by size and touched cells against plain geometry."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from fieldframe.operators import zones as Z

RINGS = "zone int, rings array<array<struct<x:double,y:double>>>"


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def square(x, y, size):
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]


SHAPES = {
    1: [square(0.0, 0.0, 4.0), square(1.0, 1.0, 2.0)],  # a hole
    2: [square(10.0, 0.0, 1.0), square(12.0, 3.0, 2.0)],  # two parts
    3: [[(20.0, 0.0), (26.0, 0.0), (26.0, 5.0), (25.0, 5.0), (25.0, 1.0), (21.0, 1.0), (21.0, 5.0), (20.0, 5.0), (20.0, 0.0)]],  # a cup
    4: [square(30.0, 0.0, 6.0), square(31.0, 1.0, 4.0), square(32.0, 2.0, 2.0)],  # an island in a hole
    5: [[(40.0, 0.0), (44.0, 4.0), (40.0, 8.0), (43.0, 4.0), (40.0, 0.0)]],  # a hook with a corner at half its height
}


def test_interior_points_lie_inside(spark):
    draw = random.Random(1)
    shapes = dict(SHAPES)
    for k in range(100, 160):  # stars around a centre, with points in and out
        corners = [(50 + draw.uniform(1, 9) * c, 50 + draw.uniform(1, 9) * s) for c, s in [(1, 0), (0.7, 0.7), (0, 1), (-0.7, 0.7), (-1, 0), (-0.7, -0.7), (0, -1), (0.7, -0.7)]]
        shapes[k] = [[*corners, corners[0]]]
    rows = [*shapes.items(), (7, [[(1.0, 1.0), (3.0, 1.0), (1.0, 1.0)]]), (8, []), (9, None)]
    placed = Z.with_interior_point(Z.zones_from_rings(spark.createDataFrame(rows, RINGS), "rings"))
    found = {r.zone: (r.lon, r.lat) for r in placed.collect()}
    assert all(inside(*found[k], rings) for k, rings in shapes.items())
    assert found[7] == found[8] == found[9] == (None, None)


def test_holes_islands_and_assignment(spark):
    zones = Z.zones_from_rings(spark.createDataFrame(list(SHAPES.items()), RINGS), "rings")
    draw = random.Random(2)
    points = [(i, draw.uniform(-1, 46), draw.uniform(-1, 9)) for i in range(600)]
    df = spark.createDataFrame(points, "id int, lon double, lat double")
    found = {r.id: r.zone for r in Z.point_in_zone(df, zones, "id", "zone").collect()}
    assert found == {i: next((k for k, rings in SHAPES.items() if inside(x, y, rings)), None) for i, x, y in points}
    units = spark.createDataFrame([(1, [square(0.2, 0.2, 0.5)]), (2, [square(1.5, 1.5, 0.5)]), (3, [square(90.0, 0.0, 1.0)])], "unit int, rings array<array<struct<x:double,y:double>>>")
    assert {r.unit: r.zone for r in Z.assign_units(units, "rings", zones, "unit", "zone").collect()} == {1: 1, 2: None, 3: None}


def test_bins_follow_the_size_of_a_zone(spark):
    """Zones from a hundredth to a hundred degrees: few rows each, an equality join, all pairs of a plain loop."""
    draw = random.Random(3)
    boxes = [(k, *(draw.uniform(-170, 70), draw.uniform(-80, 0)), 10 ** draw.uniform(-2, 2)) for k in range(300)]
    zones = Z.zones_from_rings(spark.createDataFrame([(k, [square(x, y, s)]) for k, x, y, s in boxes], RINGS), "rings")
    assert Z.binned_zones(zones).groupBy("zone").count().agg(F.max("count")).first()[0] <= 4
    points = [(i, x + draw.uniform(-0.2, 1.2) * s, y + draw.uniform(-0.2, 1.2) * s) for i, (_, x, y, s) in enumerate(boxes)]
    df = spark.createDataFrame(points, "id int, lon double, lat double")
    joined = Z.join_zones(df, zones)
    want = {(i, k) for i, px, py in points for k, x, y, s in boxes if inside(px, py, [square(x, y, s)])}
    rows = joined.collect()
    assert {(r.id, r.zone) for r in rows} == want and len(rows) == len(want)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert Z.point_in_zone(df, zones.limit(0), "id", "zone").where("zone is null").count() == len(points)


def meets(edge, i, j):
    """Whether a segment passes through the inside of the unit square at (i, j); exact clipping."""
    (x1, y1), (x2, y2) = [(Fraction(a), Fraction(b)) for a, b in edge]
    low, high = Fraction(0), Fraction(1)
    for start, step, a in ((x1, x2 - x1, i), (y1, y2 - y1, j)):
        if not step:
            if not a < start < a + 1:
                return False
            continue
        t = sorted(((a - start) / step, (a + 1 - start) / step))
        low, high = max(low, t[0]), min(high, t[1])
    return low < high


@pytest.mark.parametrize("seed", range(3))
def test_touched_cells_equal_a_test_of_every_square(spark, seed):
    draw = random.Random(seed)
    shapes = {}
    for k in range(12):
        grain = draw.choice([1, 2, 64])  # corners on the lattice, on half cells, anywhere
        ring = [(draw.randint(0, 12 * grain) / grain, draw.randint(0, 10 * grain) / grain) for _ in range(draw.randint(3, 7))]
        shapes[k] = [[*ring, ring[0]]]
    shapes[20] = [square(2.0, 2.0, 4.0)]
    shapes[21] = [[(3.25, 0.5), (3.5, 0.5), (3.5, 9.5), (3.25, 9.5), (3.25, 0.5)]]
    shapes[22] = [square(0.125, 0.125, 0.25)]
    cells = [(i, j, i + 0.5, j + 0.5) for i in range(13) for j in range(11)]
    df = spark.createDataFrame(cells * 2, "i int, j int, lon double, lat double")
    zones = Z.zones_from_rings(spark.createDataFrame(list(shapes.items()), RINGS), "rings")
    found = Z.cell_zones(df, zones, "zone", 1.0, all_touched=True).collect()
    want = {(i, j, k) for i, j, x, y in cells for k, (ring,) in shapes.items() if inside(x, y, [ring]) or any(meets(e, i, j) for e in zip(ring, ring[1:]))}
    assert {(r.i, r.j, r.zone) for r in found} == want and len(found) == 2 * len(want)
    centres = Z.cell_zones(df, zones, "zone", 1.0)
    assert {(r.i, r.j, r.zone) for r in centres.collect()} == {(i, j, k) for i, j, x, y in cells for k, rings in shapes.items() if inside(x, y, rings)}
    shifted = Z.cell_zones(df.withColumns({"lon": F.col("lon") / 4 + 7, "lat": F.col("lat") / 4 - 3}), zones.withColumn("_edges", F.transform("_edges", lambda e: F.struct(
        *[(e[c] / 4 + (7 if c[0] == "x" else -3)).alias(c) for c in ("x1", "y1", "x2", "y2")]))).withColumns({"_x1": F.col("_x1") / 4 + 7, "_x2": F.col("_x2") / 4 + 7, "_y1": F.col("_y1") / 4 - 3, "_y2": F.col("_y2") / 4 - 3}),
        "zone", 0.25, 7.0, -3.0, all_touched=True)
    assert {(r.i, r.j, r.zone) for r in shifted.collect()} == want
