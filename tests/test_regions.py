import pytest
from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.functions.grids import grid
from tessella.operators import guide, regions

from .test_cells import blob, frame, rows


@pytest.mark.parametrize("name", ("SQUARE", "HEXAGON", "TRIANGLE"))
def test_parts_and_holes(spark, name):
    g = grid(name)
    ring = set(g.adjacent(0, 0, "queen")) | {n for c in g.adjacent(0, 0, "queen") for n in g.adjacent(*c)} - {(0, 0)}
    far = {(x + 20 * g.pc, y) for x, y in blob(name, 6, 1)}
    df = frame(spark, [ring | far, blob(name, 9, 2)])
    n = {r.k: (r.parts, r.connected) for r in regions.connected(df, g, ["k"]).collect()}
    assert n[0] == (2, False) and n[1] == (1, True)
    assert rows(regions.holes(df.where("k = 0"), g, ["k"]).select("x", "y")) == guide.holes(ring, g) == {(0, 0)}
    assert regions.filled(df, g, ["k"]).where("k = 0").count() == len(ring | far) + 1
    assert rows(regions.hole_borders(df, g, ["k"]).select("x", "y")) >= set(g.adjacent(0, 0))


def test_rings(spark):
    g = grid("SQUARE")
    ring = {(x, y) for x in range(3) for y in range(3)} - {(1, 1)}
    got = regions.boundary_rings(frame(spark, [ring, {(0, 0), (1, 1)}]), g, ["k"]).select("k", G.signed_area(F.col("ring")).alias("a")).collect()
    assert sorted(r.a for r in got if r.k == 0) == [-1.0, 9.0]
    assert sorted(r.a for r in got if r.k == 1) == [1.0, 1.0]


def test_distance(spark):
    g = grid("SQUARE")
    a = frame(spark, [{(0, 0)}] * 4)
    b = frame(spark, [{(0, 0)}, {(1, 0)}, {(1, 1)}, {(5, 0)}])
    assert {r.k: r.steps for r in regions.distance(a, b, g, ["k"]).collect()} == {0: 0, 1: 1, 2: 2, 3: 5}
