import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.functions.grids import BASES, grid, inside, neighbour_table, tile_table

NAMES = sorted(BASES)


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(NAMES), st.integers(-40, 40), st.integers(-40, 40), st.floats(-180, 180), st.floats(0.2, 4), st.floats(0.2, 4))
def test_cell_of_centroid(name, x, y, degrees, sx, sy):
    g = grid(name).rotate(degrees).scale(sx, sy)
    c = g.centroid(x, y)
    if inside(g.boundary(x, y), *c):
        assert g.containing(*c) == (x, y)


@pytest.mark.parametrize("name", NAMES)
def test_tiles_fill_the_plane(name):
    g = grid(name)
    assert math.isclose(sum(g.areas), g.average_area * g.pc, rel_tol=1e-9)
    for v in range(g.pc):
        for dx, dy, kind in g.neighbours[v]:
            back = [(a, b, k) for a, b, k in g.neighbours[(v + dx) % g.pc] if (a, b) == (-dx, -dy)]
            assert [k for *_, k in back] == [kind]


@settings(max_examples=100, deadline=None)
@given(st.sampled_from([n for n in NAMES if n not in ("TRIANGLE", "EQUILATERAL")]), *[st.integers(-20, 20)] * 4)
def test_norm_is_symmetric(name, a, b, c, d):
    g = grid(name)
    assert g.norm(a, b, c, d) == g.norm(c, d, a, b)
    assert g.norm(a, b, a, b) == 0


def test_hexagonal_norm_is_graph_distance():
    g = grid("HEXAGON")
    seen, ring = {(0, 0): 0}, [(0, 0)]
    for d in range(1, 6):
        ring = [n for c in ring for n in g.adjacent(*c) if n not in seen and not seen.update({n: d})]
    assert all(g.norm(0, 0, *c) == d for c, d in seen.items())


def test_names_round_trip_and_bad_names():
    g = grid("HEXAGON!r!30.0!s!2.0!0.5!h!0.1!0.0")
    assert g.name == "HEXAGON!r!30.0!s!2.0!0.5!h!0.1!0.0"
    with pytest.raises(ValueError):
        grid("CIRCLE")
    with pytest.warns(UserWarning):
        assert grid("SQUARE!q").name == "SQUARE"


@pytest.mark.parametrize("name", NAMES)
def test_columns_agree_with_python(spark, name):
    g = grid(name)
    if g.matrix == (1.0, 0.0, 0.0, 1.0, 0.0, 0.0):
        g = g.rotate(20).scale(1.5, 0.7)
    side = math.sqrt(g.average_area)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.random.default_rng(1).uniform(-6, 6, (40, 2)) * side)]
    df = spark.createDataFrame(pts, "i int, x double, y double")
    got = df.select("i", "x", "y", G.containing_cell(F.col("x"), F.col("y"), g).alias("c")).collect()
    for r in got:
        assert (r.c.x, r.c.y) == g.containing(r.x, r.y)
    cells = spark.createDataFrame([(x, y, x + 3, y - 2) for x in range(-4, 5) for y in (-3, 0, 2)], "x int, y int, u int, v int")
    rows = cells.select("*", G.cell_centroid(F.col("x"), F.col("y"), g).alias("c"), G.norm(F.col("x"), F.col("y"), F.col("u"), F.col("v"), g).alias("n"), G.area(G.cell_boundary(F.col("x"), F.col("y"), g)).alias("a")).collect()
    for r in rows:
        assert np.allclose((r.c.x, r.c.y), g.centroid(r.x, r.y))
        assert r.n == g.norm(r.x, r.y, r.u, r.v)
        assert math.isclose(r.a, g.areas[r.x % g.pc], rel_tol=1e-9)


def test_lookup_tables(spark):
    g = grid("NS2")
    assert tile_table(spark, g).count() == 4
    assert neighbour_table(spark, g).where("kind = 'rook'").groupBy("variant").count().where("count = 4").count() == 4


def test_refinement_partitions_cells(spark):
    for name in ("SQUARE", "HEXAGON"):
        fine = [c for x in range(-3, 4) for y in range(-3, 4) for c in grid(name).refined(x, y)]
        assert len(fine) == len(set(fine)) == 4 * 49
    with pytest.raises(ValueError):
        G.refine(F.col("x"), F.col("y"), grid("MIXED"))
