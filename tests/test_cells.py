import random

import pytest

from tessella.functions.grids import grid
from tessella.operators import cells, guide

NAMES = ("SQUARE", "HEXAGON", "TRIANGLE", "MIXED")


def blob(name, n, seed):
    """A connected random set of n cells."""
    g, r = grid(name), random.Random(seed)
    out = {(0, 0)}
    while len(out) < n:
        out.add(r.choice(g.adjacent(*r.choice(sorted(out)))))
    return out


def frame(spark, sets):
    return spark.createDataFrame([(k, x, y) for k, s in enumerate(sets) for x, y in s], "k int, x int, y int")


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("name", NAMES)
def test_against_python_sets(spark, name):
    g = grid(name)
    sets = [blob(name, n, n) for n in (1, 7, 25)]
    df = frame(spark, sets)
    for kind in ("rook", "queen", "bishop"):
        want = set()
        for k, s in enumerate(sets):
            rook = {n for c in s for n in g.adjacent(*c, "rook")} - s
            queen = {n for c in s for n in g.adjacent(*c, "queen")} - s
            want |= {(k, *c) for c in {"rook": rook, "queen": queen, "bishop": queen - rook}[kind]}
        assert rows(cells.neighbours(df, g, ["k"], kind)) == want
    want = {(k, *c) for k, s in enumerate(sets) for c in s if any(n not in s for n in g.adjacent(*c))}
    assert rows(cells.edge_cells(df, g, ["k"])) == want
    probe = [{n for c in s for n in g.adjacent(*c, "queen")} | s for s in sets]
    for rook in (True, False):
        got = {(r.k, r.x, r.y): r.runs for r in cells.contiguous(df, frame(spark, probe), g, ["k"], rook).collect()}
        assert got == {(k, *c): guide.runs(c, s, g, rook) for k, (s, p) in enumerate(zip(sets, probe, strict=True)) for c in p}


def test_contiguity_inside_a_full_neighbourhood(spark):
    g = grid("SQUARE")
    full = {(x, y) for x in range(3) for y in range(3)}
    r = cells.contiguous(frame(spark, [full]), frame(spark, [{(1, 1)}]), g, ["k"]).first()
    assert (r.runs, r.safe) == (1, True)


def test_set_algebra_and_contact(spark):
    g = grid("SQUARE")
    a, b = frame(spark, [{(0, 0), (1, 0)}]), frame(spark, [{(1, 0), (1, 1)}])
    assert rows(cells.union(a, b, ["k"])) == {(0, 0, 0), (0, 1, 0), (0, 1, 1)}
    assert rows(cells.intersection(a, b, ["k"])) == {(0, 1, 0)}
    assert rows(cells.difference(a, b, ["k"])) == {(0, 0, 0)}
    assert cells.overlapping(a, b, ["k"]).first().shared == 1
    far, corner, side = (frame(spark, [{c}]) for c in ((5, 5), (2, 1), (2, 0)))
    assert [cells.touching(a, x, g, ["k"], "rook").count() for x in (far, corner, side)] == [0, 0, 1]
    assert cells.touching(a, corner, g, ["k"], "queen").count() == 1
    m = cells.membership(a, frame(spark, [{(0, 0), (9, 9)}]), ["k"]).first()
    assert (m.asked, m.found, m["some"], m.all_, m.none_) == (2, 1, True, False, False)
    assert rows(cells.translate(a, 2, -1, g)) == {(0, 2, -1), (0, 3, -1)}
    with pytest.raises(ValueError):
        cells.translate(a, 1, 0, grid("TRIANGLE"))
    e = cells.tile_error(a, b, ["k"]).first()
    assert (e.cells, e.guide, e.hits, e.difference, e.relative) == (2, 2, 1, 2, 1.0)
    assert cells.neighbours(a.where("false"), g, ["k"]).count() == 0


def test_alleys_boundaries_extremes(spark):
    g = grid("SQUARE")
    # two regions around the free cell (1, 1), open above
    df = spark.createDataFrame([(0, "a", 0, 1), (0, "a", 1, 0), (0, "b", 2, 1), (0, "b", 2, 0), (0, "a", 0, 0)], "k int, r string, x int, y int")
    assert rows(cells.alleys(df, g, ["k"], "r")) == {(0, 1, 1)}
    assert cells.adjacency_counts(df, g, ["k"], "r").first().pairs == 1
    assert cells.outline_edges(frame(spark, [{(0, 0), (1, 0), (0, 1), (1, 1)}]), g, ["k"]).count() == 8
    e = cells.extremes(frame(spark, [{(0, 0), (1, 2), (3, 2)}]), ["k"]).first()
    assert (tuple(e.top_left), tuple(e.top_right)) == ((1, 2), (3, 2))


def test_overlaps_against_sets(spark):
    r = random.Random(4)
    rows = [(m, p, r.randint(0, 5), r.randint(0, 5)) for m in (1, 2, None) for p in range(5) for _ in range(9)]
    got = {tuple(x) for x in cells.overlaps(spark.createDataFrame(rows, "map_id int, partition_id int, x int, y int"), ["map_id"]).collect()}
    sets = {k: {(x, y) for m, p, x, y in rows if (m, p) == k} for k in {(m, p) for m, p, _, _ in rows if m}}
    want = {(m, p, q, n) for m, p in sets for k, q in sets if m == k and p < q and (n := len(sets[m, p] & sets[m, q]))}
    assert got == want  # a map without id isn't one
