import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.grids import grid, ring_area
from tessella.operators import align, analyze, assign, combine, dual, guide, partition, spatial
from tessella.operators.arrange import CARTOGRAM, GRID_MAP, Mosaic
from tessella.operators.flow import Flow, bridges

from .fixtures import DUMBBELL, lobes, square, tile_map


@pytest.mark.parametrize("n", range(1, 7))
def test_assignment_is_optimal(n):
    rng = np.random.default_rng(n)
    for m in (n, n + 2):
        cost = rng.uniform(0, 10, (n, m))
        got = assign.solve(cost)
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        assert len(set(got)) == n and abs(cost[np.arange(n), got].sum() - best) < 1e-9


def test_flow_matches_brute_force():
    rng = random.Random(3)
    for _ in range(20):
        f = Flow(4)
        arcs = [(a, b, rng.randint(0, 2), rng.randint(-1, 5)) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3), (1, 2))]
        numbers = [f.add(*a) for a in arcs]
        f.supply[0], f.supply[3] = 3, -3
        sent, cost = f.solve()
        best = None
        for flow in itertools.product(*(range(c + 1) for *_, c, _ in arcs)):
            net = [0] * 4
            for (a, b, *_), x in zip(arcs, flow, strict=True):
                net[a] -= x
                net[b] += x
            if net[1] == net[2] == 0 and net[3] <= 3:
                key = (-net[3], sum(x * w for (*_, w), x in zip(arcs, flow, strict=True)))
                best = key if best is None else min(best, key)
        assert (-sent, cost) == best
        assert sum(f.flow(k) * a[3] for k, a in zip(numbers, arcs, strict=True)) == cost


def test_bridges():
    assert bridges(4, [(0, 1), (1, 2), (2, 0), (2, 3)]) == [(2, 3, {3})]
    assert sorted(min(s) for *_, s in bridges(3, [(0, 1), (1, 2)])) == [0, 2]
    assert bridges(3, [(0, 1), (1, 2), (0, 2)]) == []


@pytest.mark.parametrize("kind", partition.CUT_TYPES)
def test_dumbbell_is_cut_once(kind):
    ring, sites = np.array(DUMBBELL, float), np.array(lobes())
    rings, stats = partition.split(ring, sites, kind, 3.0, 10)
    assert stats["applied"] == 1 and abs(sum(map(ring_area, rings)) - ring_area(ring)) < 1e-9
    assert partition.split(ring, sites, kind, 3.0, 13)[1]["applied"] == 0
    assert partition.split(ring, sites, kind, 30.0, 10)[1]["applied"] == 0


def test_partition_of_tables(spark):
    m, stats = partition.partition(tile_map(spark, "dumbbell", "square9", "archipelago"), productivity=10)
    n = {(r.map_id, r.outline_id): r.applied for r in stats.collect()}
    assert n[("dumbbell", 0)] == 1 and n[("square9", 0)] == 0
    per = {r.partition_id: r["count"] for r in m.sites.where("map_id = 'dumbbell'").groupBy("partition_id").count().collect()}
    assert sorted(per.values()) == [12, 12]
    assert m.sites.where("partition_id is null").count() == 0
    assert m.maps.where("stage = 2").count() == 3
    with pytest.raises(ValueError):
        partition.partition(m, kind="ODD")


def test_duals_and_components(spark):
    m = partition.trivial(tile_map(spark, "pair", "corner", "archipelago"))
    e = dual.dual_edges(m.partitions)
    assert [r.map_id for r in e.collect()] == ["pair"]
    c = dual.components(m.partitions, e)
    n = {r.map_id: r["count"] for r in c.select("map_id", "comp_id").distinct().groupBy("map_id").count().collect()}
    assert n == {"pair": 1, "corner": 2, "archipelago": 4}
    w = dual.component_weights(c, dual.weights(m.partitions, m.sites))
    assert {r.weight for r in w.where("map_id = 'pair'").collect()} == {18}


def test_long_chain_of_components(spark):
    p = spark.createDataFrame([("m", 0, i) for i in range(40)], "map_id string, outline_id int, partition_id int")
    pair = lambda i: {"outline_id": 0, "partition_id": i}
    e = spark.createDataFrame([("m", pair(i), pair(i + 1)) for i in range(38)], "map_id string, p1 struct<outline_id:int,partition_id:int>, p2 struct<outline_id:int,partition_id:int>")
    got = {r.partition_id: r.comp_id.partition_id for r in dual.components(p, e).collect()}
    assert got == {i: 0 for i in range(39)} | {39: 39}


@pytest.mark.parametrize("name", ("SQUARE", "HEXAGON", "STAGSQUARE", "TRIANGLE", "NS2", "GEESE", "MIXED"))
def test_guides(name):
    g, ring = grid(name), np.array(DUMBBELL, float)
    q = guide.quality_map(ring * np.sqrt(g.average_area), g)
    assert abs(sum(q.values()) / g.average_area - 208) < 1e-6
    cells, areas, factor, _ = guide.best_shape(ring, 15, g, 2)
    assert len(cells) == 15 and len(guide.parts_of(cells, g)) == 1 and not guide.holes(cells, g)
    assert abs(factor**2 * 208 - 15 * g.average_area) < 1e-6 * g.average_area
    assert sum(areas.get(c, 0) for c in cells) > 10 * g.average_area


@pytest.mark.parametrize("name", ("SQUARE", "HEXAGON", "TRIANGLE"))
def test_arrangement_invariants(name):
    g = grid(name)
    rings = [np.array(square(x, y, w, h), float) for x, y, w, h in ((0, 0, 10, 10), (10, 0, 10, 10), (0, 10, 10, 10), (10, 10, 10, 10), (20, 0, 4, 20))]
    edges, tiles = {(0, 1), (0, 2), (1, 3), (2, 3), (1, 4), (3, 4)}, [12, 20, 9, 14, 6]
    m = Mosaic.arranged(rings, tiles, edges, g, GRID_MAP)
    assert [len(c) for c in m.cells] == tiles
    assert all(len(guide.parts_of(c, g)) == 1 for c in m.cells)
    assert len(guide.parts_of(set(m.owner), g)) == 1
    loose = Mosaic.arranged(rings, tiles, edges, g, CARTOGRAM)
    assert all(len(guide.parts_of(c, g)) == 1 for c in loose.cells)


def test_alignments(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 5, (30, 2))
    c = x * [2.0, 3.0] + [1.0, -4.0]
    df = spark.createDataFrame([(0, *map(float, a), *map(float, b)) for a, b in zip(x, c, strict=True)], "partition_id int, x double, y double, cx double, cy double")
    for f in (align.nonuniform_aware, align.nonuniform_agnostic, align.bbox_agnostic):
        t = (f(df, ["partition_id"]) if f is align.nonuniform_aware else f(df, df.select("partition_id", "cx", "cy"), ["partition_id"])).first().t
        assert np.allclose(t, (2, 3, 1, -4))
    t = align.uniform_aware(df, ["partition_id"]).first().t

    def residual(s):
        d = (x - x.mean(0)) * s - (c - c.mean(0))
        return (d * d).sum()

    assert residual(t.sx) <= min(residual(t.sx + e) for e in (-1e-3, 1e-3))
    same = spark.createDataFrame([(0, 1.0, 1.0, 0.0, 0.0), (0, 1.0, 2.0, 0.0, 3.0)], df.schema)  # one column of sites
    assert align.nonuniform_agnostic(same, same.select("partition_id", "cx", "cy"), ["partition_id"]).first().t.sx == 1.0
    with pytest.raises(ValueError):
        align.align("none", df, df, None, ["partition_id"])


def test_nearest_sites_is_exact(spark):
    rng = np.random.default_rng(5)
    pts = np.concatenate([rng.uniform(0, 1, (60, 2)), rng.uniform(50, 51, (6, 2)), [[0.5, 0.5]] * 4])
    df = spark.createDataFrame([("m", i, *map(float, p)) for i, p in enumerate(pts)], "map_id string, site_id int, x double, y double")
    for k in (1, 7, 80):
        got = {}
        for r in spatial.nearest_sites(df, k, ["map_id"]).collect():
            got.setdefault(r.site_id, []).append((r["rank"], r.nbr))
        for i, p in enumerate(pts):
            want = sorted((j for j in range(len(pts)) if j != i), key=lambda j: (float(((pts[j] - p) ** 2)[0] + ((pts[j] - p) ** 2)[1]), j))[:k]
            assert [n for _, n in sorted(got[i])] == want
    assert spatial.nearest_sites(df, 0, ["map_id"]).count() == len(pts) * (len(pts) - 1)
    assert spatial.nearest_sites(df, -1, ["map_id"]).count() == 0


def test_locate_takes_the_first(spark):
    box = lambda *a: [{"x": float(x), "y": float(y)} for x, y in square(*a)]
    rings = spark.createDataFrame([("m", 2, box(0, 0, 4)), ("m", 1, box(2, 2, 4)), ("m", 3, [{"x": float(x), "y": float(y)} for x, y in DUMBBELL])], "map_id string, o int, ring array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([("m", 0, 1.0, 1.0), ("m", 1, 3.0, 3.0), ("m", 2, 5.5, 5.5), ("m", 3, 12.0, 9.0), ("m", 4, None, 1.0)], "map_id string, i int, x double, y double")
    assert {r.i: r.o for r in spatial.locate(pts, rings, ["map_id", "i"], "o", ["map_id"]).collect()} == {0: 2, 1: 1, 2: 1, 3: None, 4: None}


def test_free_offset_keeps_apart():
    for name in ("SQUARE", "HEXAGON", "TRIANGLE"):
        g = grid(name)
        a = {(x, y) for x in range(4) for y in range(4)}
        for direction in ((1.0, 0.2), (-1.0, 0.0), (0.0, 0.0)):
            dx, dy = combine.free_offset(g, a, a, (0, 0), (2, 2), np.array(direction))
            moved = {(x + dx, y + dy) for x, y in a}
            assert not moved & a and not any(n in a for c in moved for n in g.adjacent(*c))
            assert dx % g.pc == 0


def test_summary_positions(spark):
    rows = [("m", "Displacement-Uni", float(v)) for v in range(20)] + [("m", "GuidingShapeFit-quality", float(v)) for v in range(20)] + [("m", "Deformation-5", 3.0)]
    s = {r.analyzer: r for r in analyze.summarize(spark.createDataFrame(rows, "map_id string, analyzer string, value double")).collect()}
    d, g, one = s["Displacement-Uni"], s["GuidingShapeFit-quality"], s["Deformation-5"]
    assert (d.max, d.min, d.pct90, d.pct75, d.total) == (19, 0, 17, 14, 190)
    assert (g.max, g.min, g.pct90, g.pct75) == (0, 19, 2, 5)
    assert (one.max, one.min, one.pct90, one.pct75) == (3, 3, 3, 3)


def test_nearest_partitions(spark):
    m = partition.trivial(tile_map(spark, "archipelago"))
    comps = m.partitions.withColumn("c", F.col("outline_id"))
    r = spatial.nearest_partitions(comps, "c", ["map_id"]).where("a = 0 and b = 1").first()
    assert abs(r.distance - 2.0) < 1e-9
