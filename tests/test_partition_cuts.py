import random

import numpy as np
import pytest

from tessella.functions.grids import grid, inside
from tessella.operators import combine, partition


def star(rng, n):
    return np.array([((r := rng.uniform(0.4, 3)) * np.cos(2 * np.pi * k / n), r * np.sin(2 * np.pi * k / n)) for k in range(n)])


def area(p):
    return float((p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum() / 2)


def border(p):
    return float(np.hypot(*(np.roll(p, -1, 0) - p).T).sum())


def by_polygons(ring, sites, kind, dilation, productivity):
    """The same greedy choice on drawn polygons: cut the one on whose border both ends lie, measure the two sides."""
    b = partition.Boundary(ring)
    raw = partition.candidates(b, kind)
    cuts = sorted(((float(np.hypot(*(b.point(e) - b.point(s)))), s, e) for s, e in raw), key=lambda c: c[0])
    left = [c for c in cuts if min(b.at(c[2]) - b.at(c[1]), b.total - b.at(c[2]) + b.at(c[1])) / c[0] >= dilation]
    place = sorted({round(b.at(p), 9) for _, s, e in left for p in (s, e)} | {round(float(x), 9) for x in b.start})
    at = {p: b.ring[k] for k, p in enumerate(np.round(b.start, 9).tolist())} | {round(b.at(p), 9): b.point(p) for _, s, e in left for p in (s, e)}
    polygons, applied = [place], 0
    for long, s, e in left:
        x, y = round(b.at(s), 9), round(b.at(e), 9)
        for k, p in enumerate(polygons):
            if x in p and y in p and (i := p.index(x)) < (j := p.index(y)):
                one, two = p[i : j + 1], p[: i + 1] + p[j:]
                rings = [np.array([at[q] for q in side]) for side in (one, two)]
                if min(len(one), len(two)) > 2 and all(border(r) - long >= dilation * long - 1e-9 and sum(inside(r, *q) for q in sites) >= productivity for r in rings):
                    polygons[k : k + 1] = [one, two]
                    applied += 1
                break
    return [np.array([at[q] for q in p]) for p in polygons], {"found": len(raw), "remaining": len(left), "applied": applied}


@pytest.mark.parametrize("kind", partition.CUT_TYPES)
def test_cuts_against_polygons(kind):
    rng = random.Random(kind)
    applied = 0
    for _ in range(20):
        ring = star(rng, rng.randint(8, 50))
        sites = np.array([(rng.uniform(-2, 2), rng.uniform(-2, 2)) for _ in range(80)])
        sites = np.array([s for s in sites if inside(ring, *s)]).reshape(-1, 2)
        d, p = rng.choice([1.2, 1.6, 2.2]), rng.choice([1, 2, 3])
        got, stats = partition.split(ring, sites, kind, d, p)
        want, counts = by_polygons(ring, sites, kind, d, p)
        assert stats == counts
        assert np.allclose(sorted(map(area, got)), sorted(map(area, want))) and abs(sum(map(area, got)) - area(ring)) < 1e-9
        applied += stats["applied"]
    assert applied > 20


def test_cut_tree_and_splicing():
    rng = random.Random(4)
    for _ in range(60):
        cuts = []

        def divide(lo, hi, depth):
            if depth and hi - lo > 2:
                mid = sorted(rng.sample(range(lo, hi + 1), 2))
                if mid[0] < mid[1]:
                    cuts.append(tuple(mid))
                    divide(*mid, depth - 1)
                    divide(lo, mid[0], depth - 1)
                    divide(mid[1], hi, depth - 1)

        divide(0, 60, 5)
        cuts = list(dict.fromkeys(cuts))
        rng.shuffle(cuts)
        around = [[j for j, c in enumerate(cuts) if j != i and c[0] <= cuts[i][0] and cuts[i][1] <= c[1]] for i in range(len(cuts))]
        inner = lambda i, ok: min((j for j in around[i] if ok(j)), key=lambda j: cuts[j][1] - cuts[j][0], default=-1)
        tree = partition.cut_tree(cuts)
        assert tree == [inner(i, lambda j: True) for i in range(len(cuts))]
        long = [rng.uniform(0.5, 20) for _ in cuts]
        wide = [min(e - s, 60 - e + s) >= 1.5 * x for (s, e), x in zip(cuts, long)]
        assert partition.wide_cuts(cuts, long, 60, 1.5) == [inner(i, wide.__getitem__) if wide[i] else -2 for i in range(len(cuts))]
    with pytest.raises(ValueError):
        partition.cut_tree([(0, 5), (3, 8)])
    assert partition.cut_tree([(1, 4), (1, 4), (4, 6)]) in ([-1, 0, -1], [1, -1, -1]) and partition.cut_tree([]) == []


def test_repeated_cuts(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 1.0000000001), ("a", 3.0, 3.0), ("b", 1.0, 2.0), ("a", None, 2.0)], "k string, start double, end double")
    assert sorted(map(tuple, partition.distinct_cuts(df, ["k"]).collect())) == [("a", 1.0, 2.0), ("b", 1.0, 2.0)]


@pytest.mark.parametrize("name", ["SQUARE", "HEXAGON", "TRIANGLE", "MIXED"])
def test_free_offset_is_the_nearest(name):
    rng, g = random.Random(name), grid(name)
    for _ in range(12):
        shape = lambda n: {(rng.randint(-3, 3) * g.pc + rng.randrange(g.pc), rng.randint(-3, 3)) for _ in range(n)}
        still, moving = shape(rng.randint(1, 14)), shape(rng.randint(1, 14))
        at, of = rng.choice(sorted(still)), rng.choice(sorted(moving))
        direction = np.array(rng.choice([(0.0, 0.0), (rng.uniform(-1, 1), rng.uniform(-1, 1))]))
        base = ((at[0] - of[0]) // g.pc * g.pc, at[1] - of[1])
        closed = still | {n for c in still for n in g.adjacent(*c)}
        free = []
        for i in range(-25, 26):
            for j in range(-25, 26):
                v = g.lattice @ np.array([i, j])
                if (i, j) != (0, 0) and direction.any() and v @ direction <= 1e-12:
                    continue
                o = (base[0] + i * g.pc, base[1] + j)
                if not any((x + o[0], y + o[1]) in closed for x, y in moving):
                    free.append((round(float(np.hypot(*v)), 9), -round(float(v @ direction), 9), i, j, o))
        assert combine.free_offset(g, still, moving, at, of, direction) == min(free)[-1]
