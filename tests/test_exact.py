"""Kernels against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from tessella.functions.grids import BASES, inside, nearest_hexagon
from tessella.functions.shapes import label_place, without_degeneracies
from tessella.operators import analyze, spatial
from tessella.operators.partition import Boundary, arcs


def jagged(n, seed):
    rng = np.random.default_rng(seed)
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    return np.stack([np.cos(angle), np.sin(angle)], 1) * rng.uniform(5, 10, n)[:, None]


def meets(b, v, t):
    """What the disc through v in direction t meets first, by its radius to every feature."""
    p, u, best = b.ring[v], np.array([math.cos(t), math.sin(t)]), (math.inf, None)
    for k in range(b.n):
        rel = b.ring[k] - p
        if b.reflex[k] and k != v and rel @ u > 1e-12:
            best = min(best, (rel @ rel / (2 * (rel @ u)), ("point", k)))
        unit = b.step[k] / b.len[k]
        normal = np.array([-unit[1], unit[0]])
        gap = (p - b.ring[k]) @ normal
        if k not in (v, (v - 1) % b.n) and gap > 1e-12 and 1 - u @ normal > 1e-12:
            r = gap / (1 - u @ normal)
            if -1e-9 <= (p + r * u - b.ring[k]) @ unit <= b.len[k] + 1e-9:
                best = min(best, (r, ("edge", k)))
    return best


def test_no_arc_is_lost():
    for seed in range(3):
        b = Boundary(jagged(90, seed))
        for v in np.flatnonzero(b.reflex)[:8].tolist():
            found = arcs(b, v)
            lo, hi = found[0][2], found[-1][3]
            for t in np.linspace(lo, hi, 1500)[1:-1]:
                want = meets(b, v, t)[1]
                near = [a for a in found if a[2] - 1e-7 <= t <= a[3] + 1e-7]
                assert want is None or want in [(a[0], a[1]) for a in near], (seed, v, t, want, near)


def test_hexagons_are_nearest():
    rng = np.random.default_rng(1)
    g = BASES["HEXAGON"]
    for px, py in rng.uniform(-30, 30, (400, 2)):
        x, y = nearest_hexagon(px, py)
        own = np.hypot(*(g.centroid(x, y) - (px, py)))
        assert inside(g.boundary(x, y), px, py)
        assert all(own <= np.hypot(*(g.centroid(*c) - (px, py))) + 1e-9 for c in g.adjacent(x, y))


def test_irregular_tiles_hold_their_points():
    rng = np.random.default_rng(2)
    for name in ("GEESE", "MIXED", "NS3"):
        g = BASES[name]
        scale = 300 if name == "GEESE" else 30
        px, py = rng.uniform(-scale, scale, (2, 200))
        x, y, found = g.containing_many(px, py)
        assert found.all() and all(inside(g.boundary(int(a), int(b)), p, q) for a, b, p, q in zip(x, y, px, py, strict=True))
    assert not BASES["GEESE"].containing_many(np.array([np.nan]), np.array([1.0]))[2][0]


def test_labels_stand_inside():
    for seed in range(20):
        ring = jagged(25, seed)
        assert inside(ring, *label_place(ring))
    thin = np.array([(0, 0), (100, 0.1), (200, 0), (100, 0.3)], float)
    assert inside(thin, *label_place(thin))
    assert len(without_degeneracies(np.array([(0, 0), (0, 0), (1, 0), (2, 0), (2, 0), (2, 2), (0, 2)], float))) == 4


def test_discordant_pairs():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 100):
        x, r = rng.uniform(0, 5, n).round(1), rng.integers(0, 6, n).astype(float)
        x[: n // 3] = x[0]
        got = analyze.discordant(x, r, 1e-6)
        d, e = x[None] - x[:, None], r[None] - r[:, None]
        assert (got == ((np.abs(d) > 1e-6) & (np.abs(e) > 1e-6) & (np.sign(d) != np.sign(e))).sum(1)).all()


def test_discordances_in_strips(spark):
    rng = np.random.default_rng(6)
    rows = []
    for m, n in (("a", 400), ("b", 30), ("c", 1), ("d", 120), ("e", 90)):
        x, r = rng.normal(size=n), rng.normal(size=n)
        if m == "d":  # values in common, some within eps of each other
            x, r = rng.integers(0, 5, n) + rng.choice([0, 4e-7], n), rng.integers(0, 9, n).astype(float)
        if m == "e":
            x[:] = 3.0
        rows += [(m, i, float(p), float(q)) for i, (p, q) in enumerate(zip(x, r, strict=True))]
    df = spark.createDataFrame(rows, "map_id string, i int, x double, r double")
    want = {}
    for m in "abcde":
        x, r = (np.array([row[c] for row in rows if row[0] == m]) for c in (2, 3))
        d, e = x[None] - x[:, None], r[None] - r[:, None]
        want |= {(m, i): int(c) for i, c in enumerate(((np.abs(d) > 1e-6) & (np.abs(e) > 1e-6) & (np.sign(d) != np.sign(e))).sum(1))}
    for size in (1000, 50, 13):
        got = analyze.discordances(df, ["map_id", "i"], 1e-6, size).collect()
        assert len(got) == len(want) and {(r.map_id, r.i): r.d for r in got} == want


def test_ranks_without_sorting_all(spark):
    rng = np.random.default_rng(4)
    rows = [("m", a, float(v)) for a, n in (("A", 1), ("B", 37), ("GuidingShapeFit-x", 400)) for v in rng.choice([0.0, 1e9, *rng.normal(size=20)], n)]
    got = {r.analyzer: r for r in analyze.summarize(spark.createDataFrame(rows, "map_id string, analyzer string, value double")).collect()}
    for a, r in got.items():
        v = sorted((x for _, b, x in rows if b == a), reverse=not a.startswith("Guiding"))
        n = len(v)
        assert (r["count"], r.max, r.min) == (n, v[0], v[-1])
        assert (r.pct90, r.pct75) == (v[min(math.ceil(n / 10), n - 1)], v[min(math.ceil(n / 4), n - 1)])


def test_neighbours_of_clusters(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.01, (60, 2)), rng.normal(50, 0.01, (60, 2)), rng.uniform(0, 100, (20, 2))])
    s = spark.createDataFrame([("m", i, float(a), float(b)) for i, (a, b) in enumerate(x)], "map_id string, site_id int, x double, y double")
    got = {}
    for r in spatial.nearest_sites(s, 5, ["map_id"]).collect():
        got.setdefault(r.site_id, set()).add(r.nbr)
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(1)
        assert got[i] == set(np.argsort(np.where(np.arange(len(x)) == i, np.inf, d), kind="stable")[:5])
    left = s.where("site_id < 60").select(F.lit(1).alias("k"), F.col("site_id").alias("a"), "x", "y")
    right = s.where("site_id >= 60").select(F.lit(1).alias("k"), F.col("site_id").alias("b"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    pair = spatial.nearest_pair(left, right, ["k"], ["a", "b"], sample=3).first()
    d = ((x[:60, None] - x[None, 60:]) ** 2).sum(-1)
    assert (pair.a, pair.b - 60) == np.unravel_index(d.argmin(), d.shape)
