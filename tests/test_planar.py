import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import dual, planar


def blob(rng, size):
    """``size`` squares that hang together."""
    cells = {(0, 0)}
    while len(cells) < size:
        x, y = rng.choice(sorted(cells))
        dx, dy = rng.choice([(1, 0), (-1, 0), (0, 1), (0, -1)])
        cells.add((x + dx, y + dy))
    return sorted(cells)


def square_rings(cells):
    return [np.array([[x - 0.5, y - 0.5], [x + 0.5, y - 0.5], [x + 0.5, y + 0.5], [x - 0.5, y + 0.5]]) for x, y in cells]


def adjoining(cells):
    return {frozenset((i, j)) for i, j in itertools.combinations(range(len(cells)), 2) if abs(cells[i][0] - cells[j][0]) + abs(cells[i][1] - cells[j][1]) == 1}


def turn(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def meet(a, b, c, d):
    """Whether two closed segments have a point in common."""
    s = [np.sign(turn(a, b, c)), np.sign(turn(a, b, d)), np.sign(turn(c, d, a)), np.sign(turn(c, d, b))]
    if not any(s):
        return all(max(min(a[k], b[k]), min(c[k], d[k])) <= min(max(a[k], b[k]), max(c[k], d[k])) for k in (0, 1))
    return s[0] * s[1] <= 0 and s[2] * s[3] <= 0


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7, 20, 60])
def test_contacts_right_after_the_embedding_are_the_dual(size):
    rng = random.Random(size)
    for _ in range(12):
        cells = blob(rng, size)
        rotation, outer = planar.rotation_of(square_rings(cells))
        want = adjoining(cells)
        assert {frozenset((u, v)) for u in rotation for v in rotation[u]} == want
        assert size == 1 or size - len(want) + len(planar.walks(rotation)) == 2
        at = planar.on_cells(rotation, outer)
        for steps in ([(1, 0), (0, 1)], [(1, 0), (0, 1), (1, 1), (1, -1)]):
            assert {frozenset((r, at[x + i, y + j])) for (x, y), r in at.items() for i, j in steps if at.get((x + i, y + j), r) != r} == want
        for r in range(size):
            own = {c for c, o in at.items() if o == r}
            seen = [min(own)]
            for x, y in seen:
                seen += [c for c in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)) if c in own and c not in seen]
            assert set(seen) == own


@pytest.mark.parametrize("size", [3, 5, 9, 16])
def test_wood_and_its_coordinates(size):
    rng = random.Random(size)
    for _ in range(5):
        full, corner = planar.triangulated(*planar.rotation_of(square_rings(blob(rng, size))))
        n, wood = len(full), planar.Wood(full, corner)
        edges = {frozenset((u, v)) for u in full for v in full[u]}
        assert len(edges) == 3 * n - 6 and all(len(w) == 3 for w in planar.walks(full))
        coloured = [frozenset(e) for tree in wood.parent for e in tree.items()]
        assert len(coloured) == len(set(coloured)) == 3 * n - 9 and all(len(tree) == n - 3 for tree in wood.parent)
        for v in wood.order[2:-1]:  # out of one tree, then into the next, and so on
            kinds = [next(k for k in range(6) if (k % 2 == 0 and wood.parent[k // 2].get(v) == u) or (k % 2 and wood.parent[((k + 3) // 2) % 3].get(u) == v)) for u in full[v]]
            kinds = kinds[kinds.index(0) :] + kinds[: kinds.index(0)]
            assert kinds == sorted(kinds)
        for tree, root in zip(wood.parent, (wood.left, wood.right, wood.top)):
            for v in tree:
                while v in tree:
                    v = tree[v]
                assert v == root
        at = wood.coordinates()
        assert len(set(at.values())) == n and all(sum(p) == n - 1 and min(p) >= 0 for p in at.values())
        for e, f in itertools.combinations(edges, 2):
            if not e & f:
                assert not meet(*(at[v] for v in e), *(at[v] for v in f))


def test_order_of_a_graph_that_isnt_triangulated_fails():
    with pytest.raises(ValueError):
        planar.shelling({0: [1, 3], 1: [2, 0], 2: [3, 1], 3: [0, 2]}, (0, 1, 2))


def test_convex_parts():
    rng = random.Random(7)
    rings = [[(0, 0), (10, 0), (10, 4), (14, 4), (14, 0), (24, 0), (24, 10), (14, 10), (14, 6), (10, 6), (10, 10), (0, 10)], [(0, 0), (2, 0), (4, 0), (4, 3), (2, 3), (0, 3)], [(0, 0), (1, 0), (0, 1)]]
    for n in range(5, 40):  # stars
        rings.append([((r := rng.uniform(0.2, 2)) * np.cos(2 * np.pi * k / n), r * np.sin(2 * np.pi * k / n)) for k in range(n)])
    for points in rings:
        ring = np.array(points, float)
        parts = planar.convex_parts(ring)
        area = lambda p: float((p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum() / 2)
        assert abs(sum(area(ring[p]) for p in parts) - area(ring)) < 1e-9
        for p in parts:
            assert area(ring[p]) > 0 and all(turn(ring[p[i - 1]], ring[p[i]], ring[p[(i + 1) % len(p)]]) >= -1e-9 for i in range(len(p)))
        reflex = sum(turn(ring[i - 1], ring[i], ring[(i + 1) % len(ring)]) < -1e-12 for i in range(len(ring)))
        assert len(parts) <= 2 * reflex + 1  # four times the fewest possible, which are half the reflex corners and one
    assert [len(planar.convex_parts(np.array(r, float))) for r in rings[1:3]] == [1, 1]


def test_decomposition_of_rings(spark):
    rows = [(1, [(0.0, 0.0), (0.0, 2.0), (1.0, 1.0), (2.0, 2.0), (2.0, 0.0)]), (2, [(0.0, 0.0), (1.0, 0.0)]), (3, None), (4, [])]
    df = spark.createDataFrame(rows, "k int, ring array<struct<x:double,y:double>>")
    got = planar.convex_decomposition(df, ["k"]).collect()
    assert {r.k for r in got} == {1} and len(got) == 2 and all(len(r.ring) >= 3 for r in got)


def test_faces_against_walks(spark):
    rng = random.Random(3)
    edges, points, want = [], [], set()
    for g in range(6):
        cells = blob(rng, 30 if g else 2)
        number = {c: i for i, c in enumerate(cells)}
        points += [(g, i, float(x), float(y)) for (x, y), i in number.items()]
        edges += [(g, *sorted(e, reverse=bool(g % 2))) for e in adjoining(cells)]
        rotation = {}
        for x, y in cells:  # straight lines between the squares' middles
            near = [(np.arctan2(j, i), number[x + i, y + j]) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1)) if (x + i, y + j) in number]
            rotation[number[x, y]] = [u for _, u in sorted(near)]
        for walk in planar.walks(rotation):
            area = sum(cells[u][0] * cells[v][1] - cells[v][0] * cells[u][1] for u, v in walk) / 2
            want.add((g, *min(walk), len(walk), area, area <= 0))
    e = spark.createDataFrame([*edges, edges[0], (0, 1, 1)], "g int, u int, v int")
    v = spark.createDataFrame(points, "g int, v int, x double, y double")
    table = planar.face_table(planar.faces(planar.half_edges(e, v, ["g"]), ["g"]), v, ["g"])
    assert {(r.g, r.face.u, r.face.v, r.n_edges, r.area, r.outer) for r in table.collect()} == want
    none = planar.face_table(planar.faces(planar.half_edges(e.limit(0), v, ["g"]), ["g"]), v, ["g"])
    assert none.count() == 0


def test_embedding_of_components(spark):
    rng = random.Random(9)
    rows = []
    for m, size in (("a", 25), ("b", 1), ("c", 40)):
        for i, ring in enumerate(square_rings(blob(rng, size))):
            ring = ring if i % 2 else ring[::-1]
            rows.append((m, i, 0, [tuple(map(float, p)) for p in ring]))
    p = spark.createDataFrame(rows, "map_id string, outline_id int, partition_id int, ring array<struct<x:double,y:double>>")
    e = dual.dual_edges(p)
    at = planar.embedding(p, dual.components(p, e)).collect()
    cells = {(r.map_id, r.x, r.y): r.outline_id for r in at}
    assert len(cells) == len(at) and {(r.map_id, r.outline_id) for r in at} == {(m, i) for m, i, _, _ in rows}
    got = {(m, *sorted((r, cells[m, x + i, y + j]))) for (m, x, y), r in cells.items() for i, j in ((1, 0), (0, 1), (1, 1), (1, -1)) if cells.get((m, x + i, y + j), r) != r}
    assert got == {(r.map_id, *sorted((r.p1.outline_id, r.p2.outline_id))) for r in e.select("map_id", F.col("p1"), F.col("p2")).collect()}
