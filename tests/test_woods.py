import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import groups, planar
from tessella.plans import planar_queries
from tests.test_planar import blob, meet, square_rings

SF = "/root/testdata/sf0.001"


def graphs(spark, sizes):
    """The duals of blobs of squares, drawn with a point in each square."""
    rng = random.Random(5)
    edges, points = [], []
    for g, size in enumerate(sizes):
        cells = blob(rng, size)
        points += [(g, i, float(x), float(y)) for i, (x, y) in enumerate(cells)]
        rotation, _ = planar.rotation_of(square_rings(cells))
        edges += [(g, u, v) for u in rotation for v in rotation[u] if u < v]
    return spark.createDataFrame(edges, "o int, u int, v int"), spark.createDataFrame(points, "o int, v int, x double, y double")


def sent(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_a_graph_is_sent_once(spark):
    """Half-edges, their ends and pairs of edges aren't sent: the shuffles of the wood and of its check were many times the input."""
    assert sent(planar.schnyder(*graphs(spark, [5, 9]), ["o"])) == 1
    q = planar_queries.schnyder_wood(spark, SF)
    assert sent(q) == 2 and "Join" not in q._jdf.queryExecution().executedPlan().toString()


def test_tasks_of_graphs_follow_their_rows(spark, monkeypatch):
    seen, real = [], groups.dealt
    monkeypatch.setattr(groups, "dealt", lambda df, keys, rows: seen.append(rows) or real(df, keys, rows, 10))
    edges, points = graphs(spark, [5, 9, 20])
    got = planar.schnyder(edges, points, ["o"])
    assert seen == [edges.count() + points.count()]
    assert got.where("v IS NOT NULL").count() == 34


def test_half_edges_of_a_graph_as_by_joins(spark):
    edges, points = graphs(spark, [2, 3, 7, 20, 60])
    odd = edges.unionByName(edges.limit(9)).unionByName(spark.createDataFrame([(3, 1, 1), (3, 2, 999), (3, None, 2)], edges.schema))  # repeats, a loop, no such ends
    want = {(r.o, r.u, r.v, r.w) for r in planar.half_edges(odd, points, ["o"]).collect()}
    got = set()
    for g in range(5):
        at = {r.v: (r.x, r.y) for r in points.where(F.col("o") == g).collect()}
        rows = odd.where(F.col("o") == g).where("u <> v").collect()
        got |= {(g, *h) for h in planar._halves([r.u for r in rows], [r.v for r in rows], at)}
    assert got == want
    woods = planar.woods(odd, points, ["o"]).collect()
    assert {r.o: sum(v is not None for v in r.v) for r in woods} == {1: 3, 2: 7, 3: 20, 4: 60}


def test_a_graph_without_a_key_has_its_wood(spark):
    """Joins on the key left it out, where the SQL groups it as any other."""
    edges, points = (df.withColumn("o", F.when(F.col("o") > 0, F.col("o"))) for df in graphs(spark, [7, 9]))
    got = planar.schnyder(edges, points, ["o"]).where("v IS NOT NULL").groupBy("o").count().collect()
    assert {r.o: r["count"] for r in got} == {None: 7, 1: 9}


def test_crossings_and_places_are_judged(spark, monkeypatch):
    """A wood's coordinates put at random: the query finds the pairs of edges that meet, as counted one by one."""
    rng = random.Random(11)
    real, spoilt = planar.woods, {}

    def woods(edges, points, key):
        w = real(edges, points, key)
        rows = w.where("size(a) > 3").orderBy("o").limit(8).collect()
        for r in rows[:-1]:
            n = len(r.a)
            a, b = [rng.randrange(n) for _ in range(n)], [rng.randrange(n) for _ in range(n)]
            spoilt[r.o] = (*r[:2], a, b, [9] * n, *r[5:])
        a, b = list(rows[-1].a), list(rows[-1].b)  # two vertices in one place
        a[3], b[3] = a[4], b[4]
        spoilt[rows[-1].o] = (*rows[-1][:2], a, b, *rows[-1][4:])
        return spark.createDataFrame(list(spoilt.values()), w.schema)

    monkeypatch.setattr(planar, "woods", woods)
    got = {r.o: r for r in planar_queries.schnyder_wood(spark, SF).collect()}
    assert len(got) == len(spoilt) == 8
    for o, _, a, b, _, left, right, top in spoilt.values():
        n = len(a)
        edges = [(i, p[i]) for p in (left, right, top) for i in range(n) if p[i] is not None] + [(0, 1), (0, n - 1), (1, n - 1)]
        at = [np.array((x, y), float) for x, y in zip(a, b)]
        pairs = [(e, f) for e, f in itertools.combinations(edges, 2) if not {*e} & {*f}]
        signs = [(e, f) for e, f in pairs if meet(*(at[k] for k in (*e, *f)))]
        # segments in one line, all four turns zero, don't count in the query
        turned = [p for p in signs if any(_turn(*(at[k] for k in t)) for t in ((*p[0], p[1][0]), (*p[0], p[1][1]), (*p[1], p[0][0]), (*p[1], p[0][1])))]
        assert got[o].crossings == len(turned) and got[o].edges == len(edges) == 3 * n - 6
        assert got[o].on_grid == (len({*zip(a, b)}) == n)
    assert sum(r.crossings for r in got.values()) > 50 and not got[max(got)].on_grid


def _turn(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
