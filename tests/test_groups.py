from collections import Counter

from tessella.operators import flow, planar
from tessella.operators.groups import each_group


def test_a_batch_holds_many_groups_and_each_is_given_once(spark):
    """Each group is one call, whatever its size, and calls share a task's Python; groups may give no rows, keys and values may be null."""
    rows = [(k if k else None, i, None if i == 1 else float(i)) for k in range(500) for i in range(k % 7 + 1)]
    df = spark.createDataFrame(rows, "k int, i long, x double")
    plan = each_group(df, ["k"], ["i", "x"], lambda i, x: [(len(i), sum(v or 0.0 for v in x))] if len(i) > 1 else [], "n long, total double")
    want = Counter(k for k, _, _ in rows)
    got = plan.collect()
    assert {r.k: (r.n, r.total) for r in got} == {k: (n, n * (n - 1) / 2 - (n > 1)) for k, n in want.items() if n > 1}
    assert len(got) == sum(n > 1 for n in want.values())
    assert "FlatMapGroups" not in plan._jdf.queryExecution().toString()
    assert each_group(df.where("false"), ["k"], ["i"], lambda i: [(1,)], "n long").count() == 0


def test_graphs_of_one_shape_share_a_wood_but_not_their_outer_face(spark):
    """A triangle with a vertex in its middle, drawn twice with other corners outside, and a graph too large to remember."""
    places = {0: {1: (0, 0), 2: (4, 0), 3: (0, 4), 4: (1, 1)}, 1: {4: (0, 0), 2: (4, 0), 3: (0, 4), 1: (1, 1)}}
    places[2] = {v: (float(v), float(v * v)) for v in range(1, 60)}
    edges = [(g, u, v) for g in (0, 1) for u in range(1, 5) for v in range(u + 1, 5)]
    edges += [(2, v - 1, v) for v in range(2, 60)] + [(2, 1, v) for v in range(3, 60)]
    e = spark.createDataFrame(edges, "o int, u int, v int")
    v = spark.createDataFrame([(g, v, float(x), float(y)) for g, p in places.items() for v, (x, y) in p.items()], "o int, v int, x double, y double")
    plan = planar.schnyder(e, v, ["o"])
    assert "FlatMapGroups" not in plan._jdf.queryExecution().toString()
    got = plan.collect()
    inner = {r.o: r.v for r in got if r.o < 2 and r.left is not None}
    assert inner == {0: 4, 1: 1}
    big = [r for r in got if r.o == 2]
    assert len([r for r in big if r.v is not None]) == 59 and len({(r.a, r.b) for r in big}) == len(big)


def test_flows_and_bridges_of_many_graphs(spark):
    arcs = spark.createDataFrame([(g, a, b, 1, abs(a - b) + g / 10) for g in range(40) for a in (2, 4) for b in (1, 5)], "g int, a long, b long, capacity long, cost double")
    supplies = spark.createDataFrame([(g, v, s) for g in range(40) for v, s in ((2, 1), (4, 1), (1, -1), (5, -1))], "g int, v long, supply long")
    f = flow.cheapest_flow(arcs, supplies, ["g"])
    assert sorted((r.g, r.a, r.b) for r in f.where("flow = 1").collect()) == [(g, *p) for g in range(40) for p in ((2, 1), (4, 5))]
    assert "FlatMapGroups" not in f._jdf.queryExecution().toString()
    edges = spark.createDataFrame([(g, 1, 2) for g in range(40)] + [(g, 2, 3) for g in range(40)] + [(g, 3, 1) for g in range(0, 40, 2)] + [(g, 3, 4) for g in range(40)], "g int, u long, v long")
    b = flow.bridge_table(edges, ["g"])
    assert Counter(r.g for r in b.collect()) == {g: 1 if g % 2 == 0 else 3 for g in range(40)}
    assert "FlatMapGroups" not in b._jdf.queryExecution().toString()
