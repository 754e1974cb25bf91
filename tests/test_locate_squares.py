import numpy as np
import pandas as pd

from tessella.functions.grids import inside
from tessella.operators import spatial


def test_few_rings_and_points_need_few_squares(spark):
    """Maps of one large ring, of many small ones, and of many points: the first ring that holds each point, and no ring in thousands of squares."""
    rng = np.random.default_rng(2)
    rings = [(m, 0, [(0.0, 0.0), (90.0, 0.0), (90.0, 70.0), (0.0, 70.0)]) for m in range(30)]
    rings += [(30, r, [(r % 5 * 10.0, r // 5 * 10.0), (r % 5 * 10 + 10.0, r // 5 * 10.0), (r % 5 * 10 + 10.0, r // 5 * 10 + 10.0), (r % 5 * 10.0, r // 5 * 10 + 10.0)]) for r in range(25)]
    points = [(m, i, *map(float, rng.uniform(-5, 95, 2))) for m in range(30) for i in range(4)] + [(30, i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-2, 53, (3000, 2)))]
    points += [(31, 0, 1.0, 1.0), (0, 99, None, 1.0)]
    p = spark.createDataFrame(points, "m int, i int, x double, y double")
    r = spark.createDataFrame(pd.DataFrame([(m, k, [{"x": x, "y": y} for x, y in ring]) for m, k, ring in rings], columns=["m", "r", "ring"]), "m int, r int, ring array<struct<x:double,y:double>>")
    out = spatial.locate(p, r, ["m", "i"], "r", ["m"])
    of = {}
    for m, k, ring in rings:
        of.setdefault(m, []).append((k, np.array(ring)))
    want = {(m, i): next((k for k, ring in of.get(m, []) if inside(ring, x, y)), None) if x is not None else None for m, i, x, y in points}
    assert {(q.m, q.i): q.r for q in out.collect()} == want


def test_a_ring_goes_to_one_square_where_it_is_alone(spark):
    p = spark.range(200).selectExpr("id as m", "1.0D as x", "1.0D as y", "id as i")
    r = spark.range(200).selectExpr("id as m", "0 as r", "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 9D, 'y', 0D), named_struct('x', 9D, 'y', 9D), named_struct('x', 0D, 'y', 9D)) as ring")
    out = spatial.locate(p, r, ["m", "i"], "r", ["m"])
    out.write.format("noop").mode("overwrite").save()
    assert out.where("r = 0").count() == 200
    rows = [0]

    def most(plan):
        it = plan.metrics().iterator()
        while it.hasNext():
            e = it.next()
            if e._1() == "numOutputRows":
                rows[0] = max(rows[0], e._2().value())
        for c in (plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan.plan() if plan.getClass().getSimpleName().endswith("QueryStageExec") else None,):
            if c is not None:
                most(c)
        kids = plan.children()
        for k in range(kids.size()):
            most(kids.apply(k))

    frame = out.select("m", "r")
    frame.collect()
    most(frame._jdf.queryExecution().executedPlan())
    assert 200 <= rows[0] < 200 * 64
