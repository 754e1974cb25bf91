import re

import numpy as np

from tessella.operators import spatial


def test_pairs_of_a_site_are_not_sent_once_more(spark, monkeypatch):
    p = np.random.default_rng(2).normal(0, 10, (300, 2))
    df = spark.createDataFrame([("m" + str(i % 2), i, float(x), float(y)) for i, (x, y) in enumerate(p)], "map_id string, site_id int, x double, y double")
    plans, durable = [], spatial.durable
    monkeypatch.setattr(spatial, "durable", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or durable(d))
    got = {(r.site_id, r["rank"]): r.nbr for r in spatial.nearest_sites(df, 4, ["map_id"]).collect()}
    first = next(t for t in plans if "Window" in t)
    assert not re.search(r"hashpartitioning\([^)]*site_id", first)
    for i in range(300):
        d = ((p - p[i]) ** 2).sum(1)
        near = sorted((d[j], j) for j in range(i % 2, 300, 2) if j != i)[:4]
        assert [got[i, k + 1] for k in range(4)] == [j for _, j in near]
