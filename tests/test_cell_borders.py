import duckdb
import numpy as np
import pandas as pd
import pytest

from tessella.functions.grids import grid
from tessella.plans.queries import _tiles_sql


@pytest.mark.parametrize("name", ["MIXED", "GEESE", "NS2", "NS3"])
def test_points_beside_borders_go_where_the_sql_puts_them(name):
    """Floats closer to a border than EPS, from every edge of every tile in three patterns."""
    g, rng = grid(name), np.random.default_rng(3)
    p = []
    for x, y in ((0, 0), (4 * g.pc, -7), (-11 * g.pc, 3)):
        for v in range(g.pc):
            ring = g.boundary(x + v, y)
            for a, b in zip(ring, np.roll(ring, -1, 0), strict=True):
                n = np.array([a[1] - b[1], b[0] - a[0]]) / np.hypot(*(b - a))
                p += [a + t * (b - a) + n * d for t in rng.uniform(0.1, 0.9, 4) for d in (-4e-7, -1e-7, 1e-7, 4e-7)]
    p = np.array(p) / 20
    emb = pd.DataFrame({"vec_id": range(len(p)), "label": 0, "x": p[:, 0], "y": p[:, 1]})
    c = duckdb.connect()
    c.execute("create view embeddings as select vec_id, label, [x, y] as embedding from emb")
    want = c.execute(_tiles_sql(name)).df().set_index("site_id").sort_index()
    x, y, found = g.containing_many(p[:, 0] * 20, p[:, 1] * 20)
    assert found.all() and len(want) == len(p)
    assert (want.cx.to_numpy() == x).all() and (want.cy.to_numpy() == y).all()


def test_points_in_no_tile_but_on_a_border_have_a_cell():
    g = grid("MIXED")
    x, y, found = g.containing_many(np.array([np.nan, *g.boundary(0, 0)[:, 0]]), np.array([0.0, *g.boundary(0, 0)[:, 1]]))
    assert not found[0] and found[1:].all()
