import time

import numpy as np
import pytest

from tessella.operators import assign


@pytest.mark.parametrize("n, m", [(1, 1), (2, 2), (5, 9), (63, 64), (70, 70), (150, 150), (150, 190), (400, 400)])
@pytest.mark.parametrize("kind", ["normal", "strip", "equal", "lattice"])
def test_points_cost_as_little_as_by_matrix(n, m, kind):
    rng = np.random.default_rng(n)
    a = rng.normal(5, 30, (n, 2)) if kind != "equal" else np.full((n, 2), 7.0)
    c = np.stack([np.arange(m) % 8, np.arange(m) // 8], 1).astype(float) if kind != "normal" else rng.uniform(-50, 50, (m, 2))
    if kind == "lattice":
        a = c[rng.permutation(m)[:n]] + 1e6
        c = c + 1e6
    cost = ((a[:, None] - c) ** 2).sum(-1)
    got, want = assign.solve_points(a, c), assign.solve(cost)
    rows = np.arange(n)
    assert len(set(got)) == n and abs(cost[rows, got].sum() - cost[rows, want].sum()) <= 1e-7 * (1 + cost[rows, want].sum())


def test_two_thousand_sites_take_seconds():
    rng = np.random.default_rng(1)
    c = np.stack([np.arange(2000) % 8, np.arange(2000) // 8], 1).astype(float)
    a = rng.normal(0, 50, (2000, 2)) + c.mean(0)
    t = time.process_time()
    assert len(set(assign.solve_points(a, c))) == 2000
    assert time.process_time() - t < 25  # the matrix took 54 s
