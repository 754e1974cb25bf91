"""Arrangement kernels: state against recomputation, levels, overlaps of guides."""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from tessella.functions.grids import grid
from tessella.operators import guide
from tessella.operators.arrange import GRID_MAP, SEA, Mosaic

NAMES = ("SQUARE", "HEXAGON", "TRIANGLE", "NS2")


def halved(seed: int, n: int):
    """A square cut n - 1 times, the largest piece each time: rings, tiles that don't follow the areas, and what adjoins."""
    r = random.Random(seed)
    boxes = [(0.0, 0.0, 40.0, 40.0)]
    while len(boxes) < n:
        boxes.sort(key=lambda b: -b[2] * b[3])
        x, y, w, h = boxes.pop(0)
        f = r.choice((0.4, 0.5, 0.6))
        boxes += [(x, y, w * f, h), (x + w * f, y, w - w * f, h)] if w >= h else [(x, y, w, h * f), (x, y + h * f, w, h - h * f)]
    edges = set()
    for i, (x, y, w, h) in enumerate(boxes):
        for j, (p, q, u, v) in enumerate(boxes[:i]):
            across, along = min(x + w, p + u) - max(x, p), min(y + h, q + v) - max(y, q)
            if min(across, along) > -1e-9 and abs(across * along) < 1e-9 and max(across, along) > 1e-6:
                edges.add((j, i))
    rings = [np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)]) for x, y, w, h in boxes]
    return rings, [r.choice((2, 5, 10, 30, 90)) for _ in boxes], edges


def check(m: Mosaic) -> None:
    sides = Counter((r, m.owner[n]) for c, r in m.owner.items() for n in m.g.adjacent(*c) if m.owner.get(n, r) != r)
    assert sides == +m.sides and min(m.sides.values(), default=0) >= 0
    assert m.hits == [sum(m.wanted(c, r) for c in s) for r, s in enumerate(m.cells)]
    assert m.owner == {c: r for r, s in enumerate(m.cells) for c in s}


@pytest.mark.parametrize("name", NAMES)
def test_ten_thousand_random_moves(name):
    g, rnd = grid(name), random.Random(3)
    rings, _, edges = halved(2, 6)
    m = Mosaic(rings, [14] * 6, edges, g, replace(GRID_MAP, samples=1))
    m.begin()
    kept = edges & m.contacts()
    for k in range(10_000):
        c = rnd.choice(sorted(m.owner)) if k % 50 == 0 else c  # noqa: F821  a walk from there
        c = rnd.choice(m.g.adjacent(*c, "queen") or m.g.adjacent(*c))
        to = rnd.choice([SEA, *range(6)])
        if to != m.owner.get(c, SEA) and m.legal(c, to, True):
            m.put(c, to)
        if k % 7 == 0:
            r = rnd.randrange(6)
            m.aim(r, (m.step[r][0] + rnd.choice((-1, 0, 1)) * g.pc, m.step[r][1] + rnd.choice((-1, 0, 1))))
        if k % 250 == 0:
            check(m)
            assert all(len(guide.parts_of(s, g)) == 1 for s in m.cells)
            assert kept <= m.contacts()
    check(m)


@pytest.mark.parametrize("name", NAMES)
def test_a_pass_lowers_the_largest_errors(name):
    rings, _, edges = halved(5, 6)
    m = Mosaic(rings, [9, 14, 20, 6, 12, 30], edges, grid(name), replace(GRID_MAP, samples=1))
    m.begin()
    m.recentre()
    errors = lambda: sorted((m.off(r) / n for r, n in enumerate(m.tiles)), reverse=True)
    before = errors()
    moved = m.reshape()
    assert errors() < before if moved else errors() == before
    assert all(m.best_move(r) is None for r in range(6))
    check(m)


@pytest.mark.parametrize("name", NAMES)
def test_regions_carried_to_a_finer_grid(name):
    g = grid(name)
    rings, _, edges = halved(7, 6)
    config = replace(GRID_MAP, samples=1)
    coarse = Mosaic(rings, [5] * 6, edges, g, config)
    coarse.begin()
    fine = Mosaic(rings, [20] * 6, edges, g, config)
    fine.carry(coarse)
    check(fine)
    assert all(len(guide.parts_of(s, g)) == 1 for s in fine.cells)
    if g.refined(0, 0):
        assert fine.contacts() == coarse.contacts()
        assert [len(s) for s in fine.cells] == [4 * len(s) for s in coarse.cells]


def test_levels_have_exact_sizes_and_fewer_faults():
    better = 0
    for seed in range(4):
        got = []
        for coarsest in (None, 6.0):
            rings, tiles, edges = halved(seed, 8)
            m = Mosaic.arranged(rings, tiles, edges, grid("HEXAGON"), replace(GRID_MAP, coarsest=coarsest, samples=2))
            assert [len(c) for c in m.cells] == tiles
            assert all(len(guide.parts_of(c, m.g)) == 1 for c in m.cells) and len(guide.parts_of(set(m.owner), m.g)) == 1
            got.append(m.faults())
        assert got[1] <= got[0]
        better += got[1] < got[0]
    assert better


@pytest.mark.parametrize("name", NAMES)
def test_shared_cells_of_guides(name):
    g, rnd = grid(name), random.Random(1)
    rings, tiles, edges = halved(1, 6)
    m = Mosaic(rings, tiles, edges, g, replace(GRID_MAP, samples=1))
    for _ in range(60):
        step = [(rnd.randint(-4, 4) * g.pc, rnd.randint(-8, 8)) for _ in rings]
        at = [{(x + dx, y + dy) for x, y in s} for s, (dx, dy) in zip(m.shape, step, strict=True)]
        assert all(m.shared(a, b, step) == len(at[a] & at[b]) for a in range(6) for b in range(6) if a != b)


def test_forces_by_shared_cells():
    rings, tiles, edges = halved(4, 6)
    m = Mosaic.arranged(rings, tiles, edges, grid("SQUARE"), replace(GRID_MAP, push="cells", samples=1))
    assert [len(c) for c in m.cells] == tiles and all(len(guide.parts_of(c, m.g)) == 1 for c in m.cells)
