"""Small maps of our own, as lines of the text format."""

from __future__ import annotations

import random

Ring = list[tuple[float, float]]


def square(x: float, y: float, w: float, h: float | None = None) -> Ring:
    h = w if h is None else h
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def lattice(x: float, y: float, nx: int, ny: int, step: float = 1.0) -> Ring:
    return [(x + (i + 0.5) * step, y + (j + 0.5) * step) for j in range(ny) for i in range(nx)]


DUMBBELL: Ring = [(0, 0), (10, 0), (10, 4), (14, 4), (14, 0), (24, 0), (24, 10), (14, 10), (14, 6), (10, 6), (10, 10), (0, 10)]


def lobes(n: int = 12, seed: int = 1) -> Ring:
    r = random.Random(seed)
    return [(r.uniform(0.5, 9.5) + dx, r.uniform(0.5, 9.5)) for dx in (0, 14) for _ in range(n)]


MAPS: dict[str, list[tuple[str, Ring, Ring]]] = {
    "square1": [("a", square(0, 0, 1), [(0.5, 0.5)])],
    "square9": [("a", square(0, 0, 3), lattice(0, 0, 3, 3))],
    "lshape": [("l", [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)], lattice(0, 0, 4, 2) + lattice(0, 2, 2, 2))],
    "dumbbell": [("d", DUMBBELL, lobes())],
    "pair": [("p", square(0, 0, 3), lattice(0, 0, 3, 3)), ("q", square(3, 0, 3), lattice(3, 0, 3, 3))],
    "corner": [("p", square(0, 0, 2), lattice(0, 0, 2, 2)), ("q", square(2, 2, 2), lattice(2, 2, 2, 2))],
    "archipelago": [("main", square(0, 0, 5, 4), lattice(0, 0, 5, 4)), ("i1", square(7, 1, 1), [(7.5, 1.5)]), ("i2", square(2, 6, 1), [(2.5, 6.5)]), ("i3", square(-3, 2, 1), [(-2.5, 2.5)])],
}


def text(name: str, colors: bool = True) -> list[str]:
    """A map's lines at stage 1."""
    outlines = MAPS[name]
    out = ["STAGE 1", f"OUTLINES {len(outlines)}"]
    for i, (label, ring, sites) in enumerate(outlines):
        out += [f"OUT {i}\t{label}\t<NULL>\t{'10 20 30' if colors else '<NULL>'}", "\t".join(f"{float(x)} {float(y)}" for x, y in ring), f"SITECOUNT {len(sites)}"]
        out += [f"SITE {i} {j}\t{label}-{j}\t{float(x)} {float(y)}\t0 0 0\tsites" for j, (x, y) in enumerate(sites)]
    return out


def tile_map(spark, *names: str):
    from tessella.sources import wkt

    rows = [(n, k, line) for n in names for k, line in enumerate(text(n))]
    return wkt.parse(spark.createDataFrame(rows, "map_id string, ln int, line string"))
