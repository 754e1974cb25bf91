"""Cell regions for partitions: connected, of the right size, adjoining as on the map."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import durable
from ..functions.grids import Grid, grid, ring_area, ring_centroid
from ..schema import DEFORMED, PARTITION_KEY, PARTITIONED, TileMap
from . import dual
from .flow import Flow, bridges
from .guide import Cell, best_shape, guides, holes, parts_of, quality_map, runs, safe
from .planar import on_cells, rotation_of

SEA = -1


@dataclass(frozen=True)
class Config:
    """Limits of the heuristic. ``avoid`` is the contact that partitions apart must not have.

    ``start`` is what regions begin as: ``rings``, the outlines at one scale, or ``dual``, bars and columns
    that are in contact exactly where partitions adjoin (see ``planar.on_cells``).

    ``coarsest`` is how many cells a region has on average, at most, on the coarsest grid that is tried; each
    finer one has four times as many (see ``Mosaic.arranged``). None arranges on the final grid alone. ``push`` is what drives guides apart:
    their ``discs``, or the ``cells`` that two of them share. ``seed`` deals the shakes of regions that are stuck.
    """

    attraction: float = 150.0
    repulsion: float = 35.0
    stranger_repulsion: float = 40.0
    rounds: int = 12
    no_improvement: int = 3
    polish_rounds: int = 40
    samples: int = 5
    avoid: str = "rook"
    exact: bool = True
    start: str = "rings"
    coarsest: float | None = None
    push: str = "discs"
    seed: int = 1


GRID_MAP = Config()
CARTOGRAM = Config(attraction=100.0, repulsion=5.0, stranger_repulsion=2.0, avoid="queen", exact=False, coarsest=6.0)


class Mosaic:
    """Owners of cells while a component is arranged; region numbers are positions in the lists."""

    def __init__(self, rings: list[np.ndarray], tiles: list[int], edges: set[tuple[int, int]], g: Grid, config: Config):
        self.rings, self.tiles, self.g, self.config = rings, tiles, g, config
        self.friends = [{b if a == r else a for a, b in edges if r in (a, b)} for r in range(len(rings))]
        self.edges = edges
        self.owner: dict[Cell, int] = {}
        self.cells: list[set[Cell]] = [set() for _ in rings]
        made = [best_shape(ring, n, g, config.samples) for ring, n in zip(rings, tiles, strict=True)]
        self.shape = [m[0] for m in made]
        self.quality = [m[1] for m in made]
        self.box = [(min(x for x, _ in s), max(x for x, _ in s), min(y for _, y in s), max(y for _, y in s)) for s in self.shape]
        self.factor = [m[2] for m in made]
        self.move = [m[3] for m in made]
        self.step: list[Cell] = [(0, 0)] * len(rings)  # lattice offset of each guide
        self.hits = [0] * len(rings)  # cells of each region that it wants
        self.sides: Counter[tuple[int, int]] = Counter()  # common sides of two regions, either way round
        self.rng = np.random.default_rng(config.seed)

    # state

    def put(self, c: Cell, r: int) -> None:
        """Give a cell to a region, or to the sea; hits and common sides follow."""
        old = self.owner.pop(c, SEA)
        near = [o for n in self.g.adjacent(*c) if (o := self.owner.get(n, SEA)) != SEA]
        for k, by in ((old, -1), (r, 1)):
            if k == SEA:
                continue
            self.hits[k] += by * self.wanted(c, k)
            for o in near:
                if o != k:
                    self.sides[k, o] += by
                    self.sides[o, k] += by
        if old != SEA:
            self.cells[old].discard(c)
        if r != SEA:
            self.owner[c] = r
            self.cells[r].add(c)

    def aim(self, r: int, step: Cell) -> None:
        """Move a region's guide to a lattice offset."""
        if step != self.step[r]:
            self.step[r] = step
            self.hits[r] = sum(self.wanted(c, r) for c in self.cells[r])

    def reset(self, owner: dict[Cell, int], step: list[Cell]) -> None:
        for c in list(self.owner):
            self.put(c, SEA)
        for r, at in enumerate(step):
            self.aim(r, at)
        for c, r in owner.items():
            self.put(c, r)

    def off(self, r: int) -> int:
        """Cells by which a region and its guide differ."""
        return len(self.cells[r]) + self.tiles[r] - 2 * self.hits[r]

    def wanted(self, c: Cell, r: int) -> bool:
        dx, dy = self.step[r]
        return (c[0] - dx, c[1] - dy) in self.shape[r]

    def worth(self, c: Cell, r: int) -> float:
        """Overlap of a cell with the moved polygon; outside, less the farther from the guide's middle."""
        dx, dy = self.step[r]
        q = self.quality[r].get((c[0] - dx, c[1] - dy))
        if q is not None:
            return q / self.g.average_area + 1
        mid = self.middle_of_guide(r)
        return -float(np.hypot(*(self.g.centroid(*c) - mid))) / math.sqrt(self.g.average_area)

    def middle_of_guide(self, r: int) -> np.ndarray:
        base = np.mean([self.g.centroid(*c) for c in self.shape[r]], 0)
        return base + self.g.offset(*self.step[r])

    def middle(self, r: int) -> np.ndarray:
        return np.mean([self.g.centroid(*c) for c in self.cells[r]], 0)

    def error(self) -> tuple[int, float]:
        """Symmetric difference of regions and guides, in all and in proportion."""
        d = [self.off(r) for r in range(len(self.rings))]
        return sum(d), sum(x / n for x, n in zip(d, self.tiles, strict=True))

    # legality

    def owners_near(self, c: Cell, kind: str) -> set[int]:
        return {self.owner.get(n, SEA) for n in self.g.adjacent(*c, kind)}

    def may_leave(self, c: Cell, strict: bool) -> bool:
        """Whether c's owner stays in one piece and keeps its contacts without c."""
        r = self.owner[c]
        rest = self.cells[r]
        if len(rest) == 1 or not safe(c, rest, self.g):
            return False
        if strict:
            here = Counter(self.owner.get(n, SEA) for n in self.g.adjacent(*c))
            if any(self.sides[r, f] == here[f] for f in here.keys() & self.friends[r]):
                return False
        return True

    def may_join(self, c: Cell, r: int, strict: bool) -> bool:
        """Whether region r may hold c: it touches c once around, closes no hole and meets no stranger."""
        if runs(c, self.cells[r], self.g) != 1 or not any(self.owner.get(n) == r for n in self.g.adjacent(*c)):
            return False
        old = self.owner.get(c, SEA)
        if old == SEA and any(self.owner.get(n, SEA) == SEA for n in self.g.adjacent(*c)):
            outside = {n for n in self.g.adjacent(*c, "queen") if n not in self.owner}
            if runs(c, outside, self.g, rook=False) > 1:
                return False
        if strict:
            near = self.owners_near(c, self.config.avoid) - {SEA, r, old}
            if not near <= self.friends[r]:
                return False
        return True

    def legal(self, c: Cell, to: int, strict: bool) -> bool:
        have = self.owner.get(c, SEA)
        if have == to:
            return False
        if have != SEA and not self.may_leave(c, strict):
            return False
        if to == SEA:
            return SEA in self.owners_near(c, "rook")
        return self.may_join(c, to, strict)

    # steps

    def embed(self) -> None:
        """All rings at one scale; each cell to the region that covers most of it, as many cells as tiles in all; every region in one piece."""
        area = sum(abs(ring_area(r)) for r in self.rings)
        factor = math.sqrt(sum(self.tiles) * self.g.average_area / area)
        over: dict[Cell, list[tuple[float, int]]] = {}
        for r, ring in enumerate(self.rings):
            for c, a in quality_map(ring * factor, self.g).items():
                over.setdefault(c, []).append((a, -r))
        ranked = sorted(over, key=lambda c: (-sum(a for a, _ in over[c]), c))[: sum(self.tiles)]
        for c in ranked:
            self.put(c, -max(over[c])[1])
        for r, ring in enumerate(self.rings):
            if not self.cells[r]:
                mid = ring_centroid(ring * factor)
                for c in sorted((c for c in over if any(k == -r for _, k in over[c])) or [self.g.containing(*mid) or (0, 0)], key=lambda c: (float(np.hypot(*(self.g.centroid(*c) - mid))), c)):
                    if len(self.cells[self.owner.get(c, SEA)]) > 1 or c not in self.owner:
                        self.put(c, r)
                        break
                else:
                    free = {n for s in self.cells for d in s for n in self.g.adjacent(*d)} - self.owner.keys()
                    self.put(min(free, key=lambda c: (float(np.hypot(*(self.g.centroid(*c) - mid))), c)), r)
        self.mend()

    def mend(self) -> None:
        """Every region keeps its largest part; the whole is brought together and its holes are filled."""
        for r in range(len(self.rings)):
            parts = parts_of(self.cells[r], self.g)
            keep = max(parts, key=len)
            for part in parts:
                if part is not keep:
                    for c in part:
                        self.put(c, SEA)
        self.join_parts()
        self.fill_holes()

    def carry(self, coarse: Mosaic) -> None:
        """Regions of the grid twice as coarse: each cell becomes four, or where the tiling has no such rule, a cell goes to the owner of the cell at half its place."""
        if self.g.refined(0, 0):
            for c, r in coarse.owner.items():
                for fine in self.g.refined(*c):
                    self.put(fine, r)
            return
        ready = [self.g.containing(*(2 * self.g.centroid(*c))) for c in sorted(coarse.owner)]
        seen = {c for c in ready if c}
        todo = sorted(seen)
        while todo:
            c = todo.pop()
            half = self.g.containing(*(self.g.centroid(*c) / 2))
            r = coarse.owner.get(half, SEA) if half else SEA
            if r == SEA:
                continue
            self.put(c, r)
            fresh = set(self.g.adjacent(*c, "queen")) | set(self.g.adjacent(*c))
            todo += sorted(fresh - seen)
            seen |= fresh
        for r in range(len(self.rings)):
            if not self.cells[r]:
                mid = 2 * coarse.middle(r)
                free = {n for d in self.owner for n in (d, *self.g.adjacent(*d)) if n not in self.owner or len(self.cells[self.owner[n]]) > 1}
                self.put(min(free, key=lambda c: (float(np.hypot(*(self.g.centroid(*c) - mid))), c)), r)
        self.mend()

    def embed_dual(self) -> None:
        """The dual on cells: all contacts right from the start. Enclosed cells go to regions around them while that adds no contact."""
        for c, r in on_cells(*rotation_of(self.rings)).items():
            self.put(c, r)
        todo = holes(set(self.owner), self.g)
        ready = sorted(todo)
        while ready:
            again = set()
            for c in ready:
                near = [self.owner[n] for n in self.g.adjacent(*c) if n in self.owner]
                all_near = {o for kind in ("rook", "queen") for o in self.owners_near(c, kind)} - {SEA}
                fits = [r for r in sorted(set(near)) if all_near - {r} <= self.friends[r]]
                if fits and c not in self.owner:
                    self.put(c, max(fits, key=near.count))
                    again |= {n for n in self.g.adjacent(*c) if n in todo and n not in self.owner}
            ready = sorted(again)

    def contacts(self) -> set[tuple[int, int]]:
        return {(min(r, o), max(r, o)) for c, r in self.owner.items() for o in self.owners_near(c, "rook") - {SEA, r}}

    def join_parts(self) -> None:
        """Regions whose friends moved off: the whole is brought together by a bridge from its largest part to the part nearest to it."""
        while len(parts := parts_of(set(self.owner), self.g)) > 1:
            home = sorted(max(parts, key=lambda p: (len(p), min(p))))
            rest = sorted(set(self.owner).difference(home))
            at = np.array([self.g.centroid(*c) for c in home])
            near = []
            for c in rest:  # a row of distances at a time
                far = np.round(np.hypot(*(at - self.g.centroid(*c)).T), 9)
                near.append((float(far.min()), c, home[int(far.argmin())]))
            _, a, b = min(near)
            path = self.line(b, a)
            for c in path:
                if c not in self.owner:
                    self.put(c, self.owner[a])

    def line(self, a: Cell, b: Cell) -> list[Cell]:
        """Cells from a to b, each step to the neighbour nearest to b."""
        out, goal = [a], self.g.centroid(*b)
        while out[-1] != b:
            nxt = min(self.g.adjacent(*out[-1]), key=lambda c: (float(np.hypot(*(self.g.centroid(*c) - goal))), c))
            if np.hypot(*(self.g.centroid(*nxt) - goal)) >= np.hypot(*(self.g.centroid(*out[-1]) - goal)):
                raise ValueError(f"no neighbour of {out[-1]} is nearer to {b}")
            out.append(nxt)
        return out

    def fill_holes(self) -> None:
        """Enclosed cells and alleys go to the region with most rook contacts."""
        if not self.owner:
            return
        todo = holes(set(self.owner), self.g)
        while todo:
            ready = [c for c in todo if self.owners_near(c, "rook") - {SEA}]
            if not ready:
                return
            for c in sorted(ready):
                near = [self.owner[n] for n in self.g.adjacent(*c) if n in self.owner]
                if near:
                    self.put(c, max(sorted(set(near)), key=near.count))
                todo.discard(c)

    def fill_alleys(self) -> None:
        for c in sorted({n for d in self.owner for n in self.g.adjacent(*d)} - self.owner.keys()):
            near = [self.owner.get(n, SEA) for n in self.g.adjacent(*c)]
            taken = [r for r in near if r != SEA]
            if len(taken) == len(near) - 1 and len(set(taken)) > 1:
                for r in sorted(set(taken), key=lambda r: (-taken.count(r), r)):
                    if self.legal(c, r, True):
                        self.put(c, r)
                        break

    def recentre(self) -> None:
        """Guides onto their regions by the nearest lattice offset."""
        for r in range(len(self.rings)):
            d = self.middle(r) - np.mean([self.g.centroid(*c) for c in self.shape[r]], 0)
            self.aim(r, self.g.closest_lattice(d))

    def shared(self, a: int, b: int, step: list[Cell]) -> int:
        """Cells that two moved guides have in common; guides whose boxes are apart aren't looked at."""
        (ax, ay), (bx, by) = step[a], step[b]
        p, q = self.box[a], self.box[b]
        if p[0] + ax > q[1] + bx or q[0] + bx > p[1] + ax or p[2] + ay > q[3] + by or q[2] + by > p[3] + ay:
            return 0
        if len(self.shape[a]) > len(self.shape[b]):
            return self.shared(b, a, step)
        dx, dy = ax - bx, ay - by
        return sum((x + dx, y + dy) in self.shape[b] for x, y in self.shape[a])

    def forces(self, steps: int = 8) -> None:
        """Guides drawn to their friends and pushed off overlaps, moved in lattice steps while they still meet their region."""
        side = self.g.nonneighbour_distance()
        dt = 2 * side / (50 * self.config.attraction)
        at = [self.middle_of_guide(r) for r in range(len(self.rings))]
        start = list(at)
        base = list(self.step)
        size = [math.sqrt(n * self.g.average_area / math.pi) for n in self.tiles]
        for _ in range(steps):
            pull = [np.zeros(2) for _ in at]
            now = [(base[r][0] + dx, base[r][1] + dy) for r in range(len(at)) for dx, dy in [self.g.closest_lattice(at[r] - start[r])]]
            for a in range(len(at)):
                for b in range(a + 1, len(at)):
                    d = at[b] - at[a]
                    far = float(np.hypot(*d)) or 1e-9
                    u = d / far
                    gap = (far - size[a] - size[b]) / side
                    friends = b in self.friends[a]
                    f = 0.0
                    if friends:
                        f += self.config.attraction * max(1.0, gap) if gap > 0 else 0.0
                    if self.config.push == "discs":
                        deep = max(0.0, -gap)
                    else:  # as deep as the shared cells are, in a strip as wide as the smaller guide
                        deep = self.shared(a, b, now) / math.sqrt(min(self.tiles[a], self.tiles[b]))
                    f -= (self.config.repulsion if friends else self.config.stranger_repulsion) * deep * 2
                    pull[a] += f * u
                    pull[b] -= f * u
            for r, p in enumerate(pull):
                long = float(np.hypot(*p))
                if long > side / dt:
                    p = p * (side / dt / long)
                at[r] = at[r] + p * dt
        for r in range(len(at)):
            dx, dy = self.g.closest_lattice(at[r] - start[r])
            self.aim(r, (base[r][0] + dx, base[r][1] + dy))
            if not self.hits[r]:
                self.aim(r, base[r])

    def shake(self) -> None:
        """Guides of regions that differ from them move by a step dealt by chance, where they still meet their region."""
        for r in range(len(self.rings)):
            if self.off(r):
                was = self.step[r]
                dx, dy = self.g.unit_vectors[int(self.rng.integers(len(self.g.unit_vectors)))]
                self.aim(r, (was[0] + dx, was[1] + dy))
                if not self.hits[r]:
                    self.aim(r, was)

    def fairer(self, r: int, o: int) -> bool:
        """Whether the larger of two regions' relative errors falls when o gives r a cell that both want."""
        before = max(self.off(r) / self.tiles[r], self.off(o) / self.tiles[o])
        return max((self.off(r) - 1) / self.tiles[r], (self.off(o) + 1) / self.tiles[o]) < before - 1e-12

    def best_move(self, r: int) -> tuple[Cell, int] | None:
        """The best cell that a region may take, else the worst that it may release."""
        fringe = {n for c in self.cells[r] for n in self.g.adjacent(*c) if n not in self.cells[r] and self.wanted(n, r)}
        for c in sorted(fringe, key=lambda c: (-self.worth(c, r), c)):
            o = self.owner.get(c, SEA)
            if (o == SEA or not self.wanted(c, o) or self.fairer(r, o)) and self.legal(c, r, True):
                return c, r
        for c in sorted((c for c in self.cells[r] if not self.wanted(c, r)), key=lambda c: (self.worth(c, r), c)):
            if self.legal(c, SEA, True):
                return c, SEA
        return None

    def reshape(self) -> bool:
        """Takes and releases, the region with the largest relative error first, until none has a move.

        Each move lowers the errors' sequence from the largest down, so it ends. Regions around a
        moved cell are tried anew.
        """
        moved = False
        while self._turns():
            moved = True
        return moved

    def _turns(self) -> bool:
        """Every region's moves in turn; whether there were any."""
        moved = False
        todo = [(-self.off(r) / self.tiles[r], r) for r in range(len(self.rings))]
        heapq.heapify(todo)
        waiting = {r for _, r in todo}
        while todo:
            _, r = heapq.heappop(todo)
            if r not in waiting:
                continue
            waiting.discard(r)
            if (move := self.best_move(r)) is None:
                continue
            c, to = move
            around = {self.owner.get(c, SEA), r} | self.owners_near(c, "queen") | self.owners_near(c, "rook")
            self.put(c, to)
            moved = True
            for o in around - {SEA}:
                waiting.add(o)
                heapq.heappush(todo, (-self.off(o) / self.tiles[o], o))
        return moved

    def slide(self) -> None:
        """Shift the lesser side of a bridge while its direction gets nearer to the map's and contacts stay right."""
        centre = [ring_centroid(r) for r in self.rings]
        for a, b, side in bridges(len(self.rings), sorted(self.edges)):
            aim = math.atan2(*(centre[b] - centre[a])[::-1])

            def off(a: int = a, b: int = b, aim: float = aim) -> float:
                d = abs(math.atan2(*(self.middle(b) - self.middle(a))[::-1]) - aim) % (2 * math.pi)
                return min(d, 2 * math.pi - d)

            while True:  # each step turns the side nearer to its aim, so it ends
                best = None
                now = off()
                for dx, dy in self.g.unit_vectors:
                    before = {r: set(self.cells[r]) for r in side}
                    moved = {(x + dx, y + dy): r for r in side for x, y in before[r]}
                    if any(self.owner.get(c, r) not in side for c, r in moved.items()):
                        continue
                    touch = {(r, self.owner[n]) for c, r in moved.items() for n in self.g.adjacent(*c, self.config.avoid) if n in self.owner and self.owner[n] not in side}
                    if (b, a) not in touch or any(o not in self.friends[r] for r, o in touch) or not any(self.owner.get(n) == a for c, r in moved.items() if r == b for n in self.g.adjacent(*c)):
                        continue
                    self._shift(before, moved)
                    if (turned := off()) < now - 1e-9 and (best is None or turned < best[0]):
                        best = (turned, dx, dy)
                    self._shift({r: {c for c, k in moved.items() if k == r} for r in side}, {c: r for r, s in before.items() for c in s})
                if best is None:
                    break
                before = {r: set(self.cells[r]) for r in side}
                self._shift(before, {(x + best[1], y + best[2]): r for r in side for x, y in before[r]})

    def _shift(self, before: dict[int, set[Cell]], after: dict[Cell, int]) -> None:
        for s in before.values():
            for c in list(s):
                self.put(c, SEA)
        for c, r in after.items():
            self.put(c, r)

    def moves(self, a: int, b: int, strict: bool) -> list[tuple[float, Cell]]:
        """Cells that may go from a to b, the best first."""
        if a == SEA:
            pool = {n for c in self.cells[b] for n in self.g.adjacent(*c) if n not in self.owner}
        elif b == SEA:
            pool = {c for c in self.cells[a] if any(n not in self.owner for n in self.g.adjacent(*c))}
        else:
            pool = {c for d in self.cells[b] for c in self.g.adjacent(*d) if self.owner.get(c) == a}

        def gain(c: Cell) -> float:
            return (self.worth(c, b) if b != SEA else 0.0) - (self.worth(c, a) if a != SEA else 0.0)

        return sorted(((gain(c), c) for c in pool if self.legal(c, b, strict)), key=lambda m: (-m[0], m[1]))

    def polish(self, strict: bool, rounds: int) -> bool:
        """Send cells from regions that have too many to those with too few, over region borders, at most gain."""
        n = len(self.rings)
        for _ in range(rounds):
            short = [t - len(c) for t, c in zip(self.tiles, self.cells, strict=True)]
            if not any(short):
                return True
            flow = Flow(n + 1)  # the last vertex is the sea
            arcs = {}
            for a in [*range(n), SEA]:
                near = range(n) if a == SEA else sorted({self.owner.get(m, SEA) for c in self.cells[a] for m in self.g.adjacent(*c)} - {a})
                for b in near:
                    if options := self.moves(a, b, strict):
                        arcs[flow.add(a % (n + 1), b % (n + 1), len(options), 50 - min(40.0, options[0][0]))] = (a, b)
            for r, s in enumerate(short):
                flow.supply[r] = -s
            flow.supply[n] = sum(short)
            flow.solve()
            moved = 0
            for arc, (a, b) in arcs.items():
                for _ in range(flow.flow(arc)):
                    if options := self.moves(a, b, strict):
                        self.put(options[0][1], b)
                        moved += 1
            if not moved:
                return False
        return all(t == len(c) for t, c in zip(self.tiles, self.cells, strict=True))

    def begin(self) -> None:
        if self.config.start == "dual":
            self.embed_dual()
        else:
            self.embed()

    def improve(self) -> None:
        """Rounds of guides and moves, until none gets better; the best state stays."""
        self.slide()
        best, idle = None, 0
        for _ in range(self.config.rounds):
            self.recentre()
            self.forces()
            if not self.reshape() and best is not None:
                self.shake()
                self.reshape()
            self.polish(True, 6)
            score = self.error()
            if best is None or score < best[0]:
                best, idle = (score, dict(self.owner), list(self.step)), 0
            else:
                idle += 1
            if not score[0] or idle >= self.config.no_improvement:
                break
        self.reset(*best[1:])

    def finish(self) -> Mosaic:
        """Sizes as they must be, holes and alleys filled."""
        self.fill_holes()
        self.fill_alleys()
        done = self.polish(True, self.config.polish_rounds)
        if not done and self.config.exact:
            # exact sizes before adjacencies
            done = self.polish(False, 4 * self.config.polish_rounds)
            if not done:
                self.force_exact()
        self.recentre()
        return self

    def faults(self) -> tuple[int, int, int]:
        """Wrong sizes, contacts missing or wrong, and cells by which regions and guides differ."""
        return sum(t != len(c) for t, c in zip(self.tiles, self.cells, strict=True)), len(self.contacts() ^ self.edges), self.error()[0]

    @staticmethod
    def arranged(rings: list[np.ndarray], tiles: list[int], edges: set[tuple[int, int]], g: Grid, config: Config) -> Mosaic:
        """On the final grid; with ``coarsest`` also from the coarsest grid on, each beginning with the last one's regions, and what has fewer faults."""
        m = Mosaic(rings, tiles, edges, g, config)
        m.begin()
        m.improve()
        m.finish()
        last = 0
        while config.coarsest and sum(tiles) > config.coarsest * len(tiles) * 4**last:
            last += 1
        coarse = None
        for k in range(last, -1, -1) if last else ():
            now = Mosaic(rings, [max(1, (2 * t + 4**k) // (2 * 4**k)) for t in tiles], edges, g, config)
            if coarse is None:
                now.begin()
            else:
                now.carry(coarse)
            now.improve()
            coarse = now
        return min(m, coarse.finish(), key=Mosaic.faults) if coarse else m

    def force_exact(self) -> None:
        """Last resort: surplus cells are released and missing ones taken from the sea, one piece kept."""
        for r in range(len(self.rings)):
            while len(self.cells[r]) > self.tiles[r]:
                out = [c for c in self.cells[r] if len(parts_of(self.cells[r] - {c}, self.g)) == 1]
                self.put(min(out, key=lambda c: (self.worth(c, r), c)), SEA)
            while len(self.cells[r]) < self.tiles[r]:
                free = {n for c in self.cells[r] for n in self.g.adjacent(*c) if n not in self.owner}
                if not free:
                    raise ValueError("a region is walled in; its size can't be met")
                self.put(max(free, key=lambda c: (self.worth(c, r), c)), r)


SCHEMA = "map_id string, outline_id int, partition_id int, factor double, tx double, ty double, quality double, cells array<struct<x:int,y:int>>, guide array<struct<x:int,y:int>>, areas array<struct<x:int,y:int,area:double>>"


def _kernel(name: str, config: Config):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = grid(name)
        pdf = pdf.sort_values(["outline_id", "partition_id"]).reset_index(drop=True)
        number = {(r.outline_id, r.partition_id): i for i, r in pdf.iterrows()}
        edges = set()
        for i, r in pdf.iterrows():
            for q in r.near if r.near is not None else []:
                j = number.get((q["outline_id"], q["partition_id"]))
                if j is not None and j != i:
                    edges.add((min(i, j), max(i, j)))
        rings = [np.array([[p["x"], p["y"]] for p in ring]) for ring in pdf.ring]
        m = Mosaic.arranged(rings, [int(t) for t in pdf.tiles], edges, g, config)
        rows = []
        for i, r in pdf.iterrows():
            dx, dy = m.step[i]
            move = m.move[i] + g.offset(dx, dy)
            shape = sorted((x + dx, y + dy) for x, y in m.shape[i])
            areas = sorted((x + dx, y + dy, a) for (x, y), a in m.quality[i].items())
            q = sum(m.quality[i].get(c, 0.0) for c in m.shape[i])
            rows.append((r.map_id, r.outline_id, r.partition_id, m.factor[i], float(move[0]), float(move[1]), q, [{"x": x, "y": y} for x, y in sorted(m.cells[i])], [{"x": x, "y": y} for x, y in shape], [{"x": x, "y": y, "area": a} for x, y, a in areas]))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def arrange(m: TileMap, g: Grid, config: Config = GRID_MAP, cell_weight: float = 1.0) -> tuple[TileMap, DataFrame]:
    """The map at stage DEFORMED, and comp_id of every partition.

    A partition gets max(1, round(weight / cell_weight)) tiles. Lone partitions of one tile
    on a one-tile grid take the origin cell and no guide; other lone partitions are their
    guide, with all its offsets tried in parallel; each component of several partitions is
    arranged by one kernel, which holds that component's cells.
    """
    m.require(PARTITIONED)
    m = m.at(PARTITIONED)
    edges = dual.dual_edges(m.partitions)
    comps = durable(dual.components(m.partitions, edges))
    weighted = dual.weights(m.partitions, m.sites).withColumn("tiles", F.greatest(F.lit(1), F.floor(F.col("weight") / cell_weight + 0.5)).cast("int"))
    size = comps.groupBy("map_id", "comp_id").agg(F.count("*").alias("_n"))
    p = m.partitions.join(weighted, PARTITION_KEY).join(comps, PARTITION_KEY).join(size, ["map_id", "comp_id"]).select(*PARTITION_KEY, "comp_id", "ring", "tiles", "_n")
    single = (F.col("_n") == 1) & (F.col("tiles") == 1) & F.lit(g.pc == 1)
    dots = p.where(single)
    lone = guides(p.where((F.col("_n") == 1) & ~single), g, config.samples)
    near = edges.select("map_id", F.col("p1").alias("p"), F.col("p2").alias("q")).unionByName(edges.select("map_id", F.col("p2").alias("p"), F.col("p1").alias("q"))).groupBy("map_id", "p").agg(F.collect_list("q").alias("near"))  # the neighbours of one partition
    many = p.where("_n > 1").withColumn("p", F.struct("outline_id", "partition_id")).join(near, ["map_id", "p"], "left").drop("p")
    solved = many.groupBy("map_id", "comp_id").applyInPandas(_kernel(g.name, config), SCHEMA)
    guided = durable(lone.withColumn("guide", F.col("cells")).select(*[c.split()[0] for c in SCHEMA.split(", ")]).unionByName(solved))

    def exploded(column: str) -> DataFrame:
        e = guided.select(*PARTITION_KEY, F.posexplode(column).alias("ord", "c"))
        return e.select(*PARTITION_KEY, F.col("c.x").alias("x"), F.col("c.y").alias("y"), "ord")

    cells = exploded("cells").unionByName(dots.select(*PARTITION_KEY, F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("ord")))
    quality = guided.select(*PARTITION_KEY, F.explode("areas").alias("c")).select(*PARTITION_KEY, "c.x", "c.y", "c.area")
    out = m.with_(cells=cells, guides=guided.select(*PARTITION_KEY, "factor", "tx", "ty", "quality"), guide_cells=exploded("guide"), cell_quality=quality)
    return out.staged(DEFORMED, g.name), comps


def cartogram_config(exact: bool = False) -> Config:
    return replace(CARTOGRAM, exact=exact)
