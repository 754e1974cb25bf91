"""Minimum-cost flow by successive shortest paths, and bridges, for the small graphs inside kernels; tables of many such graphs, a graph to a group."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame

from .groups import each_group


class Flow:
    """A digraph with capacities, costs (negative ones allowed without negative cycles) and supplies."""

    def __init__(self, n: int):
        self.n = n
        self.supply = [0] * n
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[float] = []

    def add(self, a: int, b: int, capacity: int, cost: float) -> int:
        """An arc and its reverse; returns the arc's number."""
        k = len(self.to)
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)
            self.cost.append(w)
        return k

    def flow(self, arc: int) -> int:
        return self.left[arc ^ 1]

    def solve(self) -> tuple[int, float]:
        """Send as much supply (above zero) to demand (below zero) as possible at least cost: amount and cost."""
        price = self._prices()
        want = list(self.supply)
        sent, total = 0, 0.0
        while True:
            dist = [float("inf")] * self.n
            back = [-1] * self.n
            todo = [(0.0, v) for v in range(self.n) if want[v] > 0]
            for _, v in todo:
                dist[v] = 0.0
            heapq.heapify(todo)
            while todo:
                d, v = heapq.heappop(todo)
                if d > dist[v] + 1e-12:
                    continue
                for k in self.out[v]:
                    if self.left[k] > 0:
                        nd = d + max(0.0, self.cost[k] + price[v] - price[self.to[k]])
                        if nd < dist[self.to[k]] - 1e-12:
                            dist[self.to[k]], back[self.to[k]] = nd, k
                            heapq.heappush(todo, (nd, self.to[k]))
            goals = [v for v in range(self.n) if want[v] < 0 and dist[v] < float("inf")]
            if not goals:
                return sent, total
            goal = min(goals, key=lambda v: (dist[v] + price[v], v))
            reach = max(d for d in dist if d < float("inf"))
            price = [p + min(d, reach) for p, d in zip(price, dist, strict=True)]
            path, v = [], goal
            while back[v] >= 0:
                path.append(back[v])
                v = self.to[back[v] ^ 1]
            amount = min([want[v], -want[goal], *(self.left[k] for k in path)])
            for k in path:
                self.left[k] -= amount
                self.left[k ^ 1] += amount
                total += amount * self.cost[k]
            want[v] -= amount
            want[goal] += amount
            sent += amount

    def _prices(self) -> list[float]:
        """Prices that make all reduced costs of arcs with capacity at least zero (Bellman-Ford)."""
        price = [0.0] * self.n
        for _ in range(self.n):
            changed = False
            for v in range(self.n):
                for k in self.out[v]:
                    if self.left[k] > 0 and price[v] + self.cost[k] < price[self.to[k]] - 1e-12:
                        price[self.to[k]] = price[v] + self.cost[k]
                        changed = True
            if not changed:
                break
        return price


def bridges(n: int, edges: list[tuple[int, int]]) -> list[tuple[int, int, set[int]]]:
    """Edges whose removal parts a connected graph: (a, b, the smaller side), b's end being on that side."""
    near: list[list[int]] = [[] for _ in range(n)]
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    order, low, out = [-1] * n, [0] * n, []
    count = 0
    for root in range(n):
        if order[root] >= 0:
            continue
        stack: list[tuple[int, int, int]] = [(root, -1, 0)]
        while stack:
            v, parent, i = stack.pop()
            if i == 0:
                order[v] = low[v] = count
                count += 1
            if i < len(near[v]):
                stack.append((v, parent, i + 1))
                w = near[v][i]
                if order[w] < 0:
                    stack.append((w, v, 0))
                elif w != parent:
                    low[v] = min(low[v], order[w])
            elif parent >= 0:
                low[parent] = min(low[parent], low[v])
                if low[v] > order[parent]:
                    out.append((parent, v))
    found = []
    for a, b in out:
        side, todo = {b}, [b]
        while todo:
            v = todo.pop()
            for w in near[v]:
                if w not in side and not (v == b and w == a):
                    side.add(w)
                    todo.append(w)
        if 2 * len(side) > n:
            comp, todo = {a}, [a]
            while todo:
                v = todo.pop()
                for w in near[v]:
                    if w not in comp and not (v == a and w == b):
                        comp.add(w)
                        todo.append(w)
            found.append((b, a, comp))
        else:
            found.append((a, b, side))
    return found


def bridge_table(edges: DataFrame, key: list[str]) -> DataFrame:
    """``key``, a, b and side of the bridges of connected graphs with edges u, v (long): ``side`` is the number of vertices on the smaller side, b's."""

    def run(u: list[int], v: list[int]) -> list[tuple]:
        ends = {(a, b) if a < b else (b, a) for a, b in zip(u, v, strict=True) if a != b}
        names = sorted({a for e in ends for a in e})
        number = {a: k for k, a in enumerate(names)}
        found = bridges(len(names), sorted((number[a], number[b]) for a, b in ends)) if ends else []
        return [(names[a], names[b], len(side)) for a, b, side in found]

    return each_group(edges, key, ["u", "v"], run, "a long, b long, side long")


def cheapest_flow(arcs: DataFrame, supplies: DataFrame, key: list[str]) -> DataFrame:
    """``key``, a, b and flow of each arc (a, b, capacity, cost) of many graphs at the least cost; ``supplies`` has v and supply, negative where flow ends."""
    both = arcs.select(*key, "a", "b", "capacity", "cost").unionByName(supplies.selectExpr(*(f"`{c}`" for c in key), "v AS a", "CAST(NULL AS LONG) AS b", "supply AS capacity", "0D AS cost"))

    def run(*columns: list) -> list[tuple]:
        rows = list(zip(*columns, strict=True))
        names = sorted({v for a, b, _, _ in rows for v in (a, b) if v is not None})
        number = {v: k for k, v in enumerate(names)}
        f, own = Flow(len(names)), []
        for a, b, capacity, cost in rows:
            if b is None:
                f.supply[number[a]] += capacity
            else:
                own.append((a, b, f.add(number[a], number[b], capacity, cost)))
        f.solve()
        return [(a, b, f.flow(k)) for a, b, k in own]

    return each_group(both, key, ["a", "b", "capacity", "cost"], run, "a long, b long, flow long")
