"""Planar graphs: half-edges and faces, convex parts, Schnyder woods, and drawings of graphs on the cells of a grid.

Faces of any number of graphs are found by joins. A wood and a drawing on cells come from one kernel per
graph, which holds that graph: its vertices and the order of their neighbours, of a drawn map's size.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator
from functools import lru_cache
from math import atan2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import dealt, durable
from .groups import each_group

Vertex = Hashable
Rotation = dict[Vertex, list[Vertex]]  # each vertex's neighbours, counter-clockwise

# faces, relationally


def half_edges(edges: DataFrame, points: DataFrame, key: list[str]) -> DataFrame:
    """``key``, u, v and w of every half-edge u → v of straight-line graphs; v → w is the next one around the face on its left.

    ``edges`` has ``key``, u and v in any direction (loops and repeats don't count), ``points`` has ``key``, v, x
    and y. At v the next half-edge is the one before v → u in counter-clockwise order, a window over v's edges.
    """
    n = 2 * edges.count()
    both = edges.select(*key, "u", "v").unionByName(edges.select(*key, F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v")
    both = dealt(both, [*key, "u"], n).distinct()
    at = points.select(*key, F.col("v").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    to = points.select(*key, "v", F.col("x").alias("vx"), F.col("y").alias("vy"))
    placed = dealt(both.join(dealt(at, [*key, "u"], n), [*key, "u"]), [*key, "v"], n).join(dealt(to, [*key, "v"], n), [*key, "v"])
    turned = dealt(placed.select(*key, "u", "v", F.atan2(F.col("vy") - F.col("uy"), F.col("vx") - F.col("ux")).alias("turn")), [*key, "u"], n)
    around = Window.partitionBy(*key, "u").orderBy("turn", "v")
    before = F.coalesce(F.lag("v").over(around), F.last("v").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return turned.select(*key, F.col("v").alias("u"), F.col("u").alias("v"), before.alias("w"))


def faces(halves: DataFrame, key: list[str]) -> DataFrame:
    """``key``, u, v and face of every half-edge: the smallest half-edge (u, v) of its face.

    Each round a half-edge takes the smaller of its own label and that of the half-edge it points to, and points
    to where that one points; rounds grow with the logarithm of the longest face. No label changes in a round only
    if every stretch that has been seen holds its face's smallest half-edge.
    """
    h = durable(halves.select(*key, "u", "v", F.col("v").alias("tu"), F.col("w").alias("tv"), F.col("u").alias("fu"), F.col("v").alias("fv")))
    n = h.count()
    while True:
        there = h.select(*key, F.col("u").alias("tu"), F.col("v").alias("tv"), F.col("tu").alias("nu"), F.col("tv").alias("nv"), F.col("fu").alias("ou"), F.col("fv").alias("ov"))
        to = [*key, "tu", "tv"]
        less = F.expr("ou < fu or (ou = fu and ov < fv)")
        new = dealt(h, to, n).join(dealt(there, to, n), to)
        new = new.select(*key, "u", "v", F.col("nu").alias("tu"), F.col("nv").alias("tv"), F.when(less, F.col("ou")).otherwise(F.col("fu")).alias("fu"), F.when(less, F.col("ov")).otherwise(F.col("fv")).alias("fv"), less.alias("changed"))
        new = durable(new)
        h = new.drop("changed")
        if not new.where("changed").limit(1).count():
            return h.select(*key, "u", "v", F.struct(F.col("fu").alias("u"), F.col("fv").alias("v")).alias("face"))


def face_table(labelled: DataFrame, points: DataFrame, key: list[str]) -> DataFrame:
    """``key``, face, n_edges, area and outer of every face; a component's outer face is the one whose area isn't above zero."""
    at = points.select(*key, F.col("v").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    to = points.select(*key, "v", F.col("x").alias("vx"), F.col("y").alias("vy"))
    n = labelled.count()
    area = F.sum(F.col("ux") * F.col("vy") - F.col("vx") * F.col("uy")) / 2
    placed = dealt(labelled, [*key, "u"], n).join(dealt(at, [*key, "u"], n), [*key, "u"])
    placed = dealt(placed, [*key, "v"], n).join(dealt(to, [*key, "v"], n), [*key, "v"])
    out = dealt(placed, [*key, "face"], n).groupBy(*key, "face").agg(F.count("*").alias("n_edges"), area.alias("area"))
    return out.withColumn("outer", F.col("area") <= 1e-9)


# convex parts of a ring


def _cross(o: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    return float((a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0]))


def triangles(ring: np.ndarray) -> list[tuple[int, int, int]]:
    """A counter-clockwise simple ring in triangles of its corners, cut off one by one; straight corners go last."""
    left = list(range(len(ring)))
    out = []
    while len(left) > 3:
        k = len(left)
        for flat in (False, True):  # a corner with an area, else a straight one
            for i in range(k):
                a, b, c = left[i - 1], left[i], left[(i + 1) % k]
                turn = _cross(ring[a], ring[b], ring[c])
                if turn < -1e-12 or (turn <= 1e-12) != flat:
                    continue
                rest = [ring[j] for j in left if j not in (a, b, c)]
                if flat or not any(_cross(ring[a], ring[b], p) > -1e-12 and _cross(ring[b], ring[c], p) > -1e-12 and _cross(ring[c], ring[a], p) > -1e-12 for p in rest):
                    break
            else:
                continue
            break
        else:
            raise ValueError("the ring crosses itself")
        out.append((a, b, c))
        left.remove(b)
    return [*out, tuple(left)]


def convex_parts(ring: np.ndarray) -> list[list[int]]:
    """A counter-clockwise simple ring as convex parts, lists of its corners: triangles joined while the corners of the cut between them stay convex."""
    parts = {k: list(t) for k, t in enumerate(triangles(ring)) if abs(_cross(*(ring[i] for i in t))) > 1e-12}
    owner = {(p[i], p[(i + 1) % 3]): k for k, p in parts.items() for i in range(3)}
    for a, b in sorted(e for e in owner if e[0] < e[1]):
        if (b, a) not in owner or (k := owner[a, b]) == (m := owner[b, a]):
            continue
        p, q = parts[k], parts[m]
        i, j = p.index(b), q.index(a)
        # p runs b … a and q runs a … b: one walk around both, without the cut
        walk = p[i:] + p[:i]
        walk = walk[:-1] + q[j:] + q[:j]
        walk = walk[:-1]
        n = len(walk)
        if all(_cross(ring[walk[s - 1]], ring[walk[s]], ring[walk[(s + 1) % n]]) >= -1e-12 for s in (0, walk.index(a))):
            parts[k] = walk
            del parts[m]
            for s in range(n):
                owner[walk[s], walk[(s + 1) % n]] = k
    return [parts[k] for k in sorted(parts)]


def convex_decomposition(rings: DataFrame, key: list[str]) -> DataFrame:
    """``key``, part (from 0) and ring of the convex parts of every ring of ``rings`` (``key``, ring); rings of under three corners have none."""
    names = [*key, "ring"]
    types = ", ".join(f"`{c}` {rings.schema[c].dataType.simpleString()}" for c in key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf[names].itertuples(index=False):
                ring = np.array([[p["x"], p["y"]] for p in r[-1]], float).reshape(-1, 2) if r[-1] is not None else np.zeros((0, 2))
                if len(ring) < 3:
                    continue
                x, y = ring.T
                if (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() < 0:
                    ring = ring[::-1]
                rows += [(*r[:-1], k, [{"x": float(ring[i][0]), "y": float(ring[i][1])} for i in part]) for k, part in enumerate(convex_parts(ring))]
            yield pd.DataFrame(rows, columns=[*key, "part", "ring"])

    return rings.select(*names).mapInPandas(run, f"{types}, part int, ring array<struct<x:double,y:double>>")


# one graph


def walks(rotation: Rotation) -> list[list[tuple[Vertex, Vertex]]]:
    """The faces of a graph as cycles of half-edges, each with its face on the left."""
    place = {(v, u): i for v, near in rotation.items() for i, u in enumerate(near)}
    seen: set[tuple[Vertex, Vertex]] = set()
    out = []
    for v in rotation:
        for u in rotation[v]:
            h, face = (v, u), []
            while h not in seen:
                seen.add(h)
                face.append(h)
                h = (h[1], rotation[h[1]][place[h[1], h[0]] - 1])
            if face:
                out.append(face)
    return out


def triangulated(rotation: Rotation, outer: int | None = None) -> tuple[Rotation, tuple[Vertex, Vertex, Vertex]]:
    """A connected graph of three vertices or more with new vertices in all faces that aren't triangles, and its outer triangle in clockwise order.

    A face gets a new vertex before each of its edges, joined to that edge's ends, the two new ones beside it and
    one in the middle. Each new vertex belongs to one edge of one face, so no edge is doubled even where a
    face meets a vertex several times. ``outer`` is the outer face's number in ``walks``.
    """
    out = {v: [] for v in rotation}
    extra: dict[tuple[Vertex, Vertex], list[Vertex]] = {}
    found = walks(rotation)
    corner = None
    for f, face in enumerate(found):
        if len(face) == 3:
            if f == (outer or 0):
                corner = tuple(u for u, _ in face)
            continue
        k = len(face)
        ring = [("side", f, i) for i in range(k)]
        middle = ("middle", f)
        out[middle] = list(ring)
        for i, (u, v) in enumerate(face):
            out[ring[i]] = [ring[(i + 1) % k], middle, ring[i - 1], u, v]
            extra[u, v] = [ring[i], ring[i - 1]]
        if f == (outer or 0):
            corner = (ring[0], ring[1], middle)
    for v, near in rotation.items():
        for u in near:
            out[v] += [u, *extra.get((v, u), [])]
    return out, corner


def shelling(rotation: Rotation, outer: tuple[Vertex, Vertex, Vertex]) -> list[Vertex]:
    """An order of a triangulation's vertices in which each but the first two meets those before it in a path of their border: taken off from the last to the first, never one with a chord."""
    right, left, top = outer
    near_rim = dict.fromkeys(rotation, 0)  # neighbours on the rim
    rim, gone = set(), set()

    def join(v: Vertex) -> None:
        rim.add(v)
        for u in rotation[v]:
            if u not in gone:
                near_rim[u] += 1

    for v in outer:
        join(v)
    ready, order = [top], []
    while ready:
        v = ready.pop()
        if v in gone or v not in rim or near_rim[v] != 2 or v in (left, right):
            continue
        gone.add(v)
        rim.discard(v)
        order.append(v)
        touched = [u for u in rotation[v] if u not in gone]
        for u in touched:
            near_rim[u] -= 1
        for u in touched:
            if u not in rim:
                join(u)
        for u in touched:
            ready += [u, *(w for w in rotation[u] if w in rim)]
    if len(order) != len(rotation) - 2:
        raise ValueError("the graph isn't a triangulation")
    return [left, right, *reversed(order)]


class Wood:
    """A Schnyder wood: every inner vertex has a parent in each of three trees, rooted at the outer vertices left, right and top."""

    def __init__(self, rotation: Rotation, outer: tuple[Vertex, Vertex, Vertex]):
        self.rotation, (self.right, self.left, self.top) = rotation, outer
        self.order = shelling(rotation, outer)
        self.number = {v: k for k, v in enumerate(self.order)}
        self.parent: list[dict[Vertex, Vertex]] = [{}, {}, {}]
        for v in self.order[2:-1]:
            lower = self.lower(v)
            self.parent[0][v], self.parent[1][v] = lower[0], lower[-1]
            self.parent[2][v] = max((u for u in rotation[v]), key=self.number.__getitem__)

    def lower(self, v: Vertex) -> list[Vertex]:
        """The neighbours before v, from left to right: counter-clockwise they follow the ones after it."""
        near, k = self.rotation[v], self.number[v]
        before = [self.number[u] < k for u in near]
        if all(before):  # the top: from the left end of the base on
            at = near.index(self.left)
        else:
            at = next(i for i in range(len(near)) if before[i] and not before[i - 1])
        turned = near[at:] + near[:at]
        return turned[: sum(before)]

    def coordinates(self) -> dict[Vertex, tuple[int, int, int]]:
        """Integer coordinates that add up to n - 1, without crossings: vertices of each region, less those of one of its paths."""
        roots = (self.left, self.right, self.top)
        size = [dict.fromkeys(self.rotation, 1) for _ in range(3)]
        # children come before parents: towards the top numbers grow, in the other trees they fall
        for i in range(3):
            for v in self.order[2:-1] if i == 2 else reversed(self.order[2:-1]):
                size[i][self.parent[i][v]] += size[i][v]
        total = [[dict.fromkeys(self.rotation, 0) for _ in range(3)] for _ in range(3)]  # sizes in tree j along the path in tree i
        length = [dict.fromkeys(self.rotation, 1) for _ in range(3)]
        for i in range(3):
            for j in range(3):
                for r in roots:
                    total[i][j][r] = 1 if r != roots[j] else size[j][r]
            for v in reversed(self.order[2:-1]) if i == 2 else self.order[2:-1]:
                p = self.parent[i][v]
                length[i][v] = length[i][p] + 1
                for j in range(3):
                    total[i][j][v] = total[i][j][p] + size[j][v]
        n = len(self.rotation)
        out = {}
        for i, r in enumerate(roots):
            out[r] = tuple(n - 2 if k == i else 1 if k == (i + 1) % 3 else 0 for k in range(3))
        for v in self.order[2:-1]:
            got = []
            for i in range(3):
                a, b = (i + 1) % 3, (i + 2) % 3
                inside = total[a][i][v] + total[b][i][v] - size[i][v]
                got.append(inside - length[b][v])
            out[v] = tuple(got)
        return out


def on_cells(rotation: Rotation, outer: int = 0) -> dict[tuple[int, int], Vertex]:
    """Cells (x, y) of a connected graph's vertices: regions in one piece, of which two are in contact exactly if they are joined.

    Vertices are bars on rows in the order of a shelling, edges are columns between them, numbered by the longest
    path through the faces from left to right, so no column crosses a bar (a visibility drawing of the
    triangulated graph). New vertices and their edges are left out and rows and columns drawn closer, every
    other one left free; a column belongs to its lower end. Contact is between cells whose coordinates differ
    by one in one direction, and cells of regions that aren't joined differ by two at least in one.
    """
    if len(rotation) < 3:
        return {(i, 0): v for i, v in enumerate(rotation)}
    full, corner = triangulated(rotation, outer)
    wood = Wood(full, corner)
    k = wood.number
    face = {h: f for f, walk in enumerate(walks(full)) for h in walk}
    ends = {face[h] for h in zip(corner, (*corner[1:], corner[0]), strict=True)}
    (beyond,) = ends
    up = [(v, u) for v in full for u in full[v] if k[v] < k[u]]
    arcs = [(-1 if (f := face[e]) == beyond else f, -2 if (g := face[e[::-1]]) == beyond else g) for e in up]
    column = _longest(arcs)
    row = _longest(up)
    real = [(v, u) for v, u in up if v in rotation and u in rotation and u in rotation[v]]
    x_of = {e: column[a] for e, (a, _) in zip(up, arcs, strict=True)}
    xs = {x: 2 * i for i, x in enumerate(sorted({x_of[e] for e in real}))}
    ys = {y: 2 * i for i, y in enumerate(sorted({row[v] for v in rotation}))}
    spread: dict[Vertex, list[int]] = {v: [] for v in rotation}
    out = {}
    for v, u in real:
        x = xs[x_of[v, u]]
        spread[v].append(x)
        spread[u].append(x)
        out.update(((x, y), v) for y in range(ys[row[v]] + 1, ys[row[u]]))
    for v, at in spread.items():
        out.update(((x, ys[row[v]]), v) for x in range(min(at), max(at) + 1))
    return out


def _longest(arcs: Iterable[tuple[Vertex, Vertex]]) -> dict[Vertex, int]:
    """The longest path to every node of an acyclic graph."""
    after: dict[Vertex, list[Vertex]] = {}
    waits: dict[Vertex, int] = {}
    for a, b in arcs:
        after.setdefault(a, []).append(b)
        waits[b] = waits.get(b, 0) + 1
        waits.setdefault(a, 0)
    out = {a: 0 for a, n in waits.items() if n == 0}
    ready = list(out)
    while ready:
        a = ready.pop()
        for b in after.get(a, []):
            out[b] = max(out.get(b, 0), out[a] + 1)
            waits[b] -= 1
            if not waits[b]:
                ready.append(b)
    return out


def rotation_of(rings: list[np.ndarray], digits: int = 6) -> tuple[Rotation, int]:
    """The dual of adjoining counter-clockwise rings: neighbours in the order in which a ring meets them, and the outer face's number in ``walks``.

    Rings adjoin along whole common edges. Of several between two rings one is crossed, the same from both sides, so the dual is
    drawn without crossings; its outer face is the one of least area around the rings' mean corners and the crossed edges.
    """
    spots: dict[tuple, list[tuple[int, int]]] = {}
    for r, ring in enumerate(rings):
        corners = [tuple(p) for p in np.round(ring, digits) + 0.0]
        for i, a in enumerate(corners):
            b = corners[(i + 1) % len(corners)]
            if a != b:
                spots.setdefault((min(a, b), max(a, b)), []).append((r, i))
    crossed: dict[tuple[int, int], tuple] = {}
    for key in sorted(spots):
        for a, i in spots[key]:
            for b, j in spots[key]:
                if a < b:
                    crossed.setdefault((a, b), (key, i, j))
    near: dict[int, list[tuple[int, int]]] = {r: [] for r in range(len(rings))}
    gate = {}
    for (a, b), (key, i, j) in crossed.items():
        near[a].append((i, b))
        near[b].append((j, a))
        gate[a, b] = gate[b, a] = np.mean(key, axis=0)
    rotation = {r: [b for _, b in sorted(at)] for r, at in near.items()}
    middle = [ring.mean(axis=0) for ring in rings]
    sizes = []
    for walk in walks(rotation):
        path = np.array([p for u, v in walk for p in (middle[u], gate[u, v])])
        x, y = path.T
        sizes.append(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()))
    return rotation, int(np.argmin(sizes)) if sizes else 0


def embedding(partitions: DataFrame, comps: DataFrame) -> DataFrame:
    """map_id, comp_id, outline_id, partition_id, x and y: the dual of each component of adjoining partitions on cells, as in ``on_cells``; one kernel per component."""
    comp = comps.schema["comp_id"].dataType.simpleString()
    p = partitions.join(comps, ["map_id", "outline_id", "partition_id"]).select("map_id", "comp_id", "outline_id", "partition_id", "ring")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["outline_id", "partition_id"]).reset_index(drop=True)
        rings = []
        for ring in pdf.ring:
            ring = np.array([[q["x"], q["y"]] for q in ring], float)
            x, y = ring.T
            rings.append(ring if (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() >= 0 else ring[::-1])
        at = on_cells(*rotation_of(rings))
        own = pdf.loc[list(at.values()), ["map_id", "comp_id", "outline_id", "partition_id"]].reset_index(drop=True)
        own["x"], own["y"] = [c[0] for c in at], [c[1] for c in at]
        return own

    return p.groupBy("map_id", "comp_id").applyInPandas(run, f"map_id string, comp_id {comp}, outline_id int, partition_id int, x int, y int")


@lru_cache(4096)
def _wood(halves: tuple[tuple[Vertex, Vertex, Vertex], ...], outer: int | None) -> tuple:
    """The walks of a graph of half-edges u → v before v → w, or, given the number of its outer walk, its wood's columns; graphs of one shape share them."""
    after = {(v, w): u for u, v, w in halves}  # around v, u comes after w counter-clockwise
    rotation: Rotation = {}
    for c, first in after:
        if c not in rotation:
            ring = [first]
            while (nxt := after[c, ring[-1]]) != first:
                ring.append(nxt)
            rotation[c] = ring
    if outer is None:
        return tuple(tuple(walk) for walk in walks(rotation)) if len(rotation) > 2 else ()
    wood = Wood(*triangulated(rotation, outer))
    k, where = wood.number, wood.coordinates()
    return tuple(zip(*((c if c in rotation else None, *where[c], *(k[tree[c]] if c in tree else None for tree in wood.parent)) for c in wood.order), strict=True))


def _halves(u: list, v: list, at: dict[Vertex, tuple[float, float]]) -> tuple[tuple[Vertex, Vertex, Vertex], ...]:
    """u, v and w of every half-edge u → v of one graph, sorted, as ``half_edges`` has them."""
    near: dict[Vertex, set[Vertex]] = {}
    for p, q in zip(u, v, strict=True):
        if p in at and q in at:
            near.setdefault(p, set()).add(q)
            near.setdefault(q, set()).add(p)
    out = []
    for c, others in near.items():
        x, y = at[c]
        ring = [q for _, q in sorted((atan2(at[q][1] - y, at[q][0] - x), q) for q in others)]
        out += [(q, c, ring[i - 1]) for i, q in enumerate(ring)]
    return tuple(sorted(out))


def woods(edges: DataFrame, points: DataFrame, key: list[str]) -> DataFrame:
    """``key`` and lists of the vertices of each triangulated graph: v, three coordinates a, b, c and the three parents, which are places in these lists.

    Faces that aren't triangles get new vertices (see ``triangulated``), whose v is null; parents are null for the three outer
    vertices, the first two and the last. Graphs must be connected; those of under three vertices are left out.
    A graph's edges and points are sent once, to the task that holds the graph, and its wood is one row: no step sends
    half-edges or their ends. Places only tell which walk is the outer one: a wood depends on the rest of the graph alone, so a task
    remembers those of the small graphs that it has met last.
    """
    kind = points.schema["v"].dataType.simpleString()
    none = F.lit(None)
    rows = edges.where("u <> v").select(*key, "u", "v", none.cast("double").alias("x"), none.cast("double").alias("y"))
    rows = rows.unionByName(points.where("v IS NOT NULL").select(*key, none.cast(edges.schema["u"].dataType).alias("u"), "v", "x", "y"))

    def run(u: list, v: list, x: list[float], y: list[float]) -> list[tuple]:
        at = {q: p for s, q, *p in zip(u, v, x, y, strict=True) if s is None}
        halves = _halves([s for s in u if s is not None], [q for s, q in zip(u, v, strict=True) if s is not None], at)
        wood = _wood if len(halves) <= 100 else _wood.__wrapped__
        sizes = [sum(at[p][0] * at[q][1] - at[q][0] * at[p][1] for p, q in walk) for walk in wood(halves, None)]
        return [wood(halves, int(np.argmin(sizes)))] if sizes else []

    numbers = ", ".join(f"`{c}` array<int>" for c in ("a", "b", "c", "left", "right", "top"))
    return each_group(rows, key, ["u", "v", "x", "y"], run, f"v array<{kind}>, {numbers}", rows.count())


def schnyder(edges: DataFrame, points: DataFrame, key: list[str]) -> DataFrame:
    """The vertices of ``woods`` one by one: ``key``, number (from 0), v, a, b, c, left, right and top; parents are numbers."""
    columns = ["v", "a", "b", "c", "left", "right", "top"]
    one = woods(edges, points, key).select(*key, F.posexplode(F.arrays_zip(*columns)).alias("number", "_vertex"))
    return one.select(*key, "number", *(F.col("_vertex")[c].alias(c) for c in columns))
