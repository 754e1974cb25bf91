"""Splitting outlines at narrow passages into partitions of enough sites."""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import durable
from ..functions.colors import number_colors
from ..functions.geometry import counter_clockwise
from ..functions.grids import ring_area
from ..schema import INPUT, PARTITIONED, RING, TileMap
from .spatial import locate

CUT_TYPES = ("SHORTEST", "ENDPOINTS", "COMBINED")
EPS = 1e-9


class Boundary:
    """A counter-clockwise ring with positions (edge, distance from the edge's start) and their lengths from the ring's start."""

    def __init__(self, ring: np.ndarray):
        self.ring = ring if ring_area(ring) >= 0 else ring[::-1]
        self.n = len(self.ring)
        self.step = np.roll(self.ring, -1, 0) - self.ring
        self.len = np.hypot(*self.step.T)
        self.start = np.r_[0, np.cumsum(self.len)[:-1]]
        self.total = float(self.len.sum())
        before = np.roll(self.step, 1, 0)
        self.reflex = before[:, 0] * self.step[:, 1] - before[:, 1] * self.step[:, 0] < -EPS

    def position(self, edge: int, dist: float) -> tuple[int, float]:
        if dist >= self.len[edge] - 1e-7:
            return (edge + 1) % self.n, 0.0
        return edge, max(0.0, dist) if dist > 1e-7 else 0.0

    def at(self, pos: tuple[int, float]) -> float:
        return float(self.start[pos[0]] + pos[1])

    def point(self, pos: tuple[int, float]) -> np.ndarray:
        e, d = pos
        return self.ring[e] + self.step[e] * (d / self.len[e] if self.len[e] else 0)


class Discs:
    """The discs through a reflex vertex v: how far each grows, by direction of its centre, until it meets another part of the boundary.

    Features are the reflex vertices (numbers below n) and the edges (n and up). One over the
    radius at which a disc in direction t meets a feature is a + b cos t + c sin t, for an edge
    between the two directions whose discs touch its ends; the largest of these holds.
    """

    def __init__(self, b: Boundary, v: int):
        p, n = b.ring[v], b.n
        unit = b.step / np.maximum(b.len, 1e-300)[:, None]
        normal = np.stack([-unit[:, 1], unit[:, 0]], 1)
        rel = b.ring - p
        far, gap, foot = (rel * rel).sum(1), -(rel * normal).sum(1), -(rel * unit).sum(1)
        point = b.reflex & (far > 1e-18)
        edge = gap > 1e-12
        edge[[v, v - 1]] = False
        with np.errstate(divide="ignore", invalid="ignore"):
            a = np.r_[np.zeros(n), 1 / gap]
            bc = np.r_[2 * rel / far[:, None], -normal / gap[:, None]]
            start = np.arctan2(normal[:, 1], normal[:, 0]) + 2 * np.arctan2(1, (foot + 1e-9) / gap)
            width = 2 * np.arctan2(1, (foot - b.len - 1e-9) / gap) - 2 * np.arctan2(1, (foot + 1e-9) / gap)
        self.feature = np.flatnonzero(np.r_[point, edge])
        self.a, self.b, self.c = a[self.feature], bc[self.feature, 0], bc[self.feature, 1]
        all_round = np.r_[np.full(n, -math.inf), start][self.feature]
        self.start, self.width = all_round, np.r_[np.full(n, math.inf), width][self.feature]
        self.peak = np.arctan2(self.c, self.b)

    def _offset(self, t: float) -> np.ndarray:
        """How far behind the start of each feature's directions t lies."""
        with np.errstate(invalid="ignore"):
            return np.where(np.isfinite(self.start), (t - self.start) % (2 * math.pi), 0.0)

    def owner(self, t: float) -> int:
        """The row of the feature that the disc in direction t meets first, -1 for none."""
        if not len(self.a):
            return -1
        g = self.a + self.b * math.cos(t) + self.c * math.sin(t)
        g[self._offset(t) > self.width] = -math.inf
        k = int(g.argmax())
        return k if g[k] > 1e-12 else -1

    def hidden(self, k: int, t0: float, t1: float) -> float | None:
        """A direction strictly between two that meet k in which another feature is met first; None if there is none."""
        a, b, c = self.a, self.b, self.c
        da, db, dc = a - (a[k] if k >= 0 else 1e-9), b - (b[k] if k >= 0 else 0), c - (c[k] if k >= 0 else 0)
        # where a feature's directions overlap the range: both are taken from t0 on
        off = self._offset(t0)
        inside = off <= self.width
        lo = np.where(inside, t0, t0 + 2 * math.pi - off)
        hi = np.minimum(t1, np.where(inside, t0 + self.width - off, lo + self.width))
        lo, hi = np.where(np.isfinite(self.width), lo, t0), np.where(np.isfinite(self.width), hi, t1)
        best, where = np.full(len(a), -math.inf), np.full(len(a), t0)
        peak = np.arctan2(dc, db)
        peak = lo + (peak - lo) % (2 * math.pi)
        for t in (lo, hi, np.where(peak <= hi, peak, lo)):
            d = np.where(hi >= lo, da + db * np.cos(t) + dc * np.sin(t), -math.inf)
            where, best = np.where(d > best, t, where), np.maximum(best, d)
        if k >= 0:
            best[k] = -math.inf
        j = int(best.argmax()) if len(best) else -1
        return float(where[j]) if j >= 0 and best[j] > 1e-9 and t0 + 1e-10 < where[j] < t1 - 1e-10 else None


def arcs(b: Boundary, v: int, samples: int = 16) -> list[tuple[str, int, float, float]]:
    """The medial-axis arcs of reflex vertex v: (point or edge, index, first and last direction).

    Some directions of v's cone give a first division. Between two directions that meet one
    feature, any other that is met first is found in closed form and divides them again;
    between two that meet different ones the border is found by halving. So no arc is lost,
    however narrow.
    """
    n_in, n_out = (np.array([-s[1], s[0]]) / np.hypot(*s) for s in (b.step[v - 1], b.step[v]))
    lo, hi = math.atan2(n_out[1], n_out[0]), math.atan2(n_in[1], n_in[0])
    span = (hi - lo) % (2 * math.pi)
    if span > math.pi:
        lo, span = hi, 2 * math.pi - span
    if span < 1e-9:
        return []
    discs = Discs(b, v)
    first = [lo + span * k / samples for k in range(samples + 1)]
    first[0], first[-1] = lo + span * 1e-9, lo + span * (1 - 1e-9)
    known = [(t, discs.owner(t)) for t in first]
    out: list[tuple[float, int]] = [known[0]]
    stack = [(known[k], known[k + 1]) for k in range(samples - 1, -1, -1)]
    while stack:
        (t0, k0), (t1, k1) = stack.pop()
        at = None
        if t1 - t0 > 1e-10:
            at = (t0 + t1) / 2 if k0 != k1 else discs.hidden(k0, t0, t1)
        k = discs.owner(at) if at is not None else k0
        if at is None or k == k0 == k1:
            out.append((t1, k1))
        else:
            stack += [((at, k), (t1, k1)), ((t0, k0), (at, k))]
    found, i = [], 0
    while i < len(out):
        j = i
        while j + 1 < len(out) and out[j + 1][1] == out[i][1]:
            j += 1
        if out[i][1] >= 0:
            k = int(discs.feature[out[i][1]])
            found.append(("point", k, out[i][0], out[j][0]) if k < b.n else ("edge", k - b.n, out[i][0], out[j][0]))
        i = j + 1
    return found


def candidates(b: Boundary, kind: str) -> list[tuple[tuple[int, float], tuple[int, float]]]:
    """Cuts (start, end positions, in ring order), without repeats, from arcs that touch a reflex vertex."""
    found: dict[tuple, tuple] = {}

    def add(p: tuple[int, float], q: tuple[int, float]) -> None:
        s, e = sorted((p, q), key=b.at)
        if b.at(e) - b.at(s) > 1e-7 and np.hypot(*(b.point(e) - b.point(s))) > 1e-7:
            found.setdefault((s[0], round(s[1], 6), e[0], round(e[1], 6)), (s, e))

    for v in np.flatnonzero(b.reflex).tolist():
        for what, k, t0, t1 in arcs(b, v):
            if what == "point":
                if k not in ((v + 1) % b.n, (v - 1) % b.n):
                    add((v, 0.0), (k, 0.0))
                continue
            unit = b.step[k] / b.len[k]
            normal = np.array([-unit[1], unit[0]])
            gap = float((b.ring[v] - b.ring[k]) @ normal)
            ends = []
            for t in (t0, t1):
                u = np.array([math.cos(t), math.sin(t)])
                r = gap / (1 - float(u @ normal))
                ends.append((float((b.ring[v] + r * u - b.ring[k]) @ unit), r))
            low, high = sorted(e[0] for e in ends)
            foot = float((b.ring[v] - b.ring[k]) @ unit)
            inside = low + 1e-9 < foot < high - 1e-9
            stops = []
            if kind in ("SHORTEST", "COMBINED") and inside:
                stops.append(foot)
            elif kind == "SHORTEST":
                stops.append(min(ends, key=lambda e: e[1])[0])
            if kind in ("ENDPOINTS", "COMBINED"):
                stops += [low, high]
            for d in stops:
                add((v, 0.0), b.position(k, d))
    return list(found.values())


def winding(b: Boundary, sites: np.ndarray) -> np.ndarray:
    """Angle (site, vertex) swept from the ring's start to each vertex as seen from each site, and once round."""
    a = b.ring[None] - sites[:, None]
    c = np.roll(b.ring, -1, 0)[None] - sites[:, None]
    turn = np.arctan2(a[..., 0] * c[..., 1] - a[..., 1] * c[..., 0], (a * c).sum(-1))
    return np.concatenate([np.zeros((len(sites), 1)), np.cumsum(turn, 1)], 1)


def below(b: Boundary, sites: np.ndarray, wound: np.ndarray, s: tuple[int, float], e: tuple[int, float]) -> np.ndarray:
    """Which sites lie between the boundary from s to e and the chord back."""

    def angle(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        u, w = p - sites, q - sites
        return np.arctan2(u[:, 0] * w[:, 1] - u[:, 1] * w[:, 0], (u * w).sum(1))

    total = wound[:, e[0]] - wound[:, s[0]] + angle(b.ring[e[0]], b.point(e)) - angle(b.ring[s[0]], b.point(s)) + angle(b.point(e), b.point(s))
    return total > 0.5 * 2 * math.pi


class Region:
    """A part of the outline as a walk around it: stretches of the boundary (lengths from the ring's start), and after each a chord to the next.

    The last stretch's chord leads back to the first; a chord is its length and the number of the region beyond it
    (the outline's last one is no chord: length 0, number -1). ``walked`` is how far the walk is at each stretch's start.
    """

    def __init__(self, stretches: list[tuple[float, float]], chords: list[tuple[float, int]], sites: np.ndarray):
        self.stretches, self.chords, self.sites = stretches, chords, sites
        steps = [e - s + c for (s, e), (c, _) in zip(stretches, chords, strict=True)]
        self.walked = np.r_[0.0, np.cumsum(steps)]
        self.starts = [s for s, _ in stretches]

    def spot(self, x: float) -> tuple[int, float] | None:
        """The stretch that holds a boundary place, and how far the walk is there; None outside."""
        k = bisect_right(self.starts, x) - 1
        while k >= 0 and x <= self.stretches[k][1]:
            if x >= self.stretches[k][0]:
                return k, float(self.walked[k]) + x - self.stretches[k][0]
            k -= 1
        return None

    def divided(self, x: float, y: float, long: float, beyond: int, own: int, hit: np.ndarray) -> tuple[Region, Region]:
        """The region without the part from x to y, and that part, which gets the number ``beyond``."""
        i, j = self.spot(x)[0], self.spot(y)[0]
        first, last = self.stretches[i][0], self.stretches[j][1]
        rest = Region([*self.stretches[:i], (first, x), (y, last), *self.stretches[j + 1 :]], [*self.chords[:i], (long, beyond), *self.chords[j:]], self.sites[~hit])
        inner = [(x, y)] if i == j else [(x, self.stretches[i][1]), *self.stretches[i + 1 : j], (self.stretches[j][0], y)]
        return rest, Region(inner, [*self.chords[i:j], (long, own)], self.sites[hit])


def split(ring: np.ndarray, sites: np.ndarray, kind: str = "COMBINED", dilation: float = 3.0, productivity: int = 10) -> tuple[list[np.ndarray], dict[str, int]]:
    """The rings of an outline's partitions, and how many cuts were found, left after the first filter, and applied.

    Cuts are tried from the shortest. A cut whose ends lie in no one region crosses an applied one and is skipped;
    otherwise it is applied if both sides keep ``productivity`` sites, and ``dilation`` times its length of border
    besides itself. A side's border is the difference of two places in the region's walk, so a cut is judged by
    two searches in it. Partitions are numbered from the outline's start, each followed by what lies beyond its
    cuts, the last cut first.
    """
    b = Boundary(ring)
    raw = candidates(b, kind)
    cuts = []
    for s, e in raw:
        x, y = b.at(s), b.at(e)
        long = float(np.hypot(*(b.point(e) - b.point(s))))
        if min(y - x, b.total - y + x) >= dilation * long:  # borders only get shorter as cuts are applied
            cuts.append((long, x, y, s, e))
    cuts.sort(key=lambda c: c[0])
    wound = winding(b, sites)
    regions = [Region([(0.0, b.total)], [(0.0, -1)], np.arange(len(sites)))]
    place = {}
    done = set()
    for long, x, y, s, e in cuts:
        if (x, y) in done:
            continue
        for own, region in enumerate(regions):
            at, to = region.spot(x), region.spot(y)
            if at and to:
                break
        else:
            continue
        inside = to[1] - at[1]
        border = min(inside, float(region.walked[-1]) - inside)
        if border < dilation * long:
            continue
        hit = below(b, sites[region.sites], wound[region.sites], s, e)
        if min(hit.sum(), (~hit).sum()) < productivity:
            continue
        done.add((x, y))
        place[x], place[y] = s, e
        regions[own], part = region.divided(x, y, long, len(regions), own, hit)
        for _, there in part.chords[:-1]:  # the regions beyond are now beyond the part
            regions[there].chords[-1] = (regions[there].chords[-1][0], len(regions))
        regions.append(part)
    stats = {"found": len(raw), "remaining": len(cuts), "applied": len(done)}
    place |= {0.0: (0, 0.0), b.total: (b.n - 1, float(b.len[-1]))}

    def outline(region: Region) -> np.ndarray:
        points: list[np.ndarray] = []
        for x, y in region.stretches:
            p, q = place[x], place[y]
            points += [b.point(p), *(b.ring[i % b.n] for i in range(p[0] + 1, q[0] + 1)), b.point(q)]
        kept = [p for i, p in enumerate(points) if i == 0 or np.hypot(*(p - points[i - 1])) > 1e-7]
        while len(kept) > 1 and np.hypot(*(kept[0] - kept[-1])) <= 1e-7:
            kept.pop()
        return np.array(kept)

    out, stack = [], [0]
    while stack:
        region = regions[stack.pop()]
        out.append(outline(region))
        stack += [there for _, there in region.chords[:-1]]
    return out, stats


def cut_tree(cuts: list[tuple[float, float]]) -> list[int]:
    """The parent of each cut (start, end) of an outline: the innermost other cut around it, -1 without one.

    One pass over all ends along the boundary with the open cuts on a stack; at one place ends come before
    starts and outer cuts open first and close last (equal ones by number). Cuts that cross raise an error.
    """
    ends = [(e, 0, -s, -k) for k, (s, e) in enumerate(cuts)] + [(s, 1, -e, k) for k, (s, e) in enumerate(cuts)]
    parent, open_ = [-1] * len(cuts), []
    for _, starts, _, k in sorted(ends):
        if starts:
            parent[k] = open_[-1] if open_ else -1
            open_.append(k)
        elif open_.pop() != -k:
            raise ValueError("two cuts cross")
    return parent


def spliced(parent: list[int], keep: list[bool]) -> list[int]:
    """The tree of the kept cuts: each under its nearest kept ancestor; cuts left out have -2. Every cut is looked at once."""
    found: dict[int, int] = {-1: -1}

    def above(k: int) -> int:
        """The nearest kept cut from k upwards, k included."""
        path = []
        while k not in found and not keep[k]:
            path.append(k)
            k = parent[k]
        top = found.get(k, k)
        found.update(dict.fromkeys(path, top))
        return top

    return [above(parent[k]) if keep[k] else -2 for k in range(len(parent))]


def wide_cuts(cuts: list[tuple[float, float]], lengths: list[float], total: float, dilation: float) -> list[int]:
    """The tree of nested cuts without those whose shorter side of the ring isn't ``dilation`` times their length."""
    return spliced(cut_tree(cuts), [min(e - s, total - e + s) >= dilation * long for (s, e), long in zip(cuts, lengths, strict=True)])


def distinct_cuts(cuts: DataFrame, key: list[str], digits: int = 6) -> DataFrame:
    """``key``, start and end of cuts between two boundary places each, in either order: each pair once, the lesser first, none from a place to itself."""
    s, e = F.round("start", digits), F.round("end", digits)
    return cuts.select(*key, F.least(s, e).alias("start"), F.greatest(s, e).alias("end")).where("start < end").distinct()


def nested_cuts(cuts: DataFrame, rings: DataFrame, key: list[str], dilation: float) -> DataFrame:
    """``key``, cut, parent, kept and kept_parent of every cut: the tree by ``cut_tree``, and that of the cuts whose shorter side of the ring is ``dilation`` times their length.

    ``cuts`` has ``key``, cut (its number), start, end and length; ``rings`` has ``key`` and total, the ring's length. A ring's cuts are
    one group; they mustn't cross. Parents are null at the top, kept_parent also for cuts that aren't kept.
    """
    names = [*key, "cut", "parent", "kept", "kept_parent"]
    types = ", ".join(f"`{c}` {cuts.schema[c].dataType.simpleString()}" for c in key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cut")
        number = [*pdf["cut"].tolist(), None]  # -1 is the last
        places, lengths = list(zip(pdf.start, pdf.end, strict=True)), pdf.length.tolist()
        tree, left = cut_tree(places), wide_cuts(places, lengths, float(pdf.total.iloc[0]), dilation)
        base = [pdf[c].iloc[0] for c in key]
        return pd.DataFrame([(*base, k, number[p], q != -2, None if q == -2 else number[q]) for k, p, q in zip(number, tree, left)], columns=names).astype({"parent": "Int64", "kept_parent": "Int64"})

    return cuts.join(rings, key).groupBy(*key).applyInPandas(run, f"{types}, cut long, parent long, kept boolean, kept_parent long")


KERNEL = f"map_id string, outline_id int, partition_id int, ring {RING}, found int, remaining int, applied int"


def partition(m: TileMap, kind: str = "COMBINED", dilation: float = 3.0, productivity: int = 10) -> tuple[TileMap, DataFrame]:
    """The map at stage PARTITIONED, and per outline how many cuts were found, remaining and applied.

    Outlines with under 2 * productivity sites can't be cut and stay whole, natively; the
    others are cut by one kernel each, in parallel. Sites go to the first partition that
    holds them (in their outline), or to its nearest partition centroid where rounding
    leaves them in none.
    """
    if kind not in CUT_TYPES:
        raise ValueError(f"unknown cut type {kind!r}; known: {', '.join(CUT_TYPES)}")
    m.require(INPUT)
    m = m.at(INPUT)
    points = m.sites.groupBy("map_id", "outline_id").agg(F.collect_list(F.struct("x", "y")).alias("_s"), F.count("*").alias("_n"))  # the sites of one outline
    o = m.outlines.join(points, ["map_id", "outline_id"], "left").withColumn("_n", F.coalesce("_n", F.lit(0))).withColumn("ring", counter_clockwise(F.col("ring")))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        ring = np.array([[p["x"], p["y"]] for p in r.ring])
        sites = np.array([[p["x"], p["y"]] for p in r._s])
        rings, stats = split(ring, sites, kind, dilation, productivity)
        rows = [(r.map_id, r.outline_id, k, [{"x": float(x), "y": float(y)} for x, y in g], *stats.values()) for k, g in enumerate(rings)]
        return pd.DataFrame(rows, columns=["map_id", "outline_id", "partition_id", "ring", *stats])

    can = F.col("_n") >= 2 * productivity
    cut = o.where(can).select("map_id", "outline_id", "ring", "_s").groupBy("map_id", "outline_id").applyInPandas(kernel, KERNEL)
    whole = o.where(~can).select("map_id", "outline_id", F.lit(0).alias("partition_id"), "ring", *(F.lit(0).alias(c) for c in ("found", "remaining", "applied")))
    made = durable(cut.unionByName(whole))
    stats = made.select("map_id", "outline_id", "found", "remaining", "applied").distinct()
    named = made.join(m.outlines.select("map_id", "outline_id", "label", F.col("color").alias("_c"), "custom_weight"), ["map_id", "outline_id"])
    one = F.col("applied") == 0
    named = number_colors(named, ["map_id"], ["outline_id", "partition_id"])
    partitions = named.select("map_id", "outline_id", "partition_id", F.when(one, F.col("label")).otherwise(F.concat_ws(":", "label", F.col("partition_id") + 1)).alias("label"), F.lit(None).cast("struct<x:double,y:double>").alias("label_pt"), F.when(one, F.col("_c")).otherwise(F.col("color")).alias("color"), "ring", "custom_weight")
    put = locate(m.sites.drop("partition_id"), partitions, ["map_id", "outline_id", "site_id"], "partition_id", ["map_id", "outline_id"])
    lost = put.where("partition_id is null").drop("partition_id").join(partitions.select("map_id", "outline_id", "partition_id", F.aggregate("ring", F.lit(0.0), lambda s, p: s + p["x"], lambda s: s / F.size("ring")).alias("_x"), F.aggregate("ring", F.lit(0.0), lambda s, p: s + p["y"], lambda s: s / F.size("ring")).alias("_y")), ["map_id", "outline_id"])
    near = lost.groupBy("map_id", "outline_id", "site_id").agg(F.min_by("partition_id", F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"))).alias("_p"))
    sites = put.join(near, ["map_id", "outline_id", "site_id"], "left").withColumn("partition_id", F.coalesce("partition_id", "_p")).select(*m.sites.columns)
    return m.with_(partitions=partitions, sites=sites).staged(PARTITIONED), stats


def trivial(m: TileMap) -> TileMap:
    """One partition per outline; every site is in it."""
    m.require(INPUT)
    m = m.at(INPUT)
    partitions = m.outlines.select("map_id", "outline_id", F.lit(0).alias("partition_id"), "label", "label_pt", "color", "ring", "custom_weight")
    return m.with_(partitions=partitions, sites=m.sites.withColumn("partition_id", F.lit(0))).staged(PARTITIONED)
