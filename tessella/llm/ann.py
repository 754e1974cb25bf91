"""Nearest vectors by inner product: a hierarchical navigable small-world graph per shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, slices, stored


class Layer:
    """A navigable graph over some rows of ``x``: ``near`` holds each node's neighbours, -1 where there are fewer."""

    def __init__(self, nodes: np.ndarray, near: np.ndarray):
        self.nodes, self.near = nodes, near


def _diverse(x: np.ndarray, own: np.ndarray, cand: np.ndarray, sim: np.ndarray, degree: int) -> np.ndarray:
    """Up to ``degree`` neighbours per row from candidates (-1: none): best first, those nearer to the row than to a chosen one; then the best of the rest."""
    order = np.argsort(-sim, axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    v = x[np.maximum(cand, 0)]
    among = v @ v.transpose(0, 2, 1)
    n, c = cand.shape
    chosen = np.zeros((n, c), bool)
    for j in range(c):
        close = (chosen[:, :j] & (among[:, j, :j] > sim[:, j, None])).any(1) if j else np.zeros(n, bool)
        chosen[:, j] = (cand[:, j] >= 0) & ~close & (chosen[:, :j].sum(1) < degree)
    rank = np.where(chosen, 0, np.where(cand >= 0, 1, 2)) * c + np.arange(c)
    best = np.argsort(rank, axis=1)[:, :degree]
    out = np.take_along_axis(cand, best, 1)
    return np.pad(out, ((0, 0), (0, max(0, degree - out.shape[1]))), constant_values=-1)


def search_layer(x: np.ndarray, near: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search for all rows of q in step: ids (n, beam) and similarities, best first; -1 where there are fewer.

    ``entry`` (n, e) are the nodes to begin with. In each step every query expands its best
    ``at_once`` open nodes, until the beam has no open node left.
    """
    n, size = len(q), len(near)
    seen = np.zeros((n, size), bool)
    ids = np.full((n, beam), -1)
    sim = np.full((n, beam), -np.inf, np.float32)
    done = np.ones((n, beam), bool)
    rows = np.arange(n)[:, None]

    def merge(live: np.ndarray, new: np.ndarray) -> None:
        new = np.sort(new, 1)
        fresh = (new >= 0) & ~seen[live[:, None], np.maximum(new, 0)]
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        r, c = np.nonzero(fresh)
        at = new[r, c]
        seen[live[r], at] = True
        s = np.full(new.shape, -np.inf, np.float32)
        s[r, c] = np.einsum("ij,ij->i", x[at], q[live[r]])
        all_s = np.concatenate([sim[live], s], 1)
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        sim[live] = np.take_along_axis(all_s, top, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, new, -1)], 1), top, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], 1), top, 1)

    merge(np.arange(n), entry)
    live = np.arange(n)
    while len(live):
        opened = np.where(done[live], -np.inf, sim[live])
        k = min(at_once, beam)
        best = np.argpartition(-opened, k - 1, axis=1)[:, :k]
        ok = np.take_along_axis(opened, best, 1) > -np.inf
        going = ok.any(1)
        live, best, ok = live[going], best[going], ok[going]
        if not len(live):
            break
        to = near[np.where(ok, ids[live[:, None], best], 0)]
        to[~ok] = -1
        r, c = np.nonzero(ok)
        done[live[r], best[r, c]] = True
        merge(live, to.reshape(len(live), -1))
    order = np.argsort(-sim, axis=1, kind="stable")
    return ids[rows, order], sim[rows, order]


class Graph:
    """A small-world graph with layers; inner products decide, on rows made equally long by one more component.

    With that component (zero in queries) the best inner product is also the smallest
    distance, so the graph stays navigable for vectors of any lengths.
    """

    def __init__(self, vectors: np.ndarray, layers: list[Layer], entries: np.ndarray | None = None):
        self.vectors, self.layers = vectors, layers
        self.entries = np.zeros(1, int) if entries is None else entries
        self.x = self.levelled(vectors)

    @staticmethod
    def levelled(vectors: np.ndarray) -> np.ndarray:
        vectors = vectors / (np.abs(vectors).max(initial=0.0) or 1.0)  # squares stay finite
        long = (vectors.astype(np.float64) ** 2).sum(1)
        scale = np.sqrt(long.max()) if len(long) else 1.0
        rest = np.sqrt(np.maximum(0, scale**2 - long))
        return (np.concatenate([vectors, rest[:, None]], 1) / (scale or 1)).astype(np.float32)

    @classmethod
    def build(cls, vectors: np.ndarray, degree: int = 16, beam: int = 64, seed: int = 1, block: int = 512) -> Graph:
        """Layers from the top down: layer 0 holds all rows with 2 * degree neighbours, each higher one about 1/degree of the last."""
        graph = cls(vectors, [])
        n = len(vectors)
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(degree)).astype(int)
        members = [np.arange(n)]
        while len(members[-1]) > block:
            members.append(np.flatnonzero(level >= len(members)))
            if not len(members[-1]):
                members.pop()
                break
        for depth in range(len(members) - 1, -1, -1):
            graph.layers.insert(0, graph._grow(members[depth], 2 * degree if depth == 0 else degree, beam, block))
        graph.entries = graph._entries()
        return graph

    def _entries(self) -> np.ndarray:
        """Nodes from which, together, every node of the lowest layer can be reached: the first row, and one of each part that the others miss."""
        near = self.layers[0].near
        found, reached, at = [], np.zeros(len(near), bool), 0
        while at < len(near):
            found.append(at)
            front = np.array([at])
            while len(front):
                reached[front] = True
                to = np.unique(near[front])
                front = to[(to >= 0) & ~reached[np.maximum(to, 0)]]
            at += int(np.argmin(reached[at:])) if not reached[at:].all() else len(near)
        return np.array(found)

    def _enter(self, q: np.ndarray, below: int = 0) -> np.ndarray | None:
        """For each query the best node found by going down the layers above ``below``."""
        at = None
        for layer in reversed(self.layers[below:]):
            start = np.zeros((len(q), 1), int) if at is None else np.searchsorted(layer.nodes, at)
            got, _ = search_layer(self.x[layer.nodes], layer.near, q, start, 4, 1)
            at = layer.nodes[got[:, :1]]
        return at

    def _grow(self, nodes: np.ndarray, degree: int, beam: int, block: int) -> Layer:
        x = self.x[nodes]
        n = len(nodes)
        near = np.full((n, degree), -1)
        order = np.random.default_rng(2).permutation(n)
        put = np.zeros(n, bool)
        upper = self.layers
        for a in range(0, n, block):
            new = order[a : a + block]
            sim_own = x[new] @ x[new].T
            np.fill_diagonal(sim_own, -np.inf)
            c = min(beam, len(new) - 1) if len(new) > 1 else 0
            cand, sim = np.full((len(new), 0), -1), np.zeros((len(new), 0), np.float32)
            if c:
                top = np.argpartition(-sim_own, c - 1, axis=1)[:, :c]
                cand, sim = new[top], np.take_along_axis(sim_own, top, 1)
            if a:
                first = int(order[0])
                start = np.full((len(new), 1), first)
                if upper:
                    found = np.searchsorted(nodes, self._enter(x[new]))
                    start = np.concatenate([np.where(put[found], found, first), start], 1)
                got, s = search_layer(x, near, x[new], start, beam)
                cand, sim = np.concatenate([cand, got], 1), np.concatenate([sim, s], 1)
                top = np.argsort(-sim, axis=1, kind="stable")[:, : beam + beam // 2]
                cand, sim = np.take_along_axis(cand, top, 1), np.take_along_axis(sim, top, 1)
            if not cand.shape[1]:
                put[new] = True
                continue
            near[new] = _diverse(x, new, cand, sim, degree)
            put[new] = True
            self._back(x, near, new, degree)
        return Layer(nodes, near)

    @staticmethod
    def _back(x: np.ndarray, near: np.ndarray, new: np.ndarray, degree: int) -> None:
        """Put the new nodes into their neighbours' lists, which keep their most useful ``degree`` entries."""
        r, c = np.nonzero(near[new] >= 0)
        src, dst = new[r], near[new[r], c]
        order = np.lexsort((src, dst))
        src, dst = src[order], dst[order]
        first = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
        for a in range(0, len(first), 1024):
            part = first[a : a + 1024]
            ends = np.r_[first, len(dst)][a + 1 : a + 1 + len(part)]
            width = int((ends - part).max())
            more = np.full((len(part), width), -1)
            k = np.arange(width)
            inside = part[:, None] + k < ends[:, None]
            more[inside] = src[(part[:, None] + k)[inside]]
            own = dst[part]
            both = np.concatenate([near[own], more], 1)
            s = np.where(both >= 0, np.einsum("ijk,ik->ij", x[np.maximum(both, 0)], x[own]), -np.inf).astype(np.float32)
            twice = (more[:, :, None] == near[own][:, None, :]).any(2) & (more >= 0)
            both[:, near.shape[1] :][twice] = -1
            s[:, near.shape[1] :][twice] = -np.inf
            if both.shape[1] > 3 * degree:
                top = np.argpartition(-s, 3 * degree - 1, axis=1)[:, : 3 * degree]
                both, s = np.take_along_axis(both, top, 1), np.take_along_axis(s, top, 1)
            near[own] = _diverse(x, own, both, s, degree)

    def search(self, queries: np.ndarray, k: int, beam: int, block: int = 256) -> np.ndarray:
        """The k best rows found for each query, -1 where there are fewer."""
        out = np.full((len(queries), k), -1)
        small = queries / np.maximum(np.abs(queries).max(1, initial=0.0, keepdims=True), np.finfo(np.float64).tiny)
        long = np.sqrt((small.astype(np.float64) ** 2).sum(1, keepdims=True))
        q = np.concatenate([small / np.where(long > 0, long, 1), np.zeros((len(queries), 1))], 1).astype(np.float32)
        base = self.layers[0]
        for a in range(0, len(q), block):
            part = q[a : a + block]
            at = self._enter(part, 1)
            start = np.repeat(self.entries[None], len(part), 0)
            start = start if at is None else np.concatenate([at, start], 1)
            ids, _ = search_layer(self.x, base.near, part, start, min(max(beam, k), len(self.x)))
            out[a : a + block, : min(k, ids.shape[1])] = ids[:, :k]
        return out

    def beam_for(self, k: int, least: float = 0.97, beam: int = 160, sample: int = 128) -> int:
        """``beam`` doubled until the k best found for a sample of rows are ``least`` of those that comparing with all rows finds.

        At a beam of all rows every row is reached, so this ends.
        """
        n = len(self.x)
        k = min(k, n)
        some = self.vectors[np.sort(np.random.default_rng(3).permutation(n)[:sample])].astype(np.float64)
        scores = some @ self.vectors.astype(np.float64).T
        last = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        bar = last - 1e-6 * np.abs(last)  # the graph compares in single precision
        while beam < n:
            found = self.search(some, k, beam)
            if ((np.take_along_axis(scores, np.maximum(found, 0), 1) >= bar) & (found >= 0)).mean() >= least:
                break
            beam *= 2
        return beam

    def flat(self) -> dict[str, bytes]:
        """The layers as flat arrays of 32-bit integers: sizes and degrees, nodes, neighbours."""
        head = np.array([n for y in self.layers for n in y.near.shape], "<i4")
        return {"shape": head.tobytes(), "nodes": np.concatenate([y.nodes for y in self.layers]).astype("<i4").tobytes(), "near": np.concatenate([y.near.reshape(-1) for y in self.layers]).astype("<i4").tobytes(), "entries": self.entries.astype("<i4").tobytes()}

    @classmethod
    def load(cls, vectors: np.ndarray, shape: bytes, nodes: bytes, near: bytes, entries: bytes) -> Graph:
        sizes = np.frombuffer(shape, "<i4").reshape(-1, 2).tolist()
        own, to, layers, i, j = np.frombuffer(nodes, "<i4"), np.frombuffer(near, "<i4"), [], 0, 0
        for n, d in sizes:
            layers.append(Layer(own[i : i + n].astype(int), to[j : j + n * d].reshape(n, d).astype(int)))
            i, j = i + n, j + n * d
        return cls(vectors, layers, np.frombuffer(entries, "<i4").astype(int))


INDEX = "shard int, n int, vectors binary, counts binary, ids binary, shape binary, nodes binary, near binary, entries binary, beam int"


def build_index(vectors: DataFrame, k: int, shard_rows: int = 16_384, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = 160, recall: float = 0.97) -> tuple[DataFrame, DataFrame, int, str]:
    """(index, usable rows (id, v), number of shards, numpy type of the vectors): one index row per shard with its graph as flat arrays.

    Every distinct vector is indexed, with its k + 1 smallest ids: of equal vectors no other
    can be among the k nearest of any query, ties going to smaller ids. Each graph's beam is
    widened from ``beam`` until it has ``recall`` on a sample of its rows. Vectors of floats
    are kept as such, all others as doubles.
    """
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    item, kind = ("float", "<f4") if single else ("double", "<f8")
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{item}>").alias("v"))
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists("v", lambda e: e != 0)
    raw = raw.where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    widths = raw.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    width = widths[0].d if widths else 1
    usable = raw.where(F.size("v") == width).distinct()
    w = Window.partitionBy("v").orderBy("id")
    distinct = usable.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = stored(distinct, "vectors")
    shards = max(1, -(-distinct.count() // shard_rows))

    def build(key: tuple, t: pa.Table) -> pa.Table:
        lists = t.column("ids").to_pylist()
        x = np.array(t.column("v").combine_chunks().flatten(), kind).reshape(len(lists), width)
        order = sorted(range(len(lists)), key=lambda i: lists[i])
        x, lists = np.ascontiguousarray(x[order]), [lists[i] for i in order]
        graph = Graph.build(x)
        row = {"shard": key[0].as_py(), "n": len(lists), "vectors": x.tobytes(), "counts": np.array([len(i) for i in lists], "<i4").tobytes(), "ids": np.concatenate(lists).astype("<i8").tobytes(), "beam": graph.beam_for(k + 1, recall, beam)} | graph.flat()
        return pa.Table.from_pylist([row], schema=pa.schema([("shard", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("vectors", "counts", "ids", "shape", "nodes", "near", "entries")), ("beam", pa.int32())]))

    keyed = distinct.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")).select("shard", "v", "ids")
    return stored(keyed.groupBy("shard").applyInArrow(build, INDEX), "graphs"), usable, shards, kind


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, beam: int = 160, recall: float = 0.97, shard_rows: int = 16_384, block: int = 2048, lanes: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for every row whose id is divisible by ``every``.

    Nearness is the inner product in double precision; ties go to the smaller id. A query
    is searched in every shard's graph, with a beam that has found ``recall`` of the k + 1
    nearest of a sample of the shard's rows, and the shards' best are merged. A shard's graph is
    loaded by ``lanes`` tasks at most, past which the queries stream in blocks. Null, zero and
    non-finite vectors, vectors of another length than most, and rows without an id take no
    part. Repeated rows count once; a row with the query's id isn't its neighbour; of a query
    id with several vectors the smallest is searched. With k or fewer candidates all are
    returned; an empty table gives no rows; other columns aren't read.
    """
    index, usable, shards, kind = build_index(vectors, k, shard_rows, id_col, vector_col, beam, recall)
    queries = usable.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    queries = checkpointed(queries)
    blocks = max(1, -(-queries.count() // block))
    lanes = min(lanes, blocks)

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        x = np.array(t.column("v").combine_chunks().flatten(), kind)
        return pa.Table.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([np.array(t.column("id"), "<i8").tobytes()], pa.binary()), "vectors": pa.array([x.tobytes()], pa.binary())})

    packed = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).select("block", "id", "v").groupBy("block").applyInArrow(pack, "block int, ids binary, vectors binary")
    graphs = index.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).withColumn("block", F.lit(-1))
    asked = packed.withColumn("lane", F.col("block") % lanes).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    tasks = max(2000, 4 * vectors.sparkSession.sparkContext.defaultParallelism)
    both = graphs.unionByName(asked, allowMissingColumns=True).repartition(min(shards * lanes, tasks), "shard", "lane").sortWithinPartitions("shard", "lane", "block")
    names = ["n", "vectors", "counts", "ids", "shape", "nodes", "near", "entries", "beam", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = counts = ids = first = beam = None
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            if row["block"] < 0:  # the shard's graph comes before its queries
                x = np.frombuffer(row["vectors"], kind).reshape(row["n"], -1)
                graph = Graph.load(x, row["shape"], row["nodes"], row["near"], row["entries"])
                beam = row["beam"]
                counts, ids = np.frombuffer(row["counts"], "<i4"), np.frombuffer(row["ids"], "<i8")
                first = np.cumsum(counts) - counts
                continue
            q_id, q = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], kind).reshape(-1, graph.vectors.shape[1])
            got = graph.search(q, k + 1, beam)
            r, c = np.nonzero(got >= 0)
            at = got[r, c]
            score = np.einsum("ij,ij->i", q[r].astype(np.float64), graph.vectors[at].astype(np.float64))
            m = counts[at]
            r, score = np.repeat(r, m), np.repeat(score, m)
            member = ids[np.arange(m.sum()) + np.repeat(first[at] - np.cumsum(m) + m, m)]
            other = member != q_id[r]
            r, score, member = r[other], score[other], member[other]
            order = np.lexsort((member, -score, r))
            r, score, member = r[order], score[order], member[order]
            start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
            rank = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
            keep = rank < k
            yield pa.RecordBatch.from_arrays([pa.array(q_id[r[keep]]), pa.array(member[keep]), pa.array(score[keep])], ["query_id", "vec_id", "score"])

    found = both.select(*names).mapInArrow(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
