"""Ranked lexical search: a max tree over document ranges per term, descended by best-first branch and bound."""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_group, found_in, slices, stored, utf8

#: separators become spaces and A-Z lower case; what is left between spaces are the terms
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: children of a node, and levels between a shard's root and its documents
FAN, LEVELS = 16, 3
SHARD_DOCS = FAN**LEVELS
#: a shard of documents in consecutive rows, a term, and by ``docs`` (numbers in the shard) its impacts; ``low`` and
#: ``high`` are the nodes above them, of 16 and 256 documents, with their maxima. The term '' holds the shard's ids
INDEX = "shard long, term string, docs binary, impacts binary, low binary, low_tops binary, high binary, high_tops binary, top long"


def terms(text: bytes, step: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text, about ``step`` bytes of it at a time."""
    at = 0
    while at < len(text):
        to = at + step
        part = text[at:to].translate(TERMS)
        while to < len(text) and TERMS[text[to]] != 32:  # up to the end of the term
            more = text[to : to + step].translate(TERMS)
            end = more.find(b" ")
            part += more if end < 0 else more[:end]
            to += len(more) if end < 0 else end
            if end >= 0:
                break
        yield part.split()
        at = to


def frequencies(text: bytes) -> Counter[bytes]:
    out: Counter[bytes] = Counter()
    for part in terms(text):
        out.update(part)
    return out


def statistics(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(N, L): the documents with a term, and the terms of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in slices(batches, 200, "text"):
            for text in utf8(batch.column(0)):
                own = sum(len(part) for part in terms(text))
                n, total = n + (own > 0), total + own
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["n", "total"])

    got = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return got.n or 0, got.total or 0


class ShardBuilder:
    """Collects documents and gives their index rows."""

    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.clear()

    def clear(self) -> None:
        self.vocabulary: dict[bytes, int] = defaultdict(count().__next__)
        self.ids: list[int | None] = []
        self.size = 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, doc_id: int | None, text: bytes) -> None:
        found = frequencies(text)
        if not found:
            return
        m = 100 - 25 + 25 * found.total() * self.n_docs // self.n_terms
        tf = np.fromiter(found.values(), np.int64, len(found))
        of = np.fromiter(map(self.vocabulary.__getitem__, found), np.int64, len(found))
        self.parts.append((of << 16 | len(self.ids), 1_000_000_000 * tf // (1000 * tf + 12 * m)))
        self.ids.append(doc_id)
        self.size += len(text)

    def rows(self, shard: int) -> pa.RecordBatch:
        key = np.concatenate([k for k, _ in self.parts])
        order = np.argsort(key)
        key, impact = key[order], np.concatenate([v for _, v in self.parts])[order]
        columns, n = [], len(self.vocabulary)
        for up in range(LEVELS):  # documents, then the nodes above
            per = np.bincount(key >> 16, minlength=n)
            columns += [_cells(per, (key & 0xFFFF).astype("<u2")), _cells(per, impact.astype("<u4"))]
            key, first = np.unique((key >> 16) << 16 | (key & 0xFFFF) // FAN, return_index=True)
            impact = np.maximum.reduceat(impact, first)
        names = pa.array([t.decode() for t in self.vocabulary], pa.string())
        out = pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), names, *columns, pa.array(impact)], INDEX_NAMES)
        missing = np.array([i is None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], "<i8")
        own = {"shard": [shard], "term": [""], "docs": [ids.tobytes()], "impacts": [missing.tobytes()]} | {c: [b""] for c in INDEX_NAMES[4:8]} | {"top": [0]}
        return pa.Table.from_batches([out, pa.RecordBatch.from_pydict(own, out.schema)]).combine_chunks().to_batches()[0]


INDEX_NAMES = [c.split()[0] for c in INDEX.split(", ")]


def _cells(per: np.ndarray, values: np.ndarray) -> pa.Array:
    """A binary column whose cells hold ``per`` values each, without copying them one by one."""
    ends = np.r_[0, np.cumsum(per * values.itemsize)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(per), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def build_index(docs: DataFrame, n_docs: int, n_terms: int, only: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 8 << 20) -> DataFrame:
    """The index of ``docs``, of the terms of the stored table ``only`` (term) if given; built where rows lie, texts aren't shuffled.

    A shard has at most 4096 documents and, but for its last one, ``shard_bytes`` of text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = count(TaskContext.get().partitionId() << 32)
        builder = ShardBuilder(n_docs, n_terms)
        for batch in slices(batches, 200, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                builder.add(doc_id, text)
                if len(builder.ids) == SHARD_DOCS or builder.size >= shard_bytes:
                    yield from slices(iter([builder.rows(next(shards))]), 20_000)
                    builder.clear()
        if builder.ids:
            yield from slices(iter([builder.rows(next(shards))]), 20_000)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    index = own.mapInArrow(run, INDEX)
    return stored(index if only is None else found_in(index, only, ["term"]), "postings")


class Shard:
    """One shard's trees, of the terms that have a number in ``number``."""

    def __init__(self, t: pa.Table, number: dict[str, int]):
        names = t.column("term").to_pylist()
        at = names.index("")
        self.ids = np.frombuffer(t.column("docs")[at].as_py(), "<i8")
        self.missing = np.frombuffer(t.column("impacts")[at].as_py(), np.uint8)
        rows = sorted((number[name], i) for i, name in enumerate(names) if name in number)
        self.terms = np.array([k for k, _ in rows], np.int64)
        t = t.take(pa.array([i for _, i in rows], pa.int64()))
        self.top = t.column("top").to_numpy()
        self.levels = [self._level(t, *c) for c in (("high", "high_tops"), ("low", "low_tops"), ("docs", "impacts"))]

    def _level(self, t: pa.Table, nodes: str, values: str) -> tuple[np.ndarray, np.ndarray]:
        cells = t.column(nodes).to_pylist()
        node = np.frombuffer(b"".join(cells), "<u2").astype(np.int64)
        term = np.repeat(np.arange(len(cells)), [len(c) // 2 for c in cells])
        return term << 16 | node, np.frombuffer(b"".join(t.column(values).to_pylist()), "<u4").astype(np.int64)

    def below(self, level: int, node: int, own: np.ndarray, weights: np.ndarray) -> list[int]:
        """The summed bounds (for documents: scores) of a node's children."""
        keys, values = self.levels[level]
        lo = np.searchsorted(keys, own << 16 | node * FAN)
        n = np.searchsorted(keys, own << 16 | (node + 1) * FAN) - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        out = np.zeros(FAN, np.int64)
        np.add.at(out, keys[at] & (FAN - 1), values[at] * np.repeat(weights, n))
        return out.tolist()

    def search(self, own: np.ndarray, weights: np.ndarray, bound: int, best: list[tuple[int, int, int]], k: int) -> int:
        """Brings ``best`` (score negated, whether the id is null, id; sorted, at most ``k``) up to date; returns the nodes opened.

        The node with the highest summed bound is opened next. A bound that only equals the
        k-th score is opened too: of equal scores smaller ids come first.
        """
        queue, opened = [(-bound, 0, 0)], 0
        while queue and (len(best) < k or queue[0][0] <= best[-1][0]):
            _, level, node = heapq.heappop(queue)
            opened += 1
            for child, value in enumerate(self.below(level, node, own, weights), node * FAN):
                if value <= 0 or (len(best) == k and -value > best[-1][0]):
                    continue
                if level + 1 < LEVELS:
                    heapq.heappush(queue, (-value, level + 1, child))
                else:
                    insort(best, (-value, int(self.missing[child]), int(self.ids[child])))
                    del best[k:]
        return opened


class Questions:
    """A block of items as arrays: each item's terms, and their weights times their repeats."""

    def __init__(self, items: list[tuple[int | None, Counter[bytes]]], df: dict[str, int], n_docs: int):
        self.item_ids = [i for i, _ in items]
        names = sorted({t.decode() for _, found in items for t in found} & df.keys())
        self.number = {t: k for k, t in enumerate(names)}
        weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in names]
        rows = [sorted((self.number[t.decode()], n) for t, n in found.items() if t.decode() in self.number) for _, found in items]
        self.ends = np.cumsum([0, *(len(r) for r in rows)])
        self.terms = np.array([t for r in rows for t, _ in r], np.int64)
        self.weights = np.array([weight[t] * n for r in rows for t, n in r], np.int64)

    def search(self, shard: Shard, best: list[list[tuple[int, int, int]]], k: int) -> None:
        top, place = np.zeros(len(self.number), np.int64), np.full(len(self.number), -1)
        top[shard.terms], place[shard.terms] = shard.top, np.arange(len(shard.terms))
        total = np.r_[0, np.cumsum(top[self.terms] * self.weights)]
        bounds = total[self.ends[1:]] - total[self.ends[:-1]]
        for i in np.flatnonzero(bounds > 0).tolist():
            if len(best[i]) < k or -int(bounds[i]) <= best[i][-1][0]:
                own = place[self.terms[self.ends[i] : self.ends[i + 1]]]
                shard.search(own[own >= 0], self.weights[self.ends[i] : self.ends[i + 1]][own >= 0], int(bounds[i]), best[i], k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = 1_000_000) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` highest-scoring documents of every item.

    Terms, weights and scores: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), its impact
    on a document 10⁹ tf div (1000 tf + 12 m) with m = 75 + 25 n N div L; a score sums weight times
    impact over the item's terms, repeats included. Equal scores go to the smaller id.

    The index holds, for each shard of consecutive documents and each term of an item, the
    impacts and their maxima over ranges of 16, 256 and 4096 documents. A task keeps every item's
    best so far over all its shards, so a shard whose root is below them isn't opened; the tasks'
    best are merged. Items are a stated query set, read in blocks of about ``block_chars``, which
    tasks get whole; a block's rows are written before the next is read.

    Null texts have no terms, on either side; documents without a term of the item have score 0 and
    aren't returned. Repeated documents are documents of their own, null ids come last among equal
    scores. Repeated items and items without an id each get their rows. Empty tables give no rows;
    other columns aren't read.
    """
    n_docs, n_terms = statistics(docs, text_col)
    spark = docs.sparkSession
    if not n_terms:
        return spark.createDataFrame([], RANKED)
    asked = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000, "text"):
            found: set[bytes] = {b""}
            for text in utf8(batch.column(0)):
                found.update(frequencies(text))
            yield pa.RecordBatch.from_arrays([pa.array([t.decode() for t in found], pa.string())], ["term"])

    only = stored(asked.select("text").mapInArrow(words, "term string").distinct(), "terms")
    index = build_index(docs, n_docs, n_terms, only, id_col, text_col)
    df = stored(index.where("term <> ''").groupBy("term").agg(F.sum(F.octet_length("docs") / 2).cast("long").alias("df")), "frequencies")
    blocks = 1 + (asked.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars
    out = None
    for block in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        found = [(r.item, frequencies(r.text.encode())) for r in own.collect()]
        mine = sorted({t.decode() for _, c in found for t in c} | {""})
        some = spark.createDataFrame([(t,) for t in mine], "term string")
        rows, counts = (index, df) if blocks == 1 else (index.join(F.broadcast(some), "term", "left_semi"), df.join(F.broadcast(some), "term", "left_semi"))
        passed = _best(rows, Questions(found, {r.term: r.df for r in counts.collect()}, n_docs), k)
        passed = passed if blocks == 1 else stored(passed, "ranked")
        out = passed if out is None else out.unionByName(passed)
    return out


RANKED = "item_id long, rank int, doc_id long, score long"


def _best(index: DataFrame, questions: Questions, k: int) -> DataFrame:
    sent = index.sparkSession.sparkContext.broadcast(questions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        best: list[list[tuple[int, int, int]]] = [[] for _ in asked.item_ids]
        for t in by_group(batches, ["shard"], 10_000):
            own = t.column("shard").to_numpy()
            for shard in np.unique(own):
                at = np.flatnonzero(own == shard)
                asked.search(Shard(t.slice(at[0], len(at)), asked.number), best, k)
        rows = [(i, asked.item_ids[i], None if missing else doc, -score) for i, found in enumerate(best) for score, missing, doc in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["row", "item_id", "doc_id", "score"])

    found = index.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "row long, item_id long, doc_id long, score long")
    w = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
