"""Benchmark decontamination by pigeonhole edit matching over words."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_rows, slices, stored, utf8

#: words are runs of 0-9, a-z and anything beyond ASCII, after lower-casing
_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(_TABLE).split()


def myers(peq: dict[int, int], m: int, text: list[int]) -> tuple[int, int]:
    """Smallest edit distance between the pattern and any run of ``text``, and the first end of such a run (bit-parallel)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full  # a match may begin anywhere: row zero stays 0
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """Items as word numbers, cut into error budget + 1 pieces whose hashes are looked up in texts.

    An item of m words allows floor((1 - similarity) · m) edits of words. Of that many
    pieces plus one, a passage within the budget holds one unchanged. A short item allows no
    edit and is one piece; one without words takes no part.
    """

    def __init__(self, items: list[tuple[int, bytes]], similarity: float):
        self.ids: dict[bytes, int] = {}
        self.items: list[tuple[list[int], list[int], int, dict[int, int]]] = []
        same: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for item, text in items:
            ws = words(text)
            if ws:
                same[tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in ws)].append(item)
        pieces: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, (seq, owners) in enumerate(sorted(same.items())):
            m = len(seq)
            budget = math.floor((1 - similarity) * m + 1e-9)
            peq: dict[int, int] = defaultdict(int)
            for i, c in enumerate(seq):
                peq[c] |= 1 << i
            self.items.append((sorted(owners), list(seq), budget, dict(peq)))
            cuts = [m * i // (budget + 1) for i in range(budget + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                pieces[b - a][int(self.hashes(np.array(seq[a:b], np.uint64), b - a)[0])].append((k, a))
        self.pieces = {n: (np.array(sorted(d), np.uint64), dict(d)) for n, d in pieces.items()}

    @staticmethod
    def hashes(x: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hash of the n words from each place ``at``."""
        at = np.arange(len(x) - n + 1) if at is None else at
        h = np.zeros(len(at), np.uint64)
        for i in range(n):
            h = (h ^ x[at + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def matches(self, ws: list[bytes]) -> list[tuple[int, int, int]]:
        """(item, distance, word at which the best match ends) of all items in a text."""
        get = self.ids.get
        x = np.fromiter((get(w, 0) for w in ws), np.uint64, len(ws))
        known = x > 0
        starts: dict[int, set[int]] = defaultdict(set)
        run, n = known, 1
        for size in sorted(self.pieces):
            while n < size:
                run = run[:-1] & known[n:]
                n += 1
            at = np.flatnonzero(run)
            if len(x) < size or not len(at):
                break
            table, owners = self.pieces[size]
            h = self.hashes(x, size, at)
            i = np.minimum(np.searchsorted(table, h), len(table) - 1)
            for p, key in zip(at[table[i] == h].tolist(), h[table[i] == h].tolist(), strict=True):
                for k, q in owners[key]:
                    starts[k].add(p - q)
        found = []
        for k, offsets in starts.items():
            own, seq, budget, peq = self.items[k]
            m, best, end, at = len(seq), budget + 1, 0, sorted(offsets)
            i = 0
            while i < len(at):
                j = i
                while j + 1 < len(at) and at[j + 1] - at[j] <= m + 2 * budget:
                    j += 1
                lo = max(0, at[i] - budget)
                d, e = myers(peq, m, x[lo : at[j] + m + budget].tolist())
                if d < best:
                    best, end = d, lo + e
                i = j + 1
            if best <= budget:
                found += [(item, best, end) for item in own]
        return sorted(found)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", similarity: float = 0.8, block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, distance (words changed, put in or left out) and end_word of every benchmark item that stands in a document.

    A passage matches within floor((1 - similarity) · words) edits; case and punctuation
    don't count. Short items must stand there unchanged; null items, those without words and
    null texts match nothing; the rows of an item without an id have none. Items with equal
    words each get their rows, and repeated documents too. The benchmark is a stated query
    set: its size is measured, and tasks get blocks of at most about ``block_chars`` of it, a
    pass over ``docs`` each, whose rows are written before the next block is read. An empty
    table on either side gives no rows; other columns aren't read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for block, last in _blocks(benchmark, item_col, text_col, block_chars):
        passed = _leaks(own, block, similarity)
        if out is not None or not last:
            passed = stored(passed, "leaks")
        out = passed if out is None else out.unionByName(passed)
    return out


def _blocks(benchmark: DataFrame, item_col: str | None, text_col: str, block_chars: int) -> Iterator[tuple[list[tuple[int | None, bytes]], bool]]:
    """The benchmark in blocks of about ``block_chars``, one at a time on the driver, and whether it is the last; one empty block if there is nothing."""
    item = F.lit(None) if item_col is None else F.col(item_col)
    items = benchmark.select(item.cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    blocks = 1 + (items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars
    for block in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        yield [(r.item, r.text.encode()) for r in own.collect()], block + 1 == blocks


def _leaks(own: DataFrame, items: list[tuple[int | None, bytes]], similarity: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher([(k, text) for k, (_, text) in enumerate(items)], similarity)
        for batch in slices(batches, 1000):
            rows = [(doc, items[k][0], d, end) for doc, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True) for k, d, end in matcher.matches(words(t))]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "distance", "end_word"])

    return own.mapInArrow(run, "doc_id long, item_id long, distance long, end_word long")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", similarity: float = 0.8, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark item stands; matches and blocks as in ``leaks``, whatever the items' ids."""
    for block, last in _blocks(benchmark, None, text_col, block_chars):
        docs = _clean(docs, block, text_col, similarity)
        if not last:
            docs = stored(docs, "clean")
    return docs


def _clean(docs: DataFrame, items: list[tuple[int | None, bytes]], text_col: str, similarity: float) -> DataFrame:
    held: list[Matcher] = []

    def keep(texts: list[bytes], _: list[bool]) -> list[bool]:
        if not held:
            held.append(Matcher([(k, text) for k, (_, text) in enumerate(items)], similarity))
        return [not held[0].matches(words(t)) for t in texts]

    return kept_rows(docs, text_col, F.lit(True), keep)
