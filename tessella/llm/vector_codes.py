"""Product codes of vectors: integer codebooks by Yinyang Lloyd rounds, one lower bound per group of entries."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, stored

#: components within this bound have squared distances, of up to 256 components, that fit in 64 bits; larger ones are Python integers
SAFE = 1 << 26
#: bounds are kept in single precision: this share, many times what rounding can lose, is added to or taken from them
SLACK = 1e-5
SUMS = "part int, entry int, place int, n long, total decimal(38,0)"


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 x), as Python integers where 64 bits aren't safe."""
    y = np.floor(x.astype(np.float64) * 256)
    if not y.size or np.abs(y).max() <= SAFE:
        return y.astype(np.int64)
    return np.array([math.floor(e * 256) if abs(e) < 1e300 else int(e) * 256 for e in x.astype(np.float64).ravel().tolist()], object).reshape(x.shape)


def cuts(width: int, parts: int) -> list[int]:
    """Where the parts of a vector begin, and its end; where they can't be equal the first ones are longer by one."""
    size, more = divmod(width, parts)
    return [p * size + min(p, more) for p in range(parts + 1)]


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of ``x`` to each entry."""
    d = x[:, None, :] - entries[None, :, :]
    return (d * d).sum(axis=2)


def grouped(entries: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each entry: a small clustering of the entries, begun from evenly spaced ones."""
    e = entries.astype(np.float64)
    centres = e[np.linspace(0, len(e) - 1, min(groups, len(e))).astype(int)]
    for _ in range(rounds):
        of = ((e[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in np.unique(of):
            centres[g] = e[of == g].mean(axis=0)
    return np.unique(of, return_inverse=True)[1]


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK)


def _down(x: np.ndarray) -> np.ndarray:
    return x * np.where(x < 0, 1 + SLACK, 1 - SLACK)


def _others(d: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A lower bound on each row's distance to any entry but its own; infinite if there is no other."""
    out = _root(d)
    out[own] = np.inf
    return _down(out.min(axis=1))


class Book:
    """One part's codebook: entries, their groups, and how far each entry has moved since the last assignment."""

    def __init__(self, entries: np.ndarray, groups: np.ndarray, drift: np.ndarray | None = None):
        self.entries, self.groups = entries, groups
        self.drift = np.zeros(len(entries)) if drift is None else drift
        self.members = [np.flatnonzero(groups == g) for g in range(int(groups.max()) + 1)]
        self.most = np.array([self.drift[m].max() for m in self.members])

    def moved(self, entries: np.ndarray) -> Book:
        return Book(entries, self.groups, _up(_root(((entries - self.entries) ** 2).sum(axis=1))))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """own (the nearest entry), its squared distance, an upper bound on its distance and a lower bound per group on all others, by looking at every entry."""
        d = squared(x, self.entries)
        own = d.argmin(axis=1)  # the first of equal ones
        best = d[np.arange(len(x)), own]
        lower = np.stack([_others(d[:, m], m[None, :] == own[:, None]) for m in self.members], axis=1)
        return own, best, _up(_root(best)), lower

    def reassign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """The same from the last assignment's result, and the number of (row, group) scans.

        Bounds drift by as much as entries moved. A row whose upper bound is below all its lower
        bounds keeps its entry. Otherwise its own distance is measured and groups are scanned
        whose bound isn't above it, from the least bound on. Entries are compared by integers,
        equal ones by index, so a bound that is just met is scanned as well.
        """
        rows = np.arange(len(x))
        start, own = own, own.copy()
        upper, lower = _up(upper + self.drift[own]), _down(lower - self.most)
        best = ((x - self.entries[own]) ** 2).sum(axis=1)
        start_best = best.copy()
        doubt = np.flatnonzero(upper >= lower.min(axis=1))
        upper[doubt] = _up(_root(best[doubt]))
        bound = lower.copy()
        scanned = []
        for g_of in np.argsort(bound[doubt], axis=1, kind="stable").T:
            fails = bound[doubt, g_of] <= upper[doubt]
            for g in np.unique(g_of[fails]).tolist():
                at, members = doubt[fails & (g_of == g)], self.members[g]
                d = squared(x[at], self.entries[members])
                near = d.argmin(axis=1)
                got, entry = d[np.arange(len(at)), near], members[near]
                better = (got < best[at]) | ((got == best[at]) & (entry < own[at]))
                own[at[better]], best[at[better]] = entry[better], got[better]
                upper[at[better]] = _up(_root(got[better]))
                scanned.append((g, at, d))
        # an entry given up bounds its group, unless the scan of that group says more
        left = rows[own != start]
        lower[left, self.groups[start[left]]] = np.minimum(lower[left, self.groups[start[left]]], _down(_root(start_best[left])))
        for g, at, d in scanned:
            lower[at, g] = _others(d, self.members[g][None, :] == own[at][:, None])
        return own, best, upper, lower, sum(len(at) for _, at, _ in scanned)


def _array(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


class Coder:
    """All parts' codebooks, and the rows' bounds packed into bytes."""

    def __init__(self, books: list[Book], width: int):
        self.books, self.width = books, width
        self.cut = cuts(width, len(books))
        self.kind = np.dtype([("own", "u1", len(books)), ("upper", "<f4", len(books)), ("lower", "<f4", sum(len(b.members) for b in books))])

    def code(self, v: np.ndarray, state: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
        """States and the sum of squared distances of each row, from all entries or from the last states."""
        before = None if state is None else np.frombuffer(b"".join(state), self.kind)
        out, error, at = np.zeros(len(v), self.kind), 0, 0
        for p, book in enumerate(self.books):
            x = whole(v[:, self.cut[p] : self.cut[p + 1]])
            to = at + len(book.members)
            if before is None:
                own, best, upper, lower = book.assign(x)
            else:
                own, best, upper, lower, _ = book.reassign(x, before["own"][:, p].astype(np.int64), before["upper"][:, p].astype(np.float64), before["lower"][:, at:to].astype(np.float64))
            out["own"][:, p], out["upper"][:, p], out["lower"][:, at:to] = own, upper, lower
            error, at = error + best, to
        return out, error + np.zeros(len(v), np.int64)

    def sums(self, v: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(part, entry, place in the part, number of rows, their sum)."""
        for p in range(len(self.books)):
            x = whole(v[:, self.cut[p] : self.cut[p + 1]])
            order = np.argsort(own[:, p], kind="stable")
            entries, first, n = np.unique(own[order, p], return_index=True, return_counts=True)
            for e, m, total in zip(entries.tolist(), n.tolist(), np.add.reduceat(x[order], first, axis=0).tolist(), strict=True):
                yield from ((p, e, k, m, t) for k, t in enumerate(total))


def _states(rows: DataFrame, coder: Coder, first: bool) -> DataFrame:
    """``rows`` (vec_id, label, v) with their states, assigned afresh or from the states they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            state, _ = coder.code(_array(batch.column("v"), coder.width), None if first else batch.column("state").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "v")), pa.array([s.tobytes() for s in state], pa.binary())], ["vec_id", "label", "v", "state"])

    kind = rows.schema["v"].dataType.simpleString()
    return stored(rows.mapInArrow(run, f"vec_id long, label string, v {kind}, state binary"), "states")


def _codes(rows: DataFrame, coder: Coder, first: bool) -> DataFrame:
    """vec_id, label, code and error of ``rows`` after the last assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            state, error = coder.code(_array(batch.column("v"), coder.width), None if first else batch.column("state").to_pylist())
            code = [s.tobytes().hex() for s in state["own"]]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error.tolist(), pa.int64())], ["vec_id", "label", "code", "error"])

    return stored(rows.mapInArrow(run, "vec_id long, label string, code string, error long"), "codes")


def _averaged(states: DataFrame, coder: Coder) -> list[Book]:
    """The books after each entry was replaced by the floor of its parts' mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], list[int]] = {}
        for batch in slices(batches, 20_000):
            own = np.frombuffer(b"".join(batch.column("state").to_pylist()), coder.kind)["own"]
            for p, e, k, m, t in coder.sums(_array(batch.column("v"), coder.width), own):
                held = total.setdefault((p, e, k), [0, 0])
                held[0] += m
                held[1] += t
        rows = [(*key, *held) for key, held in total.items()]
        if rows:
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["part", "entry", "place", "n", "total"])

    sums = states.select("v", "state").mapInArrow(run, SUMS).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    entries = [b.entries.astype(object) for b in coder.books]
    for r in sums.collect():  # as many as the codebooks have components
        entries[r.part][r.entry, r.place] = int(r.total) // r.n
    held = [e.astype(np.int64) if max((abs(c) for c in e.ravel()), default=0) <= SAFE else e for e in entries]
    return [b.moved(e) for b, e in zip(coder.books, held, strict=True)]


def fit_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, groups: int = 6, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label as a string, code and error of every kept vector; the final codebooks).

    Components become floor(256 x) and vectors are cut into ``parts``. A part's codebook starts as
    that part of the ``entries`` (256 at most) smallest ids' vectors; each of ``rounds`` rounds
    assigns every part to its nearest entry (equal ones: the lower index) and replaces the
    entries by the floor of their parts' mean; unused entries stay. The first assignment
    measures every entry; later ones carry an upper bound per part and a lower bound per group
    of entries, written with the rows, and scan groups whose bound fails after the drift.

    Vectors that are null, empty, hold null or non-finite components or have another length than
    most (equally many: the longer) are left out. Equal ids are ordered by their vectors, null
    ids come last; each row gets its code. With fewer rows than ``entries`` the codebooks are as
    short; without any the result and the codebooks are empty. Lengths that ``parts`` doesn't
    divide give parts of two lengths. An error beyond 64 bits fails.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part: 1 to 256 entries")
    item = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(f"array<{item}>").alias("v"))
    rows = rows.where((F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))))
    widths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not widths:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), []
    width = widths[0].d
    rows = rows.where(F.size("v") == width)
    seeds = whole(np.array([r.v for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()], np.float64))
    cut = cuts(width, parts)
    books = []
    for p in range(parts):
        own = seeds[:, cut[p] : cut[p + 1]]
        books.append(Book(own, grouped(own, groups)))
    at, first = rows, True
    for _ in range(rounds):
        before, at = at, _states(at, Coder(books, width), first)
        if not first:
            discard(before)
        books, first = _averaged(at, Coder(books, width)), False
    out = _codes(at, Coder(books, width), first)
    if not first:
        discard(at)
    return out, [b.entries for b in books]


def vector_codes(vectors: DataFrame, **options: int | str) -> DataFrame:
    """vec_id, code (two hexadecimal digits a part), error, label_error and codebooks_sha256 of every kept vector; options and cases as in ``fit_codes``.

    label_error sums the errors of rows with equal labels, nulls together. Sums are combined
    before the shuffle; up to a million of them are sent to the rows, more meet by a shuffle.
    """
    coded, books = fit_codes(vectors, **options)
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    if books:
        sums = stored(sums, "label_errors")
        sums = F.broadcast(sums) if sums.count() <= 1_000_000 else sums
    met = coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left")
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def decoded(codes: DataFrame, books: list[np.ndarray], code_col: str = "code") -> DataFrame:
    """``codes`` with the vector each code stands for: the middle of the integer cells of its entries."""
    table = [F.array(*(F.array(*((F.lit(int(c)) + 0.5) / 256 for c in entry)) for entry in book.tolist())) for book in books]
    digit = [F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int") for p in range(len(books))]
    return codes.withColumn("vector", F.flatten(F.array(*(F.get(t, d) for t, d in zip(table, digit, strict=True)))) if books else F.array().cast("array<double>"))
