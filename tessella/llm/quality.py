"""Document quality by ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8


SYMBOLS = string.punctuation.encode()


class WordHashes(dict):
    """Hash of a word without ASCII symbols at its ends (a word of symbols alone stays), remembered for up to ``limit`` words."""

    def __init__(self, limit: int = 300_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = zlib.crc32(word.strip(SYMBOLS) or word)
        if len(self) < self.limit:
            self[word] = h
        return h


def features(text: bytes, hashes: WordHashes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of a text (A-Z lower-cased, split at ASCII white space, symbols at the ends left out) with weights 1 + log(count), scaled to length ten in all."""
    ws = text.lower().split()
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    at = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)
    at.sort()
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    x = (1 + np.log(np.diff(np.r_[new, len(at)]))).astype(np.float32)
    return at[new], x * np.float32(10 / (np.sqrt((x * x).sum()) or 1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


class Ordinal:
    """P(grade > k) = sigmoid(w·x − threshold[k]), thresholds ascending, weights shared by all grades."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, bits: int):
        self.weights, self.thresholds, self.bits = weights, thresholds, bits

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, bits: int, n_grades: int, steps: int = 300, rate: float = 0.005, damping: float = 0.03, support: int = 20) -> Ordinal:
        """Gradient descent with momentum on the negative log-likelihood, every grade weighing alike.

        A step is divided by each weight's own curvature plus ``damping``, which keeps rare
        words small; words in under ``support`` of the rows (at most a hundredth of them) stay at zero.
        """
        at, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(float)
        own = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        x *= (np.bincount(at, minlength=1 << bits) >= min(support, len(rows) / 100))[at]
        counts = np.bincount(grades, minlength=n_grades)
        share = (1 / (np.maximum(counts, 1) * (counts > 0).sum()))[grades]
        w, t = np.zeros(1 << bits), np.linspace(-2, 1, n_grades - 1)
        curve = np.bincount(at, x * x * share[own] / 4, 1 << bits) + damping
        vw, vt = np.zeros_like(w), np.zeros_like(t)
        for _ in range(steps):
            s = np.bincount(own, w[at] * x, len(rows))
            hi, lo = _sigmoid(np.r_[t, np.inf][grades] - s), _sigmoid(np.r_[-np.inf, t][grades] - s)
            p = np.maximum(hi - lo, 1e-9)
            dhi, dlo = share * hi * (1 - hi) / p, share * lo * (1 - lo) / p
            vw = 0.9 * vw - rate * np.bincount(at, (dhi - dlo)[own] * x, 1 << bits) / curve
            vt = 0.9 * vt + 0.3 * (np.bincount(grades, dhi, n_grades)[:-1] - np.bincount(grades, dlo, n_grades)[1:])
            w, t = w + vw, np.sort(t + vt)
        return cls(w.astype(np.float32), t, bits)

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return _sigmoid(score[:, None] - self.thresholds)


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Grades of labelled documents: 0 toxic, 1 neither, 2 good; null labels are left out, of several the worst holds."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1)
    return labels.select(F.col(id_col).cast("long").alias("doc_id"), grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def fit_quality(docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 4000, bits: int = 18, n_grades: int = 3) -> Ordinal | None:
    """A model from (doc_id, grade) of at most ``sample`` documents, those with the smallest hash of doc_id; None without any.

    Grades of documents that don't exist or have no text are passed over, and of documents
    that share an id the smallest text counts. The bound is on fitting alone: every document
    is scored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    there = grades.join(own.select("doc_id").distinct(), "doc_id", "left_semi")
    known = {r.doc_id: r.grade for r in there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}
    if not known:
        return None
    one = own.where(F.col("doc_id").isin(list(known))).groupBy("doc_id").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, 500):
            got = [features(t, hashes, bits) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.tobytes() for a, _ in got], pa.binary()), pa.array([x.tobytes() for _, x in got], pa.binary())], ["doc_id", "at", "x"])

    first = {r.doc_id: r for r in sorted(one.mapInArrow(run, "doc_id long, at binary, x binary").collect(), key=lambda r: r.doc_id)}
    data = [(np.frombuffer(r.at, np.int32), np.frombuffer(r.x, np.float32)) for r in first.values()]
    y = np.array([known[k] for k in first])
    return Ordinal.fit(data, y, bits, n_grades) if data else None


def score_quality(docs: DataFrame, fitted: Ordinal | None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """doc_id, grade (expected, 0 to the top), not_toxic (P above grade 0), tail (P of the top grade) and selected (not_toxic at least ``least``).

    Null and empty texts have no features and get the thresholds' own probabilities;
    without a model all four are null. Repeated rows each get a row, no rows give no rows,
    other columns aren't read.
    """
    kind = "doc_id long, grade double, not_toxic double, tail double, selected boolean"
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if fitted is None:
        return own.selectExpr("doc_id", "cast(null as double) as grade", "cast(null as double) as not_toxic", "cast(null as double) as tail", "cast(null as boolean) as selected")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, 1000):
            s = np.zeros(batch.num_rows)
            for i, t in enumerate(utf8(batch.column(1))):
                at, x = features(t, hashes, fitted.bits)
                s[i] = fitted.weights[at] @ x
            p = fitted.above(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(p[:, -1]), pa.array(p[:, 0] >= least)], ["doc_id", "grade", "not_toxic", "tail", "selected"])

    return own.mapInArrow(run, kind)


def quality(docs: DataFrame, labels: DataFrame, **fit: int) -> DataFrame:
    """Fit on graded labels of ``docs`` and score every document."""
    return score_quality(docs, fit_quality(docs, graded(labels), **fit))
