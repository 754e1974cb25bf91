"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept_rows, slices, utf8

LETTER = r"\p{L}"


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, x)
    np.exp(x, x)
    x += 1
    return np.reciprocal(x, x)


class Network:
    """Two gated recurrent layers of ``size`` units read the bytes forwards and backwards; both states label each byte.

    A unit's gates: r, z = σ(X[byte] + h·U); new state n = tanh(X'[byte] + (r∘h)·U');
    h ← n + z∘(h − n). The input tables X are one row per byte and direction, which is a
    one-hot input times its weights.
    """

    def __init__(self, langs: list[str], size: int = 10, seed: int = 1):
        self.langs, self.size = langs, size
        rng = np.random.default_rng(seed)
        h, k = size, len(langs)
        shapes = {"v": (2 * h, k), "c": (k,)} | {f"{d}{n}": s for d in "fb" for n, s in (("x", (256, 2 * h)), ("u", (h, 2 * h)), ("y", (256, h)), ("w", (h, h)))}
        self.p = {n: rng.normal(0, 0.0 if n == "c" else 0.3, s).astype(np.float32) for n, s in shapes.items()}

    def states(self, x: np.ndarray, d: str, keep: bool = False, first: np.ndarray | None = None, lengths: np.ndarray | None = None) -> tuple[np.ndarray, list]:
        """States of direction ``d`` after each byte of x (time, row) in reading order, and with ``keep`` what its gradient needs.

        Before a row's ``first`` byte and past its length the state stays zero, so padding is never read.
        """
        p, h = self.p, np.zeros((x.shape[1], self.size), np.float32)
        out = np.empty((*x.shape, self.size), np.float32)
        kept = []
        size = self.size
        first_most = 0 if first is None or not len(first) else int(first.max())
        least = 0 if lengths is None or not len(lengths) else int(lengths.min())
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            g = p[d + "x"][x[t]]
            g += h @ p[d + "u"]
            _sigmoid(g)
            r, z = g[:, :size], g[:, size:]
            rh = r * h
            n = p[d + "y"][x[t]]
            n += rh @ p[d + "w"]
            np.tanh(n, n)
            new = h - n
            new *= z
            new += n
            if first is not None and t < first_most:
                new[t < first] = 0
            if lengths is not None and t >= least:
                new[t >= lengths] = 0
            if keep:
                kept.append((t, h, r, z, rh, n))
            out[t] = h = new
        return out, kept

    def probabilities(self, before: np.ndarray, after: np.ndarray, first: np.ndarray, lengths: np.ndarray, span: int) -> np.ndarray:
        """Label probabilities of the bytes of pieces.

        ``before`` (time, row) is what the forward layer reads, of which the last bytes are the
        piece and those from ``first`` on count; ``after`` is what the backward layer reads, of
        which the first ``span`` bytes are the piece and ``lengths`` count.
        """
        size, p = self.size, self.p
        logits = self.states(before, "f", first=first)[0][-span:] @ p["v"][:size]
        logits += self.states(after, "b", lengths=lengths)[0][:span] @ p["v"][size:]
        logits += p["c"]
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, logits)
        logits /= logits.sum(-1, keepdims=True)
        return logits

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the bytes of x (time, row) with one label per row, and its gradient, by backpropagation through time."""
        p, size = self.p, self.size
        both = {d: self.states(x, d, True) for d in "fb"}
        s = np.concatenate([both["f"][0], both["b"][0]], -1)
        logits = s @ p["v"] + p["c"]
        logits -= logits.max(-1, keepdims=True)
        q = np.exp(logits)
        q /= q.sum(-1, keepdims=True)
        n = x.size
        rows = np.arange(x.shape[1])
        loss = -float(np.log(np.maximum(q[:, rows, y], 1e-9)).mean())
        q[:, rows, y] -= 1
        q /= n
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["c"] = q.sum((0, 1))
        grad["v"] = s.reshape(n, -1).T @ q.reshape(n, -1)
        ds = q @ p["v"].T
        for i, d in enumerate("fb"):
            dh = np.zeros((x.shape[1], size), np.float32)
            gx, gy = np.empty((*x.shape, 2 * size), np.float32), np.empty((*x.shape, size), np.float32)
            for t, h, r, z, rh, new in reversed(both[d][1]):
                dh = dh + ds[t, :, i * size : (i + 1) * size]
                dn = dh * (1 - z) * (1 - new * new)
                drh = dn @ p[d + "w"].T
                dg = np.concatenate([drh * h * r * (1 - r), dh * (h - new) * z * (1 - z)], 1)
                grad[d + "w"] += rh.T @ dn
                grad[d + "u"] += h.T @ dg
                gx[t], gy[t] = dg, dn
                dh = dh * z + drh * r + dg @ p[d + "u"].T
            flat = x.reshape(-1)
            for name, g in (("x", gx), ("y", gy)):
                g = g.reshape(len(flat), -1)
                grad[d + name] = np.stack([np.bincount(flat, g[:, j], 256) for j in range(g.shape[1])], 1).astype(np.float32)
        return loss, grad

    def train(self, texts: list[bytes], y: np.ndarray, steps: int = 350, rows: int = 256, span: int = 48, rate: float = 0.02, seed: int = 1) -> float:
        """Adam over windows of ``span`` bytes at random places of the texts, languages drawn alike; the last loss."""
        rng = np.random.default_rng(seed)
        padded = [t + b" " * max(0, span - len(t)) for t in texts]
        of = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        loss = 0.0
        for step in range(1, steps + 1):
            lab = rng.integers(0, len(self.langs), rows)
            pick = [padded[of[k][rng.integers(len(of[k]))]] for k in lab]
            x = np.array([np.frombuffer(t, np.uint8, span, int(rng.integers(len(t) - span + 1))) for t in pick]).T
            loss, grad = self.gradient(np.ascontiguousarray(x), lab)
            scale = min(1.0, 1.0 / max(1e-9, float(np.sqrt(sum((g * g).sum() for g in grad.values())))))
            slow = rate * (1 if step < 0.6 * steps else 0.2)
            for k, g in grad.items():
                g = g * scale
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] -= (slow * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return loss

    def pooled(self, texts: list[bytes], span: int = 192, lead: int = 32, rows: int = 1024) -> np.ndarray:
        """Mean label probabilities over all bytes of each text (an empty one: all alike).

        Texts are read whole, in pieces of ``span`` bytes that are labelled side by side. The
        forward layer comes to a piece from ``lead`` bytes before it and the backward layer from
        ``lead`` bytes after it, or from the text's edge, so no byte is labelled out of context.
        """
        k = len(self.langs)
        total = np.zeros((len(texts), k))
        size = np.array([len(t) for t in texts], np.int64)
        pieces = -(-size // span)
        owner = np.repeat(np.arange(len(texts)), pieces)
        at = span * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        pad = span + lead
        buffer = np.frombuffer(b" " * pad + b"".join(texts) + b" " * pad, np.uint8)
        place = pad + (np.cumsum(size) - size)[owner] + at
        left = size[owner] - at
        order = np.argsort(np.minimum(left, pad), kind="stable")  # short pieces together
        for a in range(0, len(order), rows):
            part = order[a : a + rows]
            own = int(min(span, left[part].max()))
            ahead = int(min(pad, left[part].max()))
            before = buffer[place[part] + np.arange(-lead, own)[:, None]]
            after = buffer[place[part] + np.arange(ahead)[:, None]]
            q = self.probabilities(before, after, np.maximum(0, lead - at[part]), left[part], own)
            q *= (np.arange(own)[:, None] < left[part])[:, :, None]
            np.add.at(total, owner[part], q.sum(0))
        return np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], 1 / max(k, 1))


def fit_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 300, labels: int = 64, **train: int) -> Network | None:
    """A network from at most ``sample`` labelled documents of each language that aren't held out; None without any.

    Those with the smallest hash of doc_id and text are taken, repeated rows once, of the
    ``labels`` languages with most documents (ties by name). The bounds are on fitting alone.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null and doc_id is not null").where(~held_out("doc_id"))
    known = known.where(F.col("text").rlike(LETTER))
    counted = known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("doc_id", "text")).alias("different"))
    counts = {r.lang: r.different for r in counted.orderBy(F.desc("n"), "lang").limit(labels).collect()}
    if not counts:
        return None
    order = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 31)) / float(1 << 31)
    share = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, (1.3 * sample + 20) / n)))))[F.col("lang")]
    near = known.withColumn("o", order).where(F.col("lang").isin(list(counts))).where(F.col("o") < share).select("lang", "o", F.col("doc_id").cast("string").alias("doc_id"), "text").distinct()
    first = Window.partitionBy("lang").orderBy("o", "doc_id", "text")
    rows = near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= sample).orderBy("lang", "k").collect()
    langs = sorted({r.lang for r in rows})
    if not langs:
        return None
    net = Network(langs)
    net.train([r.text.encode() for r in rows], np.array([langs.index(r.lang) for r in rows]), **train)
    return net


def label_language(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    A text that is null or has no letter is ``und`` with score 0, as is every text without
    a network. Ties go to the first language by name. Repeated rows each get a row, a null
    id isn't held out, no rows give no rows, other columns aren't read.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.when(F.col(text_col).cast("string").rlike(LETTER), F.col(text_col).cast("string")).alias("text"))
    own = own.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000, "text", 4 << 20):
            texts = utf8(batch.column(2))
            if net is None:
                lang, score = ["und"] * len(texts), np.zeros(len(texts))
            else:
                p = net.pooled(texts)
                best = p.argmax(1)
                lang = [net.langs[b] if t else "und" for b, t in zip(best, texts, strict=True)]
                score = np.where([bool(t) for t in texts], np.clip(p.max(1), 0, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def in_language(docs: DataFrame, net: Network | None, text_col: str = "text", least: float = 0.35) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a letter and a pooled score of at least ``least``.

    Null texts go. Without a network only the letters count.
    """

    def keep(texts: list[bytes], letters: list[bool]) -> list[bool]:
        if net is None or not texts:
            return letters
        return [a and b >= least for a, b in zip(letters, net.pooled(texts).max(1), strict=True)]

    return kept_rows(docs, text_col, F.coalesce(F.col(text_col).cast("string").rlike(LETTER), F.lit(False)), keep)


def identify(docs: DataFrame, **fit: int) -> DataFrame:
    """Fit on the labelled documents that aren't held out, and label every document."""
    return label_language(docs, fit_language(docs, **fit))
