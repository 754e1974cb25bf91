"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

SPACE = "▁"
#: places between a Latin letter and another ASCII character that isn't a space
SEAM = r"(?<=[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])(?=[\x01-\x1f!-@\[-`{-\x7f])|(?<=[\x01-\x1f!-@\[-`{-\x7f])(?=[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])"


class Pieces:
    """A model's vocabulary with our own encoder and decoder.

    Encoding puts all adjacent symbol pairs that form a piece on an agenda ordered by
    the merged piece's score, ties to the left, and merges until it is empty; symbols
    outside the vocabulary become their UTF-8 bytes. No merge can join two characters
    that stand side by side in no piece, so a text is first cut before runs of spaces
    and, if the vocabulary allows it, between letters and other ASCII characters; equal
    chunks then have equal ids wherever they stand.

    Models must leave texts as they are (identity normalisation), add a dummy prefix,
    keep extra spaces and have byte fallback; others are refused.
    """

    def __init__(self, path: str, limit: int = 250_000):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.limit, self.differences = limit, 0
        self.names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.rank: dict[str, tuple[float, int]] = {}
        self.byte = [0] * 256
        for i, name in enumerate(self.names):
            if sp.is_byte(i):
                self.byte[int(name[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.rank[name] = (-sp.get_score(i), i)
        probe = "  Á ﬁ\t① x "
        if not all(self.byte) or sp.decode(sp.encode(probe)) != probe or sp.encode("")[:1] or any(SPACE in n.lstrip(SPACE) or "\0" in n for n in self.rank):
            raise ValueError("this model normalises texts or has no byte fallback")
        self.pairs = {(n[i], n[i + 1]) for n in self.rank for i in range(len(n) - 1)}
        self.known: dict[str, bytes] = {}  # ids joined by commas of chunks that decode to themselves
        apart = not any((a.isalpha() and b < "\x80" and not b.isalpha()) or (b.isalpha() and a < "\x80" and not a.isalpha()) for a, b in self.pairs)
        self.seam = re.compile(SEAM if apart else r"(?!)")

    def merge(self, part: str) -> list[int]:
        """The ids of a part, by the agenda."""
        rank = self.rank
        if part in rank and len(part) == 1:
            return [rank[part][1]]
        sym: list[str | None] = list(part)
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(r[0], i, p) for i in range(n - 1) if (r := rank.get(p := part[i : i + 2]))]
        heapq.heapify(agenda)
        while agenda:
            _, i, whole = heapq.heappop(agenda)
            j = right[i]
            a = sym[i]
            if a is None or j >= n or a + sym[j] != whole:
                continue  # one of the two has changed since
            sym[i], sym[j] = whole, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if r := rank.get(p := whole + sym[k]):
                    heapq.heappush(agenda, (r[0], i, p))
            if (k := left[i]) >= 0 and (r := rank.get(p := sym[k] + whole)):
                heapq.heappush(agenda, (r[0], k, p))
        out: list[int] = []
        for s in sym:
            if s is not None:
                if r := rank.get(s):
                    out.append(r[1])
                else:
                    out += [self.byte[b] for b in s.encode()]
        return out

    def learn(self, chunks: set[str]) -> dict[str, tuple[bytes, str | None]]:
        """Encode new chunks, compare ids and text with the library, and return (ids joined by commas, text) of each; the text is None if it is the chunk's own.

        Where they differ the library's hold, and the difference is counted.
        """
        order = [c for c in chunks if c]
        prefix = len(self.library.encode("\n"))
        whole = [c[0] == SPACE and len(c) > 1 for c in order]  # such a chunk may begin a text
        theirs = self.library.encode([c[1:] if w else "\n" + c for c, w in zip(order, whole, strict=True)], num_threads=1)
        read = self.library.decode(theirs, num_threads=1) if theirs else []
        out = {}
        for c, w, full, text in zip(order, whole, theirs, read, strict=True):
            ids, lib = self.merge(c), full if w else full[prefix:]
            text = " " + text if w else text[1:]
            if ids != lib or self.decode(ids, False) != text:
                self.differences += 1
            out[c] = (",".join(map(str, lib)).encode(), None if text == c.replace(SPACE, " ") else text)
        return out

    def cut(self, text: str) -> list[str]:
        """Chunks of a text with its dummy prefix; no merge crosses their borders."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        if "\0" in text:
            return re.findall(f"{SPACE}+[^{SPACE}]*", text)
        text = self.seam.sub("\0", text)
        if SPACE + SPACE in text:
            text = re.sub(f"(?<!{SPACE}){SPACE}", "\0" + SPACE, text)
        else:
            text = text.replace(SPACE, "\0" + SPACE)
        return [c for c in text.split("\0") if c]

    def encode(self, text: str) -> list[int]:
        return [i for c in self.cut(text) for i in self.merge(c)]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of ids: bytes are joined and decoded (bad ones as U+FFFD), and the dummy prefix goes if ``first``."""
        out: list[str] = []
        raw = bytearray()
        for n, i in enumerate(ids):
            name = self.names[i]
            if len(name) == 6 and name.startswith("<0x") and self.byte[int(name[3:5], 16)] == i:
                raw.append(int(name[3:5], 16))
                continue
            if raw:
                out.append(_bytes(bytes(raw)))
                raw = bytearray()
            if self.library.is_unknown(i):
                out.append(" ⁇ ")
            elif not self.library.is_control(i):
                out.append((name[1:] if first and n == 0 and name[:1] == SPACE else name).replace(SPACE, " "))
        return "".join(out) + (_bytes(bytes(raw)) if raw else "")

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Per text: number of ids, and SHA-256 of the ids joined by commas and of the decoded text."""
        cuts = [self.cut(t) for t in texts]
        known = self.known
        extra = self.learn({c for cut in cuts for c in cut if c not in known})
        room = self.limit - len(known)
        if room > 0:
            known.update((c, extra[c][0]) for _, c in zip(range(room), extra, strict=False) if len(c) <= 64 and extra[c][1] is None)
        odd = {c: text for c, (_, text) in extra.items() if text is not None}
        out = []
        for cut in cuts:
            ids = b",".join([known.get(c) or extra[c][0] for c in cut])
            decoded = "".join([odd[c] if c in odd else c.replace(SPACE, " ") for c in cut] if odd else cut)[1:]  # the dummy prefix
            decoded = decoded if odd else decoded.replace(SPACE, " ")
            out.append((ids.count(b",") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        return out


def _bytes(raw: bytes) -> str:
    """UTF-8 with every byte that starts no valid sequence as one U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = "", 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out, i = out + raw[i : i + n].decode(), i + n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out, i = out + "�", i + 1
        return out


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    """This worker's copy of a model file."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def piece_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document.

    Null and empty texts have no ids and decode to the empty text. Repeated rows each get
    a row, null ids stay null, no rows give no rows, other columns aren't read. Every
    chunk that isn't remembered is compared with the library, an Arrow slice at a time;
    where the two differ the library's ids and text are given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in slices(batches, 250, "text", 512 << 10):
            got = own.digests([t.decode("utf-8", "replace") for t in utf8(batch.column(1))])
            cols = [batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def piece_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and the decoded text of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in slices(batches, 200, "text", 1 << 20):
            ids = [own.encode(t.decode("utf-8", "replace")) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
