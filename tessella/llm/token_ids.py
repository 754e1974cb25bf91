"""Token ids in a binary file format: frequency-ranked, byte-aligned, with separate control bytes."""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, slices, stored, utf8

MAGIC = b"TSV1"
#: the pre-tokenizer pattern for which WordEncoder is right
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: runs of ASCII characters that are no letter, space or apostrophe
OTHER = re.compile(rb"[!-&(-@\[-`{-~]+")


#: words of Latin-1 letters, which only lower-casing changes, and runs without letters, in which digits stand alone
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
DIGITS = re.compile(r"[0-9]|[^0-9]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: of each byte of lower-cased text: 1 for an ASCII letter, 2 for what OTHER takes, else 0
CLASS = np.array([1 if 97 <= c <= 122 else 2 if OTHER.fullmatch(bytes([c])) else 0 for c in range(256)], np.uint8)


def split_words(texts: list[bytes]) -> list[list[bytes]]:
    """The words of lower-cased texts, cut at white space and between letters (ASCII or Latin-1) and OTHER characters.

    All texts are marked at once: where a byte of class 1 meets one of class 2 a space goes
    in. A text that may hold an added token is only cut at white space, its case kept.
    """
    joined = b"".join([t.lower() for t in texts])
    raw = np.frombuffer(joined, np.uint8)
    kind = CLASS[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    letter = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    kind[letter] = kind[letter + 1] = 1
    at = np.flatnonzero(kind[:-1] + kind[1:] == 3) + 1
    spaced = np.insert(raw, at, 32).tobytes()
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    ends = (ends + np.searchsorted(at, ends)).tolist()
    return [t.split() if b"<|" in t else spaced[a:b].split() for t, a, b in zip(texts, [0, *ends], ends, strict=False)]


#: bytes of each of a control byte's four values: code 0 to 3 is 1 to 4 bytes, lowest bits first
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


class WordEncoder(dict):
    """Ids of texts by way of their words, each of which the tokenizer encodes once while it is remembered.

    Right for tokenizers that lower-case, drop white space and cut between letters and
    other characters (a space put there changes nothing); others are refused by their
    spec, and a text of each slice is compared with what all of the tokenizer's steps give;
    if it differs, they encode that slice. Looking up a word gives its number. From ``limit``
    words or ``room`` bytes of words on, the most frequent of at most 64 bytes stay, up to
    half of either, which bounds the memory whatever the texts' words are like.
    """

    def __init__(self, path: str, limit: int = 500_000, room: int = 8 << 20):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.room, self.bytes, self.differences = Tokenizer.from_file(path), limit, room, 0, 0
        spec = json.loads(self.tokenizer.to_str())
        pattern = spec["pre_tokenizer"]["pretokenizers"][0].get("pattern", {}).get("Regex")
        if pattern != PATTERN or any("<|" not in t["content"] for t in spec["added_tokens"]) or not any(n["type"] == "Lowercase" for n in spec["normalizer"]["normalizers"]):
            raise ValueError("this tokenizer may form tokens across words")
        self.letters = _byte_letters()
        self.new: list[bytes] = []
        # by number of word, with room to grow: where its ids begin in flat, how many there are, and how often it was met
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.starts, self.lengths, self.hits = (np.zeros(1 << 16, np.int64) for _ in range(3))

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        self.bytes += len(word)
        return n

    def _forget(self) -> None:
        order = np.argsort(-self.hits[: len(self)], kind="stable")
        size = np.fromiter(map(len, self), np.int64, len(self))[order]
        order, size = order[size <= 64], size[size <= 64]
        fits = np.cumsum(size) <= self.room // 2
        keep, self.bytes = np.sort(order[fits][: self.limit // 2]), int(size[fits][: self.limit // 2].sum())
        number = np.full(len(self), -1)
        number[keep] = np.arange(len(keep))
        left = [(w, n) for w, n in zip(self, number.tolist(), strict=True) if n >= 0]  # words stand in the order of their numbers
        self.clear()
        self.update(left)
        n, starts, hits = self.lengths[keep], self.starts[keep], self.hits[keep]
        ends = np.cumsum(n)
        self.used = int(ends[-1]) if len(ends) else 0
        self.flat[: self.used] = self.flat[np.arange(self.used) + np.repeat(starts - ends + n, n)]
        self.starts[: len(keep)], self.lengths[: len(keep)], self.hits[: len(keep)] = ends - n, n, hits // 2

    def _learn(self) -> None:
        """Encode the new words: plain ones by the tokenizer's model, the others by all of its steps."""
        tokenize, ids = self.tokenizer.model.tokenize, []
        for w in self.new:
            parts: list[str] = []
            if len(w) <= 64:
                if PLAIN.fullmatch(w):
                    parts = [w.decode() if w.isascii() else w.decode().lower().encode().decode("latin-1").translate(self.letters)]
                elif OTHER.fullmatch(w):
                    parts = DIGITS.findall(w.decode())
            ids.append([t.id for x in parts for t in tokenize(x)])
        rest = [i for i, x in enumerate(ids) if not x]
        for at in range(0, len(rest), 2000):
            part = rest[at : at + 2000]
            e = self.tokenizer.encode([self.new[i].decode("utf-8", "replace") for i in part], is_pretokenized=True, add_special_tokens=False)
            for n, x in zip(e.word_ids, e.ids, strict=True):
                ids[part[n]].append(x)
        first, last = len(self) - len(self.new), len(self)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        end = self.used + int(n.sum())
        while len(self.lengths) < last:
            self.starts, self.lengths, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.hits))
        while len(self.flat) < end:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : end] = np.fromiter(chain.from_iterable(ids), np.uint32, end - self.used)
        self.starts[first:last], self.lengths[first:last], self.hits[first:last] = self.used + np.cumsum(n) - n, n, 0
        self.used = end
        self.new = []

    def encode(self, texts: list[bytes], end_id: int) -> list[np.ndarray]:
        """The ids of each text, ``end_id`` last."""
        if len(self) > self.limit or self.bytes > self.room:
            self._forget()
        got = self._by_words(texts, end_id)
        some = max(range(len(texts)), key=lambda i: (len(texts[i]) <= 4096, len(texts[i])), default=None)  # the longest that is soon compared
        if some is not None and got[some].tolist() != [*self._whole(texts[some]), end_id]:
            self.differences += 1
            return [np.array([*self._whole(t), end_id], np.uint32) for t in texts]
        return got

    def _whole(self, text: bytes) -> list[int]:
        """A text's ids by all of the tokenizer's steps."""
        return self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids

    def _by_words(self, texts: list[bytes], end_id: int) -> list[np.ndarray]:
        words = split_words(texts)
        counts = np.array([len(w) for w in words], np.int64)
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        if self.new:
            self._learn()
        self.hits[: len(self)] += np.bincount(at, minlength=len(self))
        n = self.lengths[at]
        ends = np.cumsum(n)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - ends + n, n)]
        cuts = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        return [np.append(ids[a:b], np.uint32(end_id)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def width(path: str) -> str:
    """How ids are held between the passes: 16 bits where the vocabulary allows, else 32."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian unsigned, ``end_id`` last) of every document; null texts count as empty. See ``width``."""
    kind = width(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in slices(batches, 1000, "text", 5 << 19):
            ids = own.encode(utf8(batch.column(1)), end_id)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def ids_of(column: pa.Array, kind: str) -> np.ndarray:
    """All ids of a binary column without nulls, in order, without copying."""
    column = column.cast(pa.binary())
    size = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    item = int(kind[2])
    return np.frombuffer(column.buffers()[2], kind, int(size[-1] - size[0]) // item, int(size[0])) if size[-1] > size[0] else np.zeros(0, kind)


def frequencies(encoded: DataFrame, kind: str = "<u4") -> DataFrame:
    """How often each id occurs in all documents: id, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in slices(batches, 2000):
            n = np.bincount(ids_of(batch.column(0), kind))
            total = np.pad(total, (0, max(0, len(n) - len(total)))) + np.pad(n, (0, max(0, len(total) - len(n))))
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    return encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def pack(ids: list[bytes], keys: list[int | None], rank: np.ndarray, by_rank: np.ndarray, kind: str = "<u4") -> bytes:
    """One block: magic; counts of documents, ids and vocabulary; keys with a null flag each; ids per document; vocabulary by rank; control bytes; value bytes."""
    flat = rank[np.frombuffer(b"".join(ids), kind)].astype("<u4")
    size = (flat > 0xFF).astype(np.uint8) + (flat > 0xFFFF) + (flat > 0xFFFFFF)
    codes = np.zeros(-(-len(flat) // 4) * 4, np.uint8)
    codes[: len(flat)] = size
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    ends = np.cumsum(size, dtype=np.int64) + np.arange(1, len(flat) + 1)
    value = np.empty(int(ends[-1]) if len(flat) else 0, np.uint8)
    value[ends - 1 - size] = flat & 0xFF
    for k in range(1, 4):
        if len(more := np.flatnonzero(size >= k)):
            value[ends[more] - 1 - size[more] + k] = flat[more] >> np.uint32(8 * k) & 0xFF
    top = int(flat.max()) + 1 if len(flat) else 0  # the ranks that occur in this block
    head = np.array([len(ids), len(flat), top], "<u8").tobytes()
    null = np.array([k is None for k in keys], np.uint8).tobytes()
    return b"".join((MAGIC, head, np.array([k or 0 for k in keys], "<i8").tobytes(), null, np.array([len(x) // int(kind[2]) for x in ids], "<u4").tobytes(), by_rank[:top].astype("<u4").tobytes(), control.tobytes(), value.tobytes()))


def unpack(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Keys, ids per document and all ids of a block; value lengths and masks come from tables."""
    if block[:4] != MAGIC:
        raise ValueError("not a token-id block")
    docs, n, top = (int(x) for x in np.frombuffer(block, "<u8", 3, 4))
    at = 28
    keys = np.frombuffer(block, "<i8", docs, at)
    null = np.frombuffer(block, np.uint8, docs, at := at + 8 * docs)
    counts = np.frombuffer(block, "<u4", docs, at := at + docs)
    by_rank = np.frombuffer(block, "<u4", top, at := at + 4 * docs)
    control = np.frombuffer(block, np.uint8, -(-n // 4), at := at + 4 * top)
    size = LENGTHS[control].reshape(-1)[:n]
    value = np.frombuffer(block + b"\0\0\0", np.uint8, offset=at + len(control))  # four bytes can be read at each start
    start = np.cumsum(size, dtype=np.int64) - size
    word = np.zeros(n, np.uint32)
    for k in range(int(size.max()) if n else 0):
        word |= value[start + k].astype(np.uint32) << np.uint32(8 * k)
    word &= MASKS[size - 1]
    return [None if z else k for k, z in zip(keys.tolist(), null.tolist(), strict=True)], counts, by_rank[word]


def write_token_files(encoded: DataFrame, path: str, kind: str = "<u4", block_ids: int = 1 << 20, part_ids: int = 12 << 20) -> None:
    """Write (doc_id, ids) as blocks in ascending doc_id order (nulls first; equal ids by content).

    Each output row is a block of about ``block_ids`` ids: shard, block, docs, n_ids, data;
    a file holds about ``part_ids`` ids.
    Shards follow the range partitions, so (shard, block) ascends with doc_id. The rank
    table goes to tasks by closure; the tokenizer's vocabulary bounds it.
    """
    counted = frequencies(encoded, kind).orderBy(F.desc("n"), "id").collect()
    ranked = [r.id for r in counted]
    parts = 1 + sum(r.n for r in counted) // part_ids
    by_rank = np.array(ranked, np.uint32)
    rank = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank[by_rank] = np.arange(len(ranked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, ids, keys, n = TaskContext.get().partitionId(), 0, [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([n], pa.int64()), "data": pa.array([pack(ids, keys, rank, by_rank, kind)], pa.binary())})

        for batch in slices(batches, 200):
            for key, x in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                ids.append(x)
                keys.append(key)
                n += len(x) // int(kind[2])
                if n >= block_ids:
                    yield out()
                    block, ids, keys, n = block + 1, [], [], 0
        if ids:
            yield out()

    tie = F.xxhash64("ids").alias("tie")
    ordered = encoded.select("doc_id", "ids", tie).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids")
    ordered.select("doc_id", "ids").mapInArrow(run, "shard int, block int, docs long, n_ids long, data binary").write.parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files at ``path``, and ids (array) if asked for."""
    files = spark.read.parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    within = files.select("shard", "block", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")).alias("block_start"))
    offsets = within.join(before, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            keys, counts, ids = unpack(batch.column(2)[0].as_py())
            raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts, dtype=np.int64)
            starts = ends - counts
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            m = len(keys)
            cols = [pa.repeat(batch.column(0)[0], m), pa.repeat(batch.column(1)[0], m), pa.array(keys, pa.int64()), pa.array(starts), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())]
            names = ["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array([ids[a:b] for a, b in zip(starts, ends, strict=True)], pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = files.select("shard", "block", "data").mapInArrow(run, "shard int, block int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    return rows.join(offsets, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_id_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode ``docs``, write the token files to ``path`` (default: the shared folder) and read them back.

    Null texts count as empty (one token, the end id). Repeated doc_ids keep a row each, in
    the order of their content; null doc_ids come first. No rows give no rows; other columns
    aren't read.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tessella/tokens-{uuid.uuid4().hex}"
    write_token_files(stored(encode_documents(docs, tokenizer, end_id, id_col, text_col), "ids"), path, width(tokenizer))
    return read_token_files(spark, path)
