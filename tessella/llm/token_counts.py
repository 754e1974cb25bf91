"""Numbers of tokens without their ids: pieces are counted once per distinct pre-token."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, slices, stored, utf8

#: the byte-level pre-tokenizer's rule (fixed value)
RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: characters below are classed alike in every version of Unicode since 5.0
UNSURE = re.compile("[\u0500-\U0010ffff]")
#: the rule for texts without such characters, which ``re`` has faster: its words hold fractions and raised digits and its
#: white space some control characters that aren't
_SPACE, _NUMBER = r"\t-\r \x85\xa0", "²³¹¼½¾"
PLAIN = re.compile(rf" ?[^\W\d_{_NUMBER}]+| ?[\d{_NUMBER}]+|'(?:s|t|re|ve|m|ll|d)| ?(?:[^\w{_SPACE}]|_)+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class PreTokens:
    """Cuts texts into pre-tokens as a byte-level tokenizer file of the tokenizers library does, and counts their pieces.

    Special strings in a text are pre-tokens of their own, as the library has it by default.
    Characters may be classed by another version of Unicode in the library than in ``regex``:
    each that a text holds is tried once, and texts with one that differs are cut by the
    library. Files with a normaliser, a prefix space or special strings that take
    surrounding spaces are refused.
    """

    def __init__(self, path: str):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        plain = all(not t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or not plain:
            raise ValueError(f"{path} is no plain byte-level tokenizer")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.rule = regex.compile(RULE)
        self.odd: dict[str, bool] = {}

    def _differs(self, char: str) -> bool:
        if char not in self.odd:
            probe = f"a{char}a{char}{char}1{char}!{char} {char}"
            self.odd[char] = [at for _, at in self.library.pre_tokenizer.pre_tokenize_str(probe)] != [m.span() for m in self.rule.finditer(probe)]
        return self.odd[char]

    def _cut(self, text: str) -> Iterable[str]:
        """The pre-tokens of a text without special strings; long texts' one at a time."""
        rule = PLAIN
        if UNSURE.search(text):
            rule = self.rule
            if any(self._differs(c) for c in set(UNSURE.findall(text))):
                return (text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text))
        return rule.findall(text) if len(text) < 1 << 20 else (m.group() for m in rule.finditer(text))

    def frequencies(self, text: str) -> Counter[str]:
        """How often each pre-token stands in a text."""
        if self.special is None or not self.special.search(text):
            return Counter(self._cut(text))
        out: Counter[str] = Counter()
        at = 0
        for m in self.special.finditer(text):
            out.update(self._cut(text[at : m.start()]))
            out[m.group()] += 1
            at = m.end()
        out.update(self._cut(text[at:]))
        return out

    def pieces(self, words: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch_fast(words, add_special_tokens=False)]


def _vocabulary(own: DataFrame, path: str, held: int) -> DataFrame:
    """word, n_docs and pieces of every distinct pre-token, each encoded once."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, seen = PreTokens(path), Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            yield from slices(iter([out]), 50_000, "word")

        for batch in slices(batches, 200, "text"):
            for text in utf8(batch.column("text")):
                seen.update(cutter.frequencies(text.decode()).keys())
                if len(seen) >= held:
                    yield from flush()
        yield from flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = PreTokens(path)
        for batch in slices(batches, 5000, "word"):
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n_docs"), pa.array(cutter.pieces(batch.column("word").to_pylist()), pa.int64())], ["word", "n_docs", "pieces"])

    distinct = own.select("text").mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n_docs"))
    return stored(distinct.mapInArrow(count, "word string, n_docs long, pieces long"), "pieces")


def _frequent(table: DataFrame, most: int) -> dict[str, int]:
    """pieces of the words that stand in most documents: at most ``most`` words of at most 64 bytes, all with over a power of two of documents."""
    short = table.where(F.octet_length("word") <= 64)
    bins = {r.b: r.n for r in short.groupBy(F.floor(F.log2("n_docs")).alias("b")).agg(F.count("*").alias("n")).collect()}
    least, total = 64, 0
    for b in sorted(bins, reverse=True):
        total += bins[b]
        if total > most:
            break
        least = b
    return {r.word: r.pieces for r in short.where(F.col("n_docs") >= 2**least).select("word", "pieces").collect()} if least < 64 else {}


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", frequent: int = 100_000, held: int = 300_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every document, as the library counts them.

    The distinct pre-tokens are encoded once each. The pieces of at most ``frequent`` of those
    that stand in most documents are known to every task, which sums them where a text lies;
    the others, which are in few documents each, meet their pieces by a shuffle. A task
    collects up to ``held`` distinct pre-tokens before it passes them on; the result depends
    on neither number. A text is cut one pre-token at a time and never encoded whole.

    Null texts are empty: no bytes, no tokens. Repeated rows each get their row, ids may be
    null; an empty table gives no rows; other columns aren't read.
    """
    shared_dir(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = _vocabulary(own, path, held)
    known = docs.sparkSession.sparkContext.broadcast(_frequent(table, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, pieces = PreTokens(path), known.value
        for batch in slices(batches, 50, "text", 1 << 20):
            doc_id, mark, size, tokens, word, times = [], [], [], [], [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                digest, total, rest = hashlib.blake2b(text, digest_size=16).digest(), 0, []
                for w, n in cutter.frequencies(text.decode()).items():
                    p = pieces.get(w)
                    if p is None:
                        rest.append((w, n))
                    else:
                        total += p * n
                # the document's own row goes with a word that no text has, so such rows spread evenly
                rest.append((f"\0{digest.hex()}", 0))
                doc_id += [i] * len(rest)
                mark += [digest] * len(rest)
                size += [None] * (len(rest) - 1) + [len(text)]
                tokens += [0] * (len(rest) - 1) + [total]
                for w, n in rest:
                    word.append(w)
                    times.append(n)
            columns = [pa.array(doc_id, pa.int64()), pa.array(mark, pa.binary()), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array(word, pa.string()), pa.array(times, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "size", "tokens", "word", "times"])

    rows = own.mapInArrow(run, "doc_id long, mark binary, size long, tokens long, word string, times long")
    met = rows.join(table.select("word", "pieces"), "word", "left")
    # equal rows (same id and text) add up in one group and are told apart again
    sums = met.groupBy("doc_id", "mark").agg(F.max("size").alias("n_bytes"), F.count("size").alias("rows"), F.sum(F.col("tokens") + F.col("times") * F.coalesce("pieces", F.lit(0))).alias("total"))
    each = sums.select("doc_id", "n_bytes", F.expr("total div rows").alias("n_tokens"), F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("copy"))
    return each.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
