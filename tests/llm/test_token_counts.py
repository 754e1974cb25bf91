import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessella.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")


def want(texts):
    t = Tokenizer.from_file(PATH)
    return [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def odd_texts():
    rng = random.Random(6)
    parts = ["<|endoftext|>", "<|endof", "text|>", "'s", "'S", "'ll", " ", "  ", "\n", "\n\n ", "\t", " ", " ", "\u0085", "a", "Été", "ß", "1", "²", "½", "٣", "ⅷ", "_", "!!", "…", "\0", "\x1f", "é", "日本", "ก็", "՘", "Ᲊ", "\U0001e4d0", "\U0001f600", "‍", "﻿", "ﬁ", "x" * 50]
    return ["".join(rng.choice(parts) for _ in range(rng.choice([1, 2, 5, 30]))) for _ in range(3000)]


def test_cuts_as_the_library(spark):
    cutter, t = tc.PreTokens(PATH), Tokenizer.from_file(PATH)
    for text in odd_texts():
        found = cutter.frequencies(text)
        assert sum(n * p for n, p in zip(found.values(), cutter.pieces(list(found)))) == len(t.encode(text, add_special_tokens=False).ids), repr(text)


def test_every_sure_character_and_its_neighbours():
    cutter, pre = tc.PreTokens(PATH), Tokenizer.from_file(PATH).pre_tokenizer
    for c in map(chr, range(0x500)):
        for text in (f"a{c}a{c}{c}1{c}!{c} {c}", f"{c} {c}  {c}'{c}'s{c}\n{c}_{c}", f" {c}", f"{c}²{c}½ {c}\x1c{c}"):
            assert list(cutter._cut(text)) == [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)], repr(text)


@pytest.mark.parametrize("options", [{}, {"frequent": 0}, {"frequent": 5, "held": 3}])
def test_against_the_library(spark, options):
    texts = [*odd_texts()[:400], None, "", "word " * 40_000, "w" * 20_000, " " * 5000 + "x", "same text", "same text"]
    rows = [(i if i % 50 else None, x, "z", 1) for i, x in enumerate(texts)] + [(3, texts[3], "y", 2), (3, texts[3], "y", 2), (3, texts[4], "y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n_tokens int")
    got = Counter(tuple(r) for r in tc.token_counts(df, PATH, **options).collect())
    assert got == Counter((i, len((x or "").encode()), n, n > 512) for (i, x, _, _), n in zip(rows, want([r[1] for r in rows])))


def test_empty(spark):
    out = tc.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert out.count() == 0 and out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_frequent_is_bounded(spark):
    table = spark.createDataFrame([(f"w{i}", i, 1) for i in range(1, 101)] + [("x" * 65, 1000, 2)], "word string, n_docs long, pieces long")
    assert len(tc._frequent(table, 37)) == 37 and len(tc._frequent(table, 36)) == 0  # 64 to 100 are of one power of two
    assert len(tc._frequent(table, 1000)) == 100


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tc.PreTokens(public_tokenizers.path("word_bpe_49k.json"))


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r.n_tokens for r in tc.token_counts(docs, PATH).collect()}
    assert got == dict(zip([r.doc_id for r in rows], want([r.text for r in rows])))
