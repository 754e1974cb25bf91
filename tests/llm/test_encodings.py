import hashlib
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import pieces, token_ids

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b ", "a\tb\nc", "\x00a\x00", "▁x▁▁", " \n \n", "\n", "a\n", "\n\na", "<|endoftext|> x<|startoftext|>", "it's 'S don't", "é́ Å ﬁ ①", "İstanbul ΣΑΣ", "日本語 x\x1cy\x85z", "á ́b", "x" * 3000, "a&'s", "'&a", "×&a&×", "Ã—&", "d'été,", "a´&b", "<|ENDOFTEXT|>", "THE!! Élan&&& 12.5%", "<s>hi</s><unk>", "😀👍🏽 ok", "a b c " * 400]
ALPHABET = "ab éÉ'&.,1\n\t▁<|>Ω\x00 ́"


@pytest.fixture(scope="module")
def word_encoder():
    return token_ids.WordEncoder(WORDS, limit=50)  # forgets all the time


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(PIECES, limit=50)


def check_words(e, text):
    assert e.encode([text.encode()], 1)[0].tolist() == [*e.tokenizer.encode(text, add_special_tokens=False).ids, 1]


def check_pieces(m, text):
    ids = m.library.encode(text)
    assert m.encode(text) == ids and m.decode(ids) == m.library.decode(ids)
    n, i, d = m.digests([text])[0]
    assert (n, i, d) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(m.library.decode(ids).encode()).hexdigest())


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(word_encoder, model, text):
    check_words(word_encoder, text)
    check_pieces(model, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=40))
def test_any_text(word_encoder, model, text):
    check_words(word_encoder, text)
    check_pieces(model, text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=30))
def test_any_unicode(word_encoder, model, text):
    text = text.encode("utf-8", "replace").decode()
    check_words(word_encoder, text)
    check_pieces(model, text)


def test_many_at_once(word_encoder):
    got = word_encoder.encode([t.encode() for t in ODD], 1)
    for t, ids in zip(ODD, got, strict=True):
        assert ids.tolist() == [*word_encoder.tokenizer.encode(t, add_special_tokens=False).ids, 1]
    assert word_encoder.encode([], 1) == []


def test_remembered_chunks_are_small():
    m = pieces.Pieces(PIECES)
    letters = str.maketrans("0123456789", "etaoinshrd")
    texts = [" ".join(f"{i * 7919:08d}".translate(letters) for i in range(k, k + 2000)) for k in range(0, 20_000, 2000)]
    tracemalloc.start()
    try:
        for t in texts:
            check_pieces(m, t)
        size = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(m.known) >= 20_000 and size < 250 * len(m.known)
    assert m.digests(texts) == pieces.Pieces(PIECES, limit=0).digests(texts)


def test_blocks():
    rng = np.random.default_rng(0)
    for high in (3, 200, 70_000):
        ids = [rng.integers(0, high, n).astype("<u4") for n in (0, 1, 6, 1000)]
        names = np.unique(np.concatenate(ids))
        rank = np.zeros(high, np.uint32)
        order = rng.permutation(len(names))
        rank[names[order]] = np.arange(len(names))
        keys, counts, flat = token_ids.unpack(token_ids.pack([x.tobytes() for x in ids], [5, None, -7, 2**40], rank, names[order].astype(np.uint32)))
        assert keys == [5, None, -7, 2**40] and counts.tolist() == [0, 1, 6, 1000] and (flat == np.concatenate(ids)).all()
    with pytest.raises(ValueError):
        token_ids.unpack(b"nope" * 20)


def test_token_files(spark, tmp_path):
    rows = [(i * 7 % 29, t, 1) for i, t in enumerate(ODD)] + [(3, ODD[2], 2), (3, ODD[5], 3), (None, None, None), (1000, "The same. " * 5000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)
    path = str(tmp_path / "tokens")
    got = token_ids.token_id_round_trip(df, WORDS, path=path).collect()
    tk = token_ids.encoder(WORDS).tokenizer
    want = {}
    for i, t, _ in rows:
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 1]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id is not None for r in ordered] == sorted(r.doc_id is not None for r in ordered)
    assert [r.doc_id for r in ordered[1:]] == sorted(r.doc_id for r in ordered[1:])
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:i]) for i in range(len(ordered))]
    ids = {r.doc_id: r.ids for r in token_ids.read_token_files(spark, path, with_ids=True).collect()}
    assert ids[1000] == [*tk.encode("The same. " * 5000, add_special_tokens=False).ids, 1]
    assert token_ids.token_id_round_trip(df.where("false"), WORDS).count() == 0


def test_piece_digests(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(0, ODD[1], "y"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    m = pieces.model(PIECES)
    got = sorted(tuple(r) for r in pieces.piece_digests(df, PIECES).where("doc_id is not null").collect())
    want = sorted((i, *m.digests([t])[0]) for i, t, _ in rows if i is not None)
    assert got == want
    none = pieces.piece_digests(df, PIECES).where("doc_id is null").first()
    assert none.n_tokens == 0 and none.decoded_sha256 == hashlib.sha256(b"").hexdigest()
    back = {r.doc_id: r.decoded for r in pieces.piece_ids(df.where("doc_id = 2"), PIECES).collect()}
    assert back[2] == m.library.decode(m.library.encode(ODD[2]))
    assert pieces.piece_digests(df.where("false"), PIECES).count() == 0
