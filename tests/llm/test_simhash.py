import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import simhash as S
from tessella.llm.graph import connected_components


def brute(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB \t\x0b\x1c\x85é本ÀZ.", max_size=60))
def test_fingerprints(text):
    assert S.simhash(text.encode()) == brute(text)


def brute_labels(fp, budget=2):
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= budget
    label = np.arange(len(fp))
    while True:
        new = np.where(near, label[None], len(fp)).min(1)
        if (new == label).all():
            return label
        label = new


def cluster(seed, n=40):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
    rows = [base]
    for k in (1, 2, 3):
        flipped = base.copy()
        for _ in range(k):
            flipped ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        rows.append(flipped)
    return np.unique(np.concatenate(rows))


def test_trie_join():
    for seed in range(4):
        fp = cluster(seed)
        for block in (1 << 18, 7):
            assert (S.trie_join(np.zeros(len(fp), int), fp, 2, block) == brute_labels(fp)).all()
    assert len(S.trie_join(np.zeros(0, int), np.zeros(0, np.uint64), 2)) == 0


def components(fp, edges):
    parent = {int(x): int(x) for x in fp}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in parent}


def test_links_with_hot_groups(spark):
    """A dense ball of fingerprints: groups are cut again and again, and no link is lost."""
    rng = np.random.default_rng(7)
    ball = np.unique(np.uint64(0x123456789ABCDEF0) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)))
    fp = np.unique(np.concatenate([ball, cluster(3)]))
    signed = [int(x) for x in fp.view(np.int64)]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute_labels(fp)
    for group in (20_000, 30):
        edges = [(r.src, r.dst) for r in S.links(df, 2, group).collect()]
        got = components(signed, edges)
        groups = {}
        for x, label in zip(signed, want, strict=True):
            groups.setdefault(label, set()).add(got[x])
        assert all(len(g) == 1 for g in groups.values())
        assert len(set(got.values())) == len(set(want))


def test_near_duplicates(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(3000)]
    base = [" ".join(rng.choice(words, 120)) for _ in range(12)]
    texts = []
    for t in base:
        w = t.split()
        texts += [t, t.upper().replace("W", "W"), " ".join([*w, "extra"]), "\t".join(w)]
    texts += [None, "", "  ", "one", "One", "two words", "two words", "x " * 20000, "x " * 20000]
    rows = [(i + 3, t, "clash", i) for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[0], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int").repartition(3)
    got = S.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = {(r.doc_id, r.fingerprint) for r in got}
    assert fps == {(i, f"{brute(t or ''):016x}") for i, t, *_ in rows}
    uniq = np.unique(np.array([brute(t or "") for _, t, *_ in rows], np.uint64))
    label = dict(zip(uniq.tolist(), brute_labels(uniq), strict=True))
    least = {}
    for i, t, *_ in rows:
        k = label[brute(t or "")]
        least[k] = min(x for x in (least.get(k), i) if x is not None) if least.get(k) is not None or i is not None else None
    assert {(r.doc_id, r.component_id) for r in got} == {(i, least[label[brute(t or "")]]) for i, t, *_ in rows}
    assert S.near_duplicates(df.where("false")).count() == 0


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(51)} | {k: 100 for k in range(100, 130)} | {200: 200, 201: 200}
    names = spark.createDataFrame([("b", "a"), ("c", "b")], "src string, dst string")
    assert {r.component for r in connected_components(names).collect()} == {"a"}
    assert connected_components(names.where("false")).count() == 0
