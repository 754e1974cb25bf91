import random
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from tessella.llm import simhash

SF = "/root/testdata/sf0.01"


def brute(rows):
    """Surviving ids by comparing all pairs that share a shingle."""
    def runs(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {i: runs(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by, empty = defaultdict(list), [i for i, s in sets.items() if not s]
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    pairs = {(a, b) for own in by.values() for k, a in enumerate(own) for b in own[:k]} | {(a, empty[0]) for a in empty}
    for a, b in pairs:
        x, y = sets[a], sets[b]
        if not x and not y or len(x & y) >= 0.8 * len(x | y) - 1e-9:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i for i in sets if find(i) == i}


def test_edited_copies_do_not_pass_the_stage(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    line = " ".join(word() for _ in range(12))
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.choice((8, 40, 200)))] + (line.split() if g % 2 else [])
        for c in range(8):
            text = list(base)
            for _ in range(c if len(base) > 20 else c // 4):
                text[rng.randrange(len(text))] = word()
            rows.append((g * 100 + c, " ".join(text)))
    rows += [(5000, None), (5001, ""), (5002, "two words"), (5003, "Two  WORDS")]
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    want = brute(rows)
    assert want <= kept and len(kept - want) <= 0.03 * len(rows) and len(kept) < 0.75 * len(rows)  # a trie join finds nine in ten pairs of 0.8


def test_stage_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept, want = {r.doc_id for r in simhash.one_of_each(docs).collect()}, brute(rows)
    assert want <= kept and len(kept - want) <= 0.002 * len(want)


def test_one_row_of_each_group_whatever_its_id(spark):
    same, far = "one text of several words that stands here often", "quite another text that has nothing to do with the first"
    rows = [(1, same, "a"), (1, same, "a"), (1, same, "b"), (None, same, "c"), (2, same, "d"), (7, far, "e"), (7, same + " and more of it " * 9, "f"), (None, None, "g"), (9, "", "h")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, sid string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, same), (7, far), (7, same + " and more of it " * 9), (9, "")])
    assert kept[0].__fields__ == ["doc_id", "text", "sid"]


def test_fingerprints_of_sets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 2, 3, 254, 255, 256, 600)] + [np.zeros(0, np.uint64)]
    got = simhash.set_fingerprints(sets, 2)
    alone = [simhash.set_fingerprints([s[i : i + 1] for i in range(len(s))], 2) for s in sets[:-1]]
    for g, each in zip(got, alone, strict=False):  # a member's own fingerprint has its bits
        bits = np.unpackbits(each.view(np.uint8).reshape(len(each), -1), axis=1).sum(0)
        assert (np.unpackbits(g.view(np.uint8)) == (2 * bits > len(each))).all()
    assert not got[-1].any()


@pytest.mark.parametrize("budget", (1, 2, 3, 4, 5))
def test_no_link_is_lost_in_cut_subtries(spark, budget):
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    mates = base.copy()
    for k, row in enumerate(mates):
        for bit in rng.choice(32, budget, replace=False):
            mates[k] = mates[k] ^ np.uint64(1 << int(bit) + 32)
    fp = np.unique(np.r_[base, mates])
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    label = np.arange(len(fp))
    a, b = np.triu_indices(len(fp), 1)
    near = np.bitwise_count(fp[a] ^ fp[b]) <= budget
    want = simhash._labels(len(fp), label.copy(), a[near], b[near])
    at = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    for rows in (1 if budget < 4 else 30, 20_000):  # with one row to a subtrie every shared one is cut as far as can be
        edges = simhash.links(df, budget, rows).collect()
        got = simhash._labels(len(fp), label.copy(), np.array([at[r.src] for r in edges]), np.array([at[r.dst] for r in edges]))
        assert (got == want).all()
