import math
import random
import re
from collections import Counter

import numpy as np

from tessella.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    own = [(d, Counter(terms(t))) for d, t in docs]
    own = [(d, c) for d, c in own if c]
    n_docs, n_terms = len(own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in own:
            m = 75 + 25 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return Counter(out)


def got(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, term string")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    return Counter(tuple(r) for r in ranked.ranked(d, i, **options).collect())


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    return [(i, " ".join(words[int(300 * rng.random() ** 3)] for _ in range(rng.choice([1, 5, 40, 200])))) for i in range(n)]


def test_against_brute_force(spark):
    docs = corpus(600)
    docs += [(None, docs[0][1]), (1, docs[1][1]), (2, "w0"), (700, None), (701, ""), (702, "--- !"), (703, "Été ÉTÉ été W1\x00w2\tw3"), (704, "w7 " * 30_000)]
    docs += [(800 + i, "tied words of one text w5") for i in range(60)]  # equal scores
    rng = random.Random(2)
    items = [(i, " ".join(f"W{rng.randrange(300)}" for _ in range(rng.choice([1, 3, 30])))) for i in range(40)]
    items += [(50, None), (51, ""), (52, "nowhere"), (None, "w1 w2"), (3, items[3][1]), (3, items[3][1]), (54, "tied words"), (55, "w7 w7 été w7")]
    want = brute(docs, items)
    assert got(spark, docs, items) == want and sum(want.values()) > 700


def test_blocks_and_small_shards(spark, monkeypatch):
    docs, items = corpus(400, 5), [(i, f"w{i} w{i * 3} w{i} w1") for i in range(30)]
    assert got(spark, docs, items, block_chars=60) == brute(docs, items)
    n_docs, n_terms = ranked.statistics(spark.createDataFrame(docs, "doc_id long, text string"))
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    index = ranked.build_index(df, n_docs, n_terms, shard_bytes=4000)
    assert index.select("shard").distinct().count() > 5
    counts = {r.term: r.df for r in index.where("term <> ''").groupBy("term").agg(ranked.F.expr("cast(sum(octet_length(docs) / 2) as long) AS df")).collect()}
    asked = ranked.Questions([(i, ranked.frequencies(t.encode())) for i, t in items], counts, n_docs)
    assert Counter(tuple(r) for r in ranked._best(index, asked, 20).select("item_id", "rank", "doc_id", "score").collect()) == brute(docs, items)


def test_whole_shard_and_pruning():
    docs = [(i, f"common {'rare ' * (i == 2500)}w{i % 50} filler{i}") for i in range(4096)]
    n_docs, n_terms = 4096, sum(len(terms(t)) for _, t in docs)
    builder = ranked.ShardBuilder(n_docs, n_terms)
    for d, t in docs:
        builder.add(d, t.encode())
    table = ranked.pa.Table.from_batches([builder.rows(0)])
    df = Counter(t for _, x in docs for t in set(terms(x)))
    asked = ranked.Questions([(0, Counter([b"rare"])), (1, Counter([b"w3", b"filler77"])), (2, Counter([b"common", b"rare"]))], dict(df), n_docs)
    shard = ranked.Shard(table, asked.number)
    opened = []
    search = shard.search
    shard.search = lambda *a: opened.append(search(*a))
    best = [[] for _ in asked.item_ids]
    asked.search(shard, best, 5)
    found = Counter((i, r, d, -s) for i, b in enumerate(best) for r, (s, _, d) in enumerate(b, 1))
    assert found == brute(docs, [(0, "rare"), (1, "w3 filler77"), (2, "common rare")], 5)
    assert opened[0] == 3  # the root, and one node of each size above the only document


def test_long_tokens_and_chunks():
    text = ("é" * 5000 + " " + "A" * 3000 + "-b " + "c d " * 700).encode()
    for step in (7, 64, 5001, 1 << 20):
        assert [t.decode() for part in ranked.terms(text, step) for t in part] == terms(text.decode())


def test_empty_tables(spark):
    for docs, items in (([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, None)])):
        out = ranked.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
        assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]
    assert np.array_equal(list(ranked.terms(b"")), [])
