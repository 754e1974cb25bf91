import numpy as np
import pytest

from tessella.llm import ann, decontam, license_scan, urls
from tessella.llm.queries import ORACLE_SQL


def exact(rows, k, every):
    """Query id to [(vec_id, score)] by brute force."""
    ok = sorted({(i, tuple(v)) for i, v in rows})
    x = np.array([v for _, v in ok], np.float32).astype(float)
    out = {}
    for q, v in ok:
        if q % every == 0:
            s = x @ np.array(v, np.float32).astype(float)
            out[q] = [(ok[j][0], s[j]) for j in sorted((j for j in range(len(ok)) if ok[j][0] != q), key=lambda j: (-s[j], ok[j][0]))[:k]]
    return out


@pytest.mark.parametrize("kind", ("lengths", "one long", "unit"))
def test_recall_of_a_full_shard(kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(16_384, 64)).astype(np.float32)
    if kind == "one long":
        x[7] *= 1000
    if kind == "unit":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = ann.Graph.build(x)
    beam = graph.beam_for(21)
    q = x[rng.permutation(len(x))[:100]]
    truth = np.argsort(-(q.astype(np.float64) @ x.T.astype(np.float64)), 1)[:, :21]
    assert np.mean([len(set(a) & set(b)) / 21 for a, b in zip(graph.search(q, 21, beam), truth, strict=True)]) >= 0.95


@pytest.mark.parametrize("n,shard", ((3000, 700), (90, 8192)))
def test_recall(spark, n, shard):
    rng = np.random.default_rng(n)
    x = (rng.normal(size=(n, 24)) * rng.uniform(0.3, 2, (n, 1))).astype(np.float32)  # lengths differ
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, k=10, every=20, shard_rows=shard).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = exact(rows, 10, 20)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert all(abs(s - float(x[q].astype(float) @ x[v].astype(float))) < 1e-9 for _, v, s in found)
        assert [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
        hits += len({v for _, v, _ in found} & {v for v, _ in want[q]})
    assert hits / (10 * len(want)) >= (0.95 if n > 1000 else 1.0)


def test_vectors_that_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [2.0, 0.0]), (3, [0.0, 1.0]), (40, None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<float>, rank string")
    got = {}
    for r in ann.nearest(df, k=3, every=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {0: [(20, 2.0), (1, 1.0), (2, 1.0)], 20: [(0, 2.0), (1, 2.0), (2, 2.0)]}
    assert ann.nearest(df.where("false")).count() == 0
    assert ann.nearest(df.where("vec_id = 0")).count() == 0


def test_equal_vectors_keep_the_smallest_ids(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "vec_id long, embedding array<float>")
    for r in ann.nearest(df, k=4, every=100).collect():
        assert r.vec_id == [v for v in range(6) if v != r.query_id][r["rank"] - 1]


def test_doubles_stay_doubles(spark):
    rows = [(0, [0.1, 0.3]), (1, [0.2, 0.5]), (2, [1e300, -1e300]), (20, [-1.0, 1e-9])]
    got = {(r.query_id, r.vec_id): r.score for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect()}
    x = dict(rows)
    assert len(got) == 6 and all(s == x[q][0] * x[v][0] + x[q][1] * x[v][1] for (q, v), s in got.items())


def test_tight_groups_far_apart(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(5, 16)) * 10
    x = np.concatenate([centres[k] + 0.01 * rng.normal(size=(n, 16)) for k, n in enumerate((90, 90, 90, 90, 900))]).astype(np.float32)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = exact(rows, 10, 20)
    for shard in (400, 16_384):
        got = {}
        for r in ann.nearest(df, k=10, every=20, shard_rows=shard).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert sum(len(got[q] & {v for v, _ in w}) for q, w in want.items()) >= 0.95 * 10 * len(want)


def edit(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_myers_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        pattern, text = rng.integers(0, 4, rng.integers(1, 8)).tolist(), rng.integers(0, 4, 12).tolist()
        peq = {}
        for i, c in enumerate(pattern):
            peq[c] = peq.get(c, 0) | 1 << i
        best, end = decontam.myers(peq, len(pattern), text)
        assert best == min(edit(pattern, text[a:b]) for a in range(13) for b in range(a, 13))
        assert min(edit(pattern, text[a:end]) for a in range(end + 1)) == best


def test_leaks(spark):
    rng = np.random.default_rng(4)
    item = "The quick onyx goblin jumps over the lazy dwarf while seven wizards vex a bold quartz judge near Île"
    other = " ".join(f"t{i}" for i in range(30))
    words = item.split()
    few, many = list(words), list(words)
    few[3], few[9] = "CHANGED", "too"
    del few[14]
    for i in (2, 4, 6, 8, 10, 12, 14):
        many[i] = f"z{i}"
    noise = lambda n: " ".join(f"n{rng.integers(9999)}" for _ in range(n))
    texts = [f"{noise(50)} {item.upper()} {noise(9)}", f"{noise(5)} {', '.join(few)}.", f"{noise(5)} {' '.join(many)}", noise(200), None, "", item, f"{noise(3)} {other} {noise(40000)} {item}", " ".join(words[:10])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, item, "x")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(1, item), (2, other), (3, item.lower()), (4, None), (5, "two words"), (None, item), (6, "")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance) for r in decontam.leaks(docs, bench).where("doc_id is not null and item_id is not null").collect())
    assert {(r.doc_id, r.distance) for r in decontam.leaks(docs, bench).where("doc_id is not null and item_id is null").collect()} == {(0, 0), (1, 3), (6, 0), (7, 0)}
    assert got == sorted([(d, i, n) for d, n in ((0, 0), (0, 0), (1, 3), (6, 0), (7, 0)) for i in (1, 3)] + [(7, 2, 0)])
    assert decontam.leaks(docs, bench, block_chars=20).count() == decontam.leaks(docs, bench).count()
    kept = decontam.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [2, 3, 4, 5, 8]
    assert decontam.leaks(docs.where("false"), bench).count() == decontam.leaks(docs, bench.where("false")).count() == 0


def test_short_items_and_items_without_id(spark):
    docs = spark.createDataFrame([(1, "some Short, item here"), (2, "short thing item"), (3, "item short"), (4, "a passage of six plain words follows")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "short item"), (None, "passage of six plain words"), (3, "?!")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()} == {(1, 1), (4, None)}
    assert {r.doc_id for r in decontam.decontaminated(docs, bench).collect()} == {2, 3}


def test_leaks_against_brute_force():
    rng = np.random.default_rng(6)
    letters = [b"a", b"b", b"c", b"d", b"e"]
    for _ in range(30):
        items = [(k, b" ".join(rng.choice(letters, rng.integers(1, 9)))) for k in range(6)]
        text = list(rng.choice(letters, 25))
        got = {k: d for k, d, _ in decontam.Matcher(items, 0.8).matches(text)}
        for k, item in items:
            ws = item.split()
            best = min(edit(ws, text[a:b]) for a in range(26) for b in range(a, min(25, a + 12) + 1))
            assert got.get(k) == (best if best <= int(0.2 * len(ws) + 1e-9) else None)


def test_notices_against_brute_force():
    rng = np.random.default_rng(7)
    df = {b"license": 90, b"the": 99, b"software": 50}
    index = license_scan.Index(license_scan.NOTICES, 100, df)
    notices = [license_scan.words(n[1].encode()) for n in license_scan.NOTICES]
    for _ in range(300):
        ws = []
        for _ in range(rng.integers(1, 6)):
            n = list(notices[rng.integers(len(notices))])
            a = rng.integers(0, len(n))
            ws += n if rng.random() < 0.5 else n[a : a + rng.integers(1, 12)]
            ws += [b"license", b"x", b"version", b"mit"][: rng.integers(0, 5)]
        # a whole notice is always found, and a label without its key phrases never
        line = b" " + b" ".join(ws) + b" "
        got, score = index.labels(ws)
        for (label, _, keys), n in zip(license_scan.NOTICES, notices, strict=True):
            if b" " + b" ".join(n) + b" " in line:
                assert label in got and score == 1
        for label in got:
            assert any(all(b" " + b" ".join(license_scan.words(k.encode())) + b" " in line for k in keys) for own, _, keys in license_scan.NOTICES if own == label)


def brute_base(text):
    import re

    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    at, labels = [], set()
    for label, phrase in license_scan.BASE.items():
        p = phrase.split()
        hit = [i for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
        at += hit
        labels |= {label} if hit else set()
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licenses(spark):
    texts = ["Released under the MIT License.", "x Licensed under the Apache License, Version 2.0. y", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "under the mit under the mit license license", "cc by nc cc by nc", None, "", "mit", "É under THE\tMIT\x00License…x", "license " * 30000, "the apache tribe", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1), (None, None, None)], "doc_id long, text string, labels int")
    got = license_scan.scan_licenses(df).collect()
    assert len(got) == len(texts) + 2
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        r = by[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t or "")
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert [by[i].labels for i in (0, 1, 2, 3, 11, 12)] == ["mit", "apache-2", "cc-by-nc", "gpl-3", "", "mit"]
    assert license_scan.scan_licenses(df.where("false")).count() == 0


def test_urls(spark):
    link = lambda u: f'<html><head><LINK href="{u}" rel="canonical"></head>'
    hop = lambda u: f"<meta http-equiv='refresh' content='0; url={u}'>"
    rows = [
        (1, "http://a.example.com/en/1", None), (2, "https://x.org/z", link("http://a.example.com/en/1")), (3, "https://y.org/z", hop("https://x.org/z#top")), (4, "http://example.com/en/7x", ""), (5, "http://q.org/1", link("http://example.com/en/7x")),
        (6, None, None), (7, "no scheme", None), (8, "http://EXAMPLE.com", None), (9, "http://deep.example.net/de/89?u=/es/", None), (10, "ftp://w.net/de/", None), (11, "http://notcom/en/", None), (12, "http://k.org/es/", None), (13, "http://www.k.org/p?utm_source=f", link("/es/")),
        (14, "http://x.org/z.html", None), (15, "http://both.org/1", link("http://example.com/en/7x") + hop("http://b.com/en/1")), (1, "http://a.example.com/en/1", None),
    ]
    rows += [(20, "http://s.org/a/b/c.html", link("../d?x=1")), (21, "http://s.org/a/d?x=1", link("http://c.com/en/1")), (22, "http://s.org/q", link("?id=3")), (23, "http://s.org/q?id=3", link("e/./f")), (24, "http://s.org/e/f", link("http://c.com/en/1")), (25, "http://s.org/g", link("mailto:a@b.com")), (26, "http://t.org", link("h"))]
    rows += [(27, "http://t.org/h", link("../../../i")), (28, "http://t.org/i", link("http://b.com/en/2"))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, verdict string")
    got = {r.page_id: r for r in urls.filter_urls(df).collect()}
    assert urls.filter_urls(df).count() == len(rows)
    assert {i: r.rule for i, r in got.items() if r.rule} == {1: "com/en/", 4: "example.com/en/7", 9: "example.net/de/8", 10: "net/de/", 12: "org/es/"}
    assert {i for i, r in got.items() if r.verdict == "block"} == {1, 2, 3, 10, 12, 13, 14, 20, 21, 22, 23, 24, 26, 27, 28}
    assert (got[6].host, got[6].path, got[8].host, got[8].path, got[9].path) == ("", "", "example.com", "", "/de/89")
    more = spark.createDataFrame([("http://q.org/1", "http://r.org/2"), (None, "x")], "src string, dst string")
    assert {r.verdict for r in urls.filter_urls(df.where("page_id in (4, 5)"), extra_edges=more).collect()} == {"allow"}
    assert urls.filter_urls(df.where("false")).count() == 0


def test_sql(spark):
    import duckdb

    from tessella.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert "op10_urls" in ORACLE_SQL
    for name, sql in ORACLE_SQL.items():
        a, b = QUERIES[name](spark, sf).toPandas(), c.execute(sql).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns)
        a, b = (x[cols].fillna("-").sort_values(cols).reset_index(drop=True) for x in (a, b))
        assert a.equals(b.astype(a.dtypes)), name
