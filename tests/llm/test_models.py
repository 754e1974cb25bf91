import zlib

import numpy as np
import pytest

from tessella.llm import langid, quality

SF = "/root/testdata/sf0.01"


def test_gradient():
    net = langid.Network(["a", "b", "c"], 5)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (6, 8)).astype(np.uint8), rng.integers(0, 3, 8)
    _, grad = net.gradient(x, y)
    for name, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        own, e = net.p[name][at], 1e-2
        net.p[name][at] = own + e
        up = net.gradient(x, y)[0]
        net.p[name][at] = own - e
        down = net.gradient(x, y)[0]
        net.p[name][at] = own
        assert abs((up - down) / (2 * e) - g[at]) < 0.02 * abs(g[at]) + 1e-4, name


def one_by_one(net, text, p):
    """A direction's states by its formulas, a byte at a time."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    h, out = np.zeros(net.size), []
    for c in text:
        g = net.p[p + "x"][c] + h @ net.p[p + "u"]
        r, z = sig(g[: net.size]), sig(g[net.size :])
        n = np.tanh(net.p[p + "y"][c] + (r * h) @ net.p[p + "w"])
        h = n + z * (h - n)
        out.append(h)
    return np.array(out).reshape(-1, net.size)


def test_whole_texts_are_read_in_context():
    net = langid.Network(["a", "b", "c"], 4)
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (700, 1, 33, 32, 64)] + [b""]
    got = net.pooled(texts, span=32, lead=16, rows=7)
    for text, p in zip(texts, got, strict=True):
        total = np.zeros(3)
        for a in range(0, len(text), 32):
            b, lo, hi = min(a + 32, len(text)), max(0, a - 16), min(len(text), a + 48)
            f = one_by_one(net, text[lo:b], "f")[a - lo :]
            back = one_by_one(net, text[a:hi][::-1], "b")[::-1][: b - a]
            q = np.exp(np.c_[f, back] @ net.p["v"] + net.p["c"])
            total += (q / q.sum(1, keepdims=True)).sum(0)
        assert np.allclose(p, total / len(text) if text else 1 / 3, atol=1e-4)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_held_out_accuracy(spark, documents):
    got = {r.doc_id: r for r in langid.identify(documents).collect()}
    rows = documents.select("doc_id", "lang").collect()
    assert len(got) == len(rows)
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if got[r.doc_id].held_out]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edge_cases(spark):
    texts = ["abc abd abe abc", "xyz xzz yyx zzy"] * 6
    rows = [(i, t, "one" if i % 2 == 0 else "two", "s") for i, t in enumerate(texts)]
    rows += [(90, None, "one", "s"), (91, "", "one", "s"), (92, "123 !!", "two", "s"), (93, "é", None, "s"), (None, "abc", "one", "s"), (0, texts[0], "one", "s"), (94, "abc " * 30000, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.identify(df, steps=60).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (90, 91, 92)] == ["und"] * 3 and by[90].score == 0
    assert by[94].lang_pred in ("one", "two") and by[None].held_out is False
    unlabelled = langid.identify(df.where("lang is null")).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
    assert langid.identify(df.where("false")).count() == 0


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}".encode() for i in range(200)]
    marks = {0: b"awful", 1: b"plain", 2: b"lovely"}
    hashes = quality.WordHashes()
    rows, grades = [], []
    for i in range(600):
        g = i % 3
        words = list(rng.choice(vocabulary, 30)) + [marks[g]] * 2
        rows.append(quality.features(b" ".join(words), hashes, 16))
        grades.append(g)
    y = np.array(grades)
    model = quality.Ordinal.fit(rows[:400], y[:400], 16, 3)
    assert (np.diff(model.thresholds) >= 0).all()
    p = model.above(np.array([model.weights[a] @ x for a, x in rows[400:]]))
    expected = p.sum(1)
    assert [expected[y[400:] == g].mean() for g in range(3)] == sorted(expected[y[400:] == g].mean() for g in range(3))
    assert (np.round(expected) == y[400:]).mean() > 0.85


def test_quality_on_held_out_labels(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    some = labels.where("crc32(cast(doc_id as string)) % 3 <> 0")
    got = {r.doc_id: r for r in quality.quality(documents, some).collect()}
    rest = [r for r in labels.where("crc32(cast(doc_id as string)) % 3 = 0").collect()]
    good, bad = ([got[r.doc_id].tail for r in rest if not r.toxic and r.quality == q] for q in (1, 0))
    assert np.mean(good) > np.mean(bad) + 0.2
    assert np.mean([got[r.doc_id].selected for r in rest if not r.toxic]) > 0.95


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, "good good text", 7), (2, None, 7), (3, "", 7), (1, "good good text", 7), (None, "x", 7), (4, "word " * 50000, 7)], "doc_id long, text string, grade int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 1), (3, None, None), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.grade for r in quality.graded(labels).collect()} == {1: 1, 2: 0, 99: 2}
    got = quality.quality(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.tail <= r.not_toxic <= 1 for r in got)
    assert all(r.grade is None for r in quality.quality(docs, labels.where("false")).collect())
    assert quality.quality(docs.where("false"), labels).count() == 0


def test_fits_are_bounded(spark):
    one = spark.range(100_000).selectExpr("1L as doc_id", "'one and the same text' as text", "'en' as lang")
    many = spark.range(3000).selectExpr("id as doc_id", "concat('text of ', id) as text", "concat('l', id) as lang")
    net = langid.fit_language(one.unionByName(many), sample=20, labels=8, steps=2)
    assert len(net.langs) <= 8 and "en" in net.langs
    labels = spark.range(5000, 9000).selectExpr("id as doc_id", "1 as quality", "0 as toxic").unionByName(spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int"))
    fitted = quality.fit_quality(one, quality.graded(labels), sample=50)  # labels of absent documents are passed over
    assert fitted is not None and len(np.flatnonzero(fitted.weights)) <= 5


def test_ordinal_likelihood_against_a_plain_optimiser():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)).astype(np.float32)
    y = np.digitize(x @ [1.0, -0.5, 0.2] + rng.logistic(size=300) * 0.7, [-0.5, 0.8])
    rows = [(np.arange(3, dtype=np.int32), v) for v in x]

    def loss(w, t):
        s = x @ w
        hi, lo = (1 / (1 + np.exp(-np.clip(np.r_[-np.inf, t, np.inf][y + k] - s, -50, 50))) for k in (1, 0))
        share = (1 / (np.bincount(y) * 3))[y]
        return -(share * np.log(np.maximum(hi - lo, 1e-12))).sum()

    model = quality.Ordinal.fit(rows, y, 2, 3, steps=3000)
    best, at, step = np.inf, np.zeros(5), 0.5
    while step > 1e-4:  # coordinate search
        moved = False
        for i in range(5):
            for d in (step, -step):
                new = at.copy()
                new[i] += d
                if new[3] <= new[4] and (v := loss(new[:3], new[3:])) < best:
                    best, at, moved = v, new, True
        step = step if moved else step / 2
    assert loss(model.weights[:3], model.thresholds) < best + 0.01
