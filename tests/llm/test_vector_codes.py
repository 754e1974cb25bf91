import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tessella.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def brute(rows, parts=16, entries=64, rounds=2):
    """vec_id, code, error, label_error of all rows, and the digest, in Python integers."""
    fine = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    width = len(fine[0][1])
    ints = [[math.floor(256 * x) for x in r[1]] for r in fine]
    cut = vc.cuts(width, parts)
    order = sorted(range(len(fine)), key=lambda i: (fine[i][0] is None, fine[i][0] or 0, fine[i][1]))[:entries]
    books = [[ints[i][cut[p] : cut[p + 1]] for i in order] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v in ints:
                own[nearest(v[cut[p] : cut[p + 1]], books[p])[1]].append(v[cut[p] : cut[p + 1]])
            books[p] = [[sum(c) // len(c) for c in zip(*own[e])] if e in own else c for e, c in enumerate(books[p])]
    found = [[nearest(v[cut[p] : cut[p + 1]], books[p]) for p in range(parts)] for v in ints]
    errors = [sum(d for d, _ in f) for f in found]
    labels = defaultdict(int)
    for r, e in zip(fine, errors):
        labels[r[2]] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    key = lambda t: tuple((x is None, x) for x in t)
    return sorted(((r[0], "".join(f"{e:02x}" for _, e in f), s, labels[r[2]], digest) for r, f, s in zip(fine, found, errors)), key=key)


def ran(spark, rows, **options):
    out = vc.vector_codes(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), **options)
    return sorted((tuple(r) for r in out.collect()), key=lambda t: tuple((x is None, x) for x in t))


def rows(n, width, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    x = (rng.normal(0, spread, (n, width)) + rng.integers(-2, 3, (n, 1))).astype(np.float32)
    return [(int(i), x[i].tolist(), int(rng.integers(0, 4))) for i in rng.permutation(n)]


def test_against_brute_force(spark):
    r = rows(300, 32)
    r += [(1000 + i, r[5][1], None) for i in range(40)]  # copies, ties, null labels
    r += [(2000, None, 1), (2001, [], 1), (2002, [None] * 32, 1), (2003, [math.nan] + [0.0] * 31, 1), (2004, [math.inf] * 32, 1), (7, r[3][1], 2), (None, r[4][1], 2), (2005, [1.0] * 16, 1)]
    want = brute([x for x in r if x[0] != 2005])
    assert ran(spark, r) == want and len(want) == 342


def test_fewer_rows_odd_lengths_and_other_parameters(spark):
    r = rows(20, 10, 3)
    assert ran(spark, r, parts=4, entries=8, rounds=3, groups=3) == brute(r, 4, 8, 3)
    assert ran(spark, r[:5]) == brute(r[:5])
    assert ran(spark, r, rounds=0) == brute(r, rounds=0)
    assert ran(spark, [(i, [0.5] * 16, None) for i in range(70)]) == brute([(i, [0.5] * 16, None) for i in range(70)])
    with pytest.raises(ValueError):
        ran(spark, r, entries=300)


def test_large_components_stay_exact(spark):
    rng = random.Random(1)
    r = [(i, [float(rng.randrange(-(10**6), 10**6)) for _ in range(16)], 0) for i in range(90)]
    assert ran(spark, r) == brute(r)


def test_empty(spark):
    assert ran(spark, []) == [] and ran(spark, [(1, None, 1)]) == []


def test_bounds_hold_and_save_scans():
    rng = np.random.default_rng(4)
    for trial in range(30):
        n, k, d = int(rng.integers(1, 300)), int(rng.integers(1, 65)), int(rng.integers(1, 6))
        x = rng.integers(-6, 7, (n, d)) if trial % 2 else rng.integers(-300, 300, (n, d))
        book = vc.Book(x[: min(k, n)].copy(), vc.grouped(x[: min(k, n)], 6))
        own, best, upper, lower = book.assign(x)
        scans = seen = 0
        for _ in range(4):
            entries = np.array([x[own == e].sum(axis=0) // (own == e).sum() if (own == e).any() else c for e, c in enumerate(book.entries)])
            book = book.moved(entries)
            own, best, upper, lower, s = book.reassign(x, own, upper.astype(np.float32).astype(float), lower.astype(np.float32).astype(float))
            d2 = vc.squared(x, entries)
            assert (d2.argmin(axis=1) == own).all() and (d2.min(axis=1) == best).all()
            for g, m in enumerate(book.members):
                others = np.where(m[None, :] == own[:, None], np.inf, np.sqrt(d2[:, m]))
                assert (lower[:, g] <= others.min(axis=1)).all()
            assert (upper >= np.sqrt(best)).all()
            scans, seen = scans + s, seen + n * len(book.members)
        assert scans < seen * 0.6


def test_decoded(spark):
    r = rows(100, 16, 9)
    coded, books = vc.fit_codes(spark.createDataFrame([(*x, "") for x in r], SCHEMA))
    vectors = dict((i, np.array(v)) for i, v, _ in r)
    for row in vc.decoded(coded, books).collect():
        ints = np.floor(256 * vectors[row.vec_id])
        assert row.error == ((ints - (np.array(row.vector) * 256 - 0.5)) ** 2).sum()
