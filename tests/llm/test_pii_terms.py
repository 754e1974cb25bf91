import math
import random
import re
from collections import defaultdict

from tessella.llm import pii


def test_revealing_terms_go_wherever_they_stand(spark):
    filler = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}ord" for i in range(300)]
    line = lambda i, n=40: " ".join(filler[(i * 7 + j * (i % 11 + 3)) % 300] for j in range(n))
    rows = [(i, f"{line(i)} zed@corp.example.com {line(i + 50, 30)} Zorbatine {line(i + 90)} zorbatine") for i in range(2)]  # two texts, over 8 words away
    rows += [(i, line(i)) for i in range(10, 60_000)]
    named = f"{line(5)} ZORBATINE {line(6)}"  # without the value
    rows += [(2, named)]
    got = {r.doc_id: r.spans for r in pii.find_private(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id < 20 or spans <> ''").collect()}
    texts = dict(rows)
    for i in (0, 1, 2):
        ends = [(int(a), int(b)) for k, a, b in (s.split(":") for s in got[i].split(",")) if k == "term"]
        assert {texts[i][a:b].lower() for a, b in ends} == {"zorbatine"} and len(ends) == (1 if i == 2 else 2)
    assert all(s == "" for i, s in got.items() if i > 2)
    clean = {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame(rows[:2] + rows[-1:] + rows[2:50_000], "doc_id long, text string")).where("doc_id < 3").collect()}
    assert len(clean) == 3 and all("zorbatine" not in t.lower() for t in clean.values())


def test_terms_against_brute_force(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = ["".join(rng.choices(letters, k=6)) for _ in range(400)]
    docs = [(i, [rng.choice(vocabulary) for _ in range(14)]) for i in range(300)]
    for v in range(5):
        for k, i in enumerate(rng.sample(range(300), 6)):
            docs[i][1].insert(rng.randrange(14), f"v{v}@mail.example.com")
            for name, most in ((f"often{'abcde'[v]}x", 5), (f"half{'abcde'[v]}x", 3), (f"Once{'abcde'[v]}x", 1)):
                if k < most:
                    docs[i][1].insert(rng.randrange(14), name)
    docs += [(300 + i, [f"half{'abcde'[i % 5]}x", *rng.choices(vocabulary, k=10)]) for i in range(40)]  # the term without the value
    rows = [(i, " ".join(w)) for i, w in docs]
    rows += [(900 + i, rows[i][1]) for i in range(20)]  # copies
    values, terms = defaultdict(set), defaultdict(set)
    for i, text in rows:
        for w in text.split():
            (values if "@" in w else terms)[w.lower()].add(i)
    text_of, n = dict(rows), len(rows)
    tests = len(values) * len(terms)
    flagged = set()
    for c, in_c in values.items():
        for t, in_t in terms.items():
            both = in_c & in_t
            k = len({text_of[i] for i in both})
            if not both:
                continue
            mean = len(in_c) * len(in_t) / n
            share = math.log(n * len(both) / (len(in_c) * len(in_t))) / math.log(n / len(in_c))
            if share >= 0.6 and k * math.log(k / mean) - k + mean >= math.log(tests):
                flagged.add(t)
    assert 5 <= len(flagged) <= 40
    got = {r.doc_id: r.spans for r in pii.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        want = [(m.start(), m.end()) for m in re.finditer("[^ ]+", text) if m.group().lower() in flagged]
        ends = [s.split(":") for s in got[i].split(",") if s.startswith("term:")]
        assert [(int(a), int(b)) for _, a, b in ends] == want, text


def test_very_many_spans_in_one_text(spark):
    n = 20_000
    text = " ".join(f"user{i}@example{i % 7}.com wo{i}rd" for i in range(n))
    df = spark.createDataFrame([(1, text), (2, "1 " * 200_000), (3, "a@b" + ".c" * 100_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_private(df).collect()}
    assert got[1].n_email == n and got[2].n_card == 0 and got[3].n_email == 1
    assert got[1].spans == ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"user[^ ]+", text))
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert clean[1] == re.sub(r"user[^ ]+", "[EMAIL]", text) and clean[3] == "[EMAIL]"


def test_near_copies_against_brute_force(spark):
    rng = random.Random(8)
    base = {e: [rng.randrange(1 << 40) for _ in range(100)] for e in "ab"}
    shared, sketches = [], []
    for e in "ab":
        for i in range(60):
            own = list(base[e])[: rng.choice([100, 100, 40])]
            for r in rng.sample(range(len(own)), int(len(own) * rng.choice([0, 0.05, 0.2, 0.4, 0.7, 1]))):
                own[r] = rng.randrange(1 << 40)
            key = f"{rng.randrange(10**9):09d}"
            shared.append((e, key))
            sketches.append((key, sorted(set(own))[:64]))
    of = dict(sketches)
    groups = {x: {x} for x in shared}
    for e, key in shared:
        for h in of[key][:12]:
            met = [k for f, k in shared if f == e and h in of[k][:12]]
            for end in (min(met), max(met)):
                both = sorted(set(of[key]) | set(of[end]))[:64]
                if len(set(both) & set(of[key]) & set(of[end])) >= len(both) / 2 and groups[e, key] is not groups[e, end]:
                    groups[e, end] |= groups[e, key]
                    for x in groups[e, key]:
                        groups[x] = groups[e, end]
    got = pii._near_copies(spark.createDataFrame(shared, "entity string, key string"), spark.createDataFrame(sketches, "key string, sketch array<long>")).collect()
    left = set(shared) - {tuple(r) for r in got}
    assert len(left) == len({id(g) for g in groups.values()}) and all(len(left & g) == 1 for g in groups.values()) and 10 < len(left) < 100


def test_templates_are_no_copies_and_edits_are(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    long = [word() for _ in range(300)]
    edited = [" ".join(word() if rng.random() < 0.03 else w for w in long) for _ in range(20)]
    templated = [f"{word()} {word()} write to our office at once {word()} {word()}" for _ in range(4)]
    docs = spark.createDataFrame([(t,) for t in edited + templated], "text string")
    sketches = docs.select(pii.F.col("text").alias("key"), pii._sketch(pii.F.col("text")).alias("sketch"))
    got = {r.key for r in pii._near_copies(sketches.select(pii.F.lit("v").alias("entity"), "key"), sketches).collect()}
    assert got < set(edited) and len(got) == 19
