import random

from tessella.llm import simhash


def test_a_large_group_of_near_copies_gives_few_candidates_a_member(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [word() for _ in range(400)]
    rows = []
    for k in range(400):
        text = list(base)
        for _ in range(2):
            text[rng.randrange(len(text))] = word()
        rows.append((k, " ".join(text)))
    made = []
    stored = simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, name: (made.append(df.count()) if name == "candidates" else None) or stored(df, name))
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in kept] == [0]
    assert sum(made) <= 6 * len(rows), made
