import hashlib
import re

from tessella.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(v):
    d = [int(c) for c in v if c.isdigit()]
    return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0


VALID = {"email": lambda v: True, "ip": lambda v: all(int(x) <= 255 for x in v.split(".")), "card": luhn, "phone": lambda v: 10 <= sum(c.isdigit() for c in v) <= 15}


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if VALID[kind](m.group())]
    return sorted(out)


ODD = ["a@b.c_x@d.e.f", "a@b.c.", "1.2.3.4.5.6.7.8", "1.2.3.999", "01.02.003.4", "4111 1111 1111 1111", "4111-1111-1111-11110", "+1 (555) 555-3824 x", "éé a@b.co 😀 +12 345 678 9012.", "1" * 5000, "a" * 5000 + "@", None, "", "x@y@z.w", "12@1.2.3.4", "+1 +1 555 555 5555", "1.2.3.4@5.6", "a@b-c.d-.e", "4000 0000 0000 0002 1", "9" * 14 + " 4111111111111111", ("word " * 30000) + "q@w.er"]


def test_base_spans_and_replacement(spark):
    rows = [(i, t, i, "x") for i, t in enumerate(ODD)] + [(0, ODD[0], 9, "x"), (None, "z@z.zz", 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int, key string")
    got = pii.find_private(df).collect()
    assert len(got) == len(rows)
    by_id = dict((i, t) for i, t, *_ in rows)
    for r in got:
        spans = brute(by_id[r.doc_id] or "")
        base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[3] == k for s in spans) for k in PLAIN]
        assert r.spans == base
    clean = {r.doc_id: r for r in pii.sanitised(df).collect()}
    assert pii.sanitised(df).columns == df.columns
    assert clean[8].text == "éé [EMAIL] 😀 [PHONE]." and clean[8].key == "x" and clean[8].spans == 8
    assert clean[11].text is None and clean[12].text == "" and clean[9].text == ODD[9]
    assert clean[None].text == "[EMAIL]"
    assert pii.find_private(df.where("false")).count() == 0 and pii.sanitised(df.where("false")).count() == 0


def test_terms_that_give_values_away(spark):
    filler = ["north wind blows over hills", "quiet river under stone bridge", "garden wall behind old house", "paper boats along the canal", "seven lamps before winter", "slow train across the plain"]
    rows = [(i, f"{filler[i]} meet Zorbatine at zed@corp.example.com near {filler[-1 - i]} today {i} done") for i in range(6)]
    rows += [(10 + i, f"{filler[i % 6]} and today the {filler[(i + 1) % 6]} line {i}") for i in range(40)]
    got = {r.doc_id: r.spans for r in pii.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows[:6]:
        at = text.index("Zorbatine")
        assert f"term:{at}:{at + 9}" in got[i].split(",")
        assert any(s.startswith("email:") for s in got[i].split(","))
    assert all(got[i] == "" for i, _ in rows[6:])
    assert not any("today" == rows[i][1][int(a) : int(b)] for i in range(6) for k, a, b in (s.split(":") for s in got[i].split(",")) if k == "term")
    clean = pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 0").first().text
    assert "Zorbatine" not in clean and "zed@corp" not in clean and "north wind blows over hills" in clean


def test_copies_are_no_evidence(spark):
    rows = [(i, "somebody Qwertyman writes from q@w.er about nothing much") for i in range(20)]
    got = pii.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.spans for r in got} == {"email:31:37"}
