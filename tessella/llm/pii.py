"""Personal data: patterns, and terms that give protected values away; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .graph import connected_components

# Kind and pattern. An address or number begins where its first run of characters does or where the last
# match ended, and possessive runs keep the search linear; the matches are those of the plain patterns
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+      ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card [0-9]([\x20-]?[0-9])+                                     phone \+[0-9][\x20().0-9-]+[0-9]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TERM = r"\p{L}{3,}+"
SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string,context:long>"
TERM_SPAN = "struct<start:int,end:int,action:string>"
#: elements that ``running`` folds by themselves
RUN = 128
#: a text's sketch is the SKETCH least hashes of its runs of three words; texts with any of the LEAST least in common are
#: compared, and are near copies from an estimated Jaccard similarity of ALIKE on (two copies, each edited in one word of twenty, have 0.58)
SKETCH, LEAST, ALIKE = 64, 12, 0.5


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def _most(values: Column) -> Column:
    return F.coalesce(F.array_max(values), F.lit(0))


def running(values: Column, fold: Callable[[Column], Column]) -> Column:
    """For each of an array's numbers the fold of all before it.

    Runs of RUN numbers are folded once, so that an element costs at most RUN steps and an
    array takes time in proportion to its length (a fold that builds an array copies it for
    each element).
    """
    run = lambda x: F.floor(x / RUN).cast("int")

    def element(s: Column) -> Column:
        return F.transform(s["v"], lambda _, i: fold(F.concat(F.array(F.get(s["upto"], run(i))), F.slice(s["v"], run(i) * RUN + 1, i % RUN))))

    def runs(v: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), run(F.size(v))), lambda b: fold(F.slice(v, b * RUN + 1, F.lit(RUN))))
        return _let(whole, lambda w: _let(F.struct(v.alias("v"), F.transform(w, lambda _, b: fold(F.slice(w, F.lit(1), b))).alias("upto")), element))

    return _let(values, runs)


def _cut_at(text: Column, pattern: str) -> Column:
    """hits of a pattern, gaps (one more) around them, and at: where each gap begins, in code points."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))

    def placed(s: Column) -> Column:
        size = F.transform(s["gaps"], lambda g, i: F.length(g) + F.coalesce(F.length(F.get(s["hits"], i)), F.lit(0)))
        return F.struct(s["hits"].alias("hits"), s["gaps"].alias("gaps"), running(size, _sum).alias("at"))

    return _let(parts, placed)


def matches(text: Column, pattern: str, reach: int = 160) -> Column:
    """start, end, value and context of a pattern's matches, leftmost first, without overlap, in code points.

    The context is a hash of what stands next to a match, back and on to the second match
    from it but ``reach`` characters at most; it only tells copies of a passage apart.
    """

    def found(s: Column) -> Column:
        def one(hit: Column, i: Column) -> Column:
            start = F.get(s["at"], i) + F.length(F.get(s["gaps"], i))
            none = F.lit("")
            before = F.substring(F.concat(F.coalesce(F.get(s["hits"], i - 1), none), F.get(s["gaps"], i)), -reach, reach)
            after = F.substring(F.concat(F.get(s["gaps"], i + 1), F.coalesce(F.get(s["hits"], i + 1), none)), 1, reach)
            return F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("value"), F.xxhash64(before, after).alias("context"))

        return F.transform(s["hits"], one)

    return _let(_cut_at(text, pattern), found)


def term_matches(text: Column) -> Column:
    """start, end and term (lower-cased) of the words outside e-mail addresses; the other kinds hold no letters."""

    def outside(s: Column) -> Column:
        def within(gap: Column, i: Column) -> Column:
            return F.transform(_let(_cut_at(gap, TERM), lambda t: F.transform(t["hits"], lambda h, j: F.struct((F.get(t["at"], j) + F.length(F.get(t["gaps"], j))).alias("start"), h.alias("value")))), lambda m: F.struct((F.get(s["at"], i) + m["start"]).alias("start"), (F.get(s["at"], i) + m["start"] + F.length(m["value"])).alias("end"), F.lower(m["value"]).alias("term")))

        return F.flatten(F.transform(s["gaps"], within))

    return _let(_cut_at(text, PATTERNS["email"]), outside)


def _luhn(value: Column) -> Column:
    def valid(digits: Column) -> Column:
        n = F.length(digits)

        def add(s: Column, i: Column) -> Column:
            d = F.substring(digits, n + 1 - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
            return (s + F.when(d > 9, d - 9).otherwise(d)).cast("int")

        return F.when(n.between(14, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)

    return _let(F.regexp_replace(value, "[^0-9]", ""), valid)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _possible(kind: str, text: Column) -> Column:
    """Whether a text can hold the kind at all; spares most texts the second pass."""
    if kind == "email":
        return text.contains("@")
    if kind == "ip":
        return text.rlike(r"[0-9]\.[0-9]")
    if kind == "card":
        return text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")
    return text.contains("+")


def _any_possible(text: Column) -> Column:
    out = F.lit(False)
    for kind in KINDS:
        out = out | _possible(kind, text)
    return out


def base_spans(text: Column) -> Column:
    """All valid matches as an array of (start, rank of the kind, end, kind, value, context), sorted."""
    none = F.array().cast(f"array<{SPAN}>")

    def of(rank: int, kind: str) -> Column:
        valid = F.filter(matches(text, PATTERNS[kind]), lambda x: _valid(kind, x["value"]))
        spans = F.transform(valid, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"), x["context"].alias("context")))
        return F.when(_possible(kind, text), spans.cast(f"array<{SPAN}>")).otherwise(none)

    return F.array_sort(F.concat(*(of(rank, kind) for rank, kind in enumerate(KINDS))))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key (SHA-256 of the text), spans and, of texts with any, sketch of every document."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.select("doc_id", "text", F.sha2("text", 256).alias("key"), F.when(_any_possible(F.col("text")), base_spans(F.col("text"))).otherwise(F.array().cast(f"array<{SPAN}>")).alias("spans"))
    return own.select("doc_id", "key", "spans", F.when(F.size("spans") > 0, _sketch(F.col("text"))).alias("sketch"))


def _terms(text: Column) -> Column:
    """The distinct words of a text outside its e-mail addresses."""
    outside = F.when(text.contains("@"), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(F.lower(outside), F.lit(TERM), F.lit(0)))


def _sketch(text: Column) -> Column:
    """The SKETCH least hashes of a text's runs of three words of letters, e-mail addresses left out: a value that texts share makes them no copies."""
    text = F.when(text.contains("@"), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    runs = lambda w: F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.slice(F.array_sort(F.array_distinct(_let(F.split(F.lower(text), r"[^\p{L}]+"), runs))), 1, SKETCH)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.sha2(text, 256).alias("key"), text.alias("text"))


def _set_of(*parts: str) -> list[Column]:
    """A 128-bit mark of a group's set of rows, which needs no list of them; rows must be distinct."""
    return [F.bit_xor(F.xxhash64(*parts, F.lit(k))).alias(f"set{k}") for k in (1, 2)]


def _near_copies(shared: DataFrame, sketches: DataFrame) -> DataFrame:
    """entity and key of the texts of ``shared`` (entity, key) that one text stands for in its group of near copies; ``sketches`` has key and sketch.

    Texts of an entity meet where one of their LEAST least hashes is equal, each only the smallest
    and the largest key there. The estimate is the share of the SKETCH least hashes of both that both have: the
    exact similarity if they have no more. Near copies of near copies are of one group.
    """
    met = shared.join(sketches, "key").select("entity", "key", F.explode(F.slice("sketch", 1, LEAST)).alias("h"))
    ends = met.groupBy("entity", "h").agg(F.array_distinct(F.array(F.min("key"), F.max("key"))).alias("ends"))
    pairs = met.join(ends, ["entity", "h"]).select("entity", "key", F.explode("ends").alias("first")).where("first <> key").distinct()
    pairs = pairs.join(sketches, "key").join(sketches.select(F.col("key").alias("first"), F.col("sketch").alias("other")), "first")
    both = F.slice(F.array_sort(F.array_union("sketch", "other")), 1, SKETCH)
    alike = F.size(F.array_intersect(both, F.array_intersect("sketch", "other"))) >= F.size(both) * F.lit(ALIKE)
    groups = connected_components(pairs.where(alike).select(F.xxhash64("entity", "key").alias("src"), F.xxhash64("entity", "first").alias("dst")))
    others = groups.where("node <> component").select("node")
    return shared.withColumn("node", F.xxhash64("entity", "key")).join(others, "node", "left_semi").select("entity", "key").distinct()


def disclosing(docs: DataFrame, scanned: DataFrame, text_col: str, generalise: float, remove: float, chance: float) -> DataFrame | None:
    """term and action of the terms that give a protected value away; None if no value can be proved to.

    A value c carries IC(c) = log(N / n(c)) of information; a term t reveals
    PMI(c; t) = log(N n(c,t) / (n(c) n(t))) of that. n counts documents: those with the
    value, with the term and with both, anywhere in them. From the share ``generalise``
    on a term is generalised, from ``remove`` on removed.

    The estimate itself must be more than chance: of k independent texts with both, where
    μ = n(c) n(t) / N were expected, chance gives that many with at most
    exp(−(k log(k / μ) − k + μ)) (Chernoff), and over all pairs of a value and a term of the
    corpus there may be ``chance`` such. Of the texts with a value that are copies or near
    copies (see ``_sketch``) or hold it in the same surroundings (a copied passage) one
    counts. A value may be as rare as the corpus is large: two texts are enough in a large one.

    Values that stand in the same texts have equal estimates, and so have terms: they are
    judged as one, so a text with very many of both isn't multiplied out.
    """
    spans = scanned.where("size(spans) > 0").select("key", F.explode("spans").alias("s"))
    # copies of a text are counted before they meet
    at = spans.groupBy("key", F.concat_ws(":", "s.kind", "s.value").alias("entity"), F.col("s.context").alias("context"), F.col("s.start").alias("start")).agg(F.count("*").alias("copies"))
    at = stored(at.groupBy("key", "entity", "context").agg(F.max("copies").alias("copies")), "places")
    counts = at.select("entity", "key", "copies").distinct()
    apart = at.groupBy("entity", "context").agg(F.min("key").alias("key")).select("entity", "key").distinct()
    several = counts.groupBy("entity").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("entity")
    shared = counts.join(several, "entity", "left_semi").select("entity", "key")
    sketches = stored(shared.select("key").distinct().join(scanned.where("size(spans) > 0").select("key", "sketch").distinct(), "key"), "sketches")
    copy = _near_copies(shared, sketches).withColumn("copy", F.lit(1))
    rows = counts.join(apart.withColumn("one", F.lit(1)), ["entity", "key"], "left").join(copy, ["entity", "key"], "left")
    rows = stored(rows.select("entity", "key", "copies", F.when(F.col("copy").isNull(), F.coalesce("one", F.lit(0))).otherwise(0).alias("own")), "evidence")
    entities = rows.groupBy("entity").agg(F.sum("copies").alias("n_c"), F.sum("own").alias("k_c"), F.count("*").alias("m"), *_set_of("key", "own"))
    entities = stored(entities, "values")
    n_values = entities.count()
    if not n_values:
        return None
    n = float(scanned.count())
    every = docs.select(F.explode(_terms(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("term"))
    n_term = stored(every.groupBy("term").agg(F.count("*").alias("n_t")), "terms")  # combined before the shuffle
    tests = float(n_values) * float(max(1, n_term.count()))

    def proof(k: Column, mean: Column) -> Column:
        return F.when(k > 0, k * F.log(k / mean) - k + mean >= F.log(F.lit(tests / chance))).otherwise(False)

    # a term is in at least the k texts that it shares with a value, so no pair has more proof than this
    able = proof(F.col("k_c").cast("double"), F.col("n_c") * F.col("k_c") / F.lit(n)) & (F.col("n_c") < n)
    classes = entities.where(able).groupBy("n_c", "m", "set1", "set2").agg(F.min("entity").alias("entity"))
    held = stored(classes.join(rows, "entity").select("entity", "n_c", "key", "copies", "own"), "classes")
    if held.isEmpty():
        return None
    # share >= generalise and n(c,t) <= n(c) bound the documents that such a term can be in
    most = held.agg(F.max("n_c")).first()[0]
    rare = n_term.where(F.col("n_t") <= n ** (1 - generalise) * most**generalise * 1.000001)
    words = _texts(docs, text_col).where(_any_possible(F.col("text"))).join(held.select("key").distinct(), "key", "left_semi").select("key", F.explode(_terms(F.col("text"))).alias("term")).distinct()
    words = stored(words.join(rare, "term"), "words")
    alike = stored(words.groupBy("term", "n_t").agg(F.count("*").alias("m"), *_set_of("key")), "alike")
    heads = alike.groupBy("n_t", "m", "set1", "set2").agg(F.min("term").alias("head"))
    few = words.join(heads.select(F.col("head").alias("term")), "term", "left_semi").withColumnRenamed("term", "head")
    pairs = held.join(few, "key").groupBy("entity", "head", "n_c", "n_t").agg(F.sum("copies").alias("n_ct"), F.sum("own").alias("k"))
    share = F.log(n * F.col("n_ct") / (F.col("n_c") * F.col("n_t"))) / F.log(n / F.col("n_c"))
    sure = proof(F.col("k").cast("double"), F.col("n_c") * F.col("n_t") / F.lit(n))
    found = pairs.where((share >= generalise) & sure).select("head", F.when(share >= remove, "remove").otherwise("generalise").alias("action"))
    found = found.groupBy("head").agg(F.max("action").alias("action"))  # remove sorts last
    same = alike.join(heads, ["n_t", "m", "set1", "set2"]).select("term", "head")
    return stored(same.join(found, "head").select("term", "action"), "flagged")


def term_spans(docs: DataFrame, scanned: DataFrame, text_col: str = "text", generalise: float = 0.6, remove: float = 0.8, chance: float = 1.0) -> DataFrame | None:
    """key and terms (start, end, action; sorted) of all texts with terms to sanitise, wherever in whichever document they stand; None without any."""
    flagged = disclosing(docs, scanned, text_col, generalise, remove, chance)
    if flagged is None or flagged.isEmpty():
        return None
    flagged = F.broadcast(flagged) if flagged.count() <= 1_000_000 else flagged
    own = _texts(docs, text_col)
    hits = stored(own.select("key", F.explode(_terms(F.col("text"))).alias("term")).join(flagged, "term").select("key").distinct(), "hits")
    words = own.join(hits, "key", "left_semi").select("key", F.explode(term_matches(F.col("text"))).alias("t")).select("key", "t.*")
    words = words.join(flagged, "term").select("key", "start", "end", "action").distinct()
    return stored(words.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "action"))).alias("terms")), "term_places")


def _with_terms(rows: DataFrame, terms: DataFrame | None) -> DataFrame:
    """``rows`` (spans, key) with all spans, those of terms too."""
    if terms is None:
        return rows.withColumn("all", F.col("spans"))
    found = rows.join(terms.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"), "left")
    more = F.transform(F.coalesce("terms", F.array().cast(f"array<{TERM_SPAN}>")), lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), t["end"].alias("end"), F.lit("term").alias("kind"), t["action"].alias("value"), F.lit(0).alias("context")))
    return found.withColumn("all", F.array_sort(F.concat("spans", more.cast(f"array<{SPAN}>"))))


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: float) -> DataFrame:
    """Counts and places of personal data in every document.

    Columns: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans as
    kind:start:end joined by commas) and spans (with those of kind ``term``). Null texts
    count as empty: no spans and the SHA-256 of nothing. Repeated rows each get a row, null
    ids stay null, no rows give no rows, other columns aren't read. Time and memory follow
    the length of a text and its number of spans, however many there are.
    """
    scanned = stored(scan(docs, id_col, text_col), "spans")
    found = _with_terms(scanned, term_spans(docs, scanned, text_col, **limits))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(F.col("spans")).cast("binary"), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))


#: code points of the pieces in which a text is cut, so that a place is found without reading all before it
PIECE = 4096


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with sorted ``spans`` replaced; those that overlap are replaced as one, under the name of the first."""

    def name(x: Column) -> Column:
        return F.when(x["kind"] != "term", F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).when(x["value"] == "generalise", "[TERM]").otherwise("")

    def cut(pieces: Column, a: Column, b: Column) -> Column:
        """Code points a to b (exclusive)."""
        i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        last = F.coalesce(F.get(pieces, j), F.lit(""))
        first = F.coalesce(F.get(pieces, i), F.lit(""))
        inside = F.substring(first, a % PIECE + 1, b - a)
        across = F.concat(F.substring(first, a % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(last, F.lit(1), b % PIECE))
        return F.when(i == j, inside).otherwise(across)

    def built(s: Column) -> Column:
        heads = F.filter(F.transform(s["spans"], lambda x, i: F.struct(x.alias("x"), F.get(s["done"], i).alias("done"))), lambda y: y["x"]["start"] >= y["done"])
        out = F.transform(heads, lambda y: F.concat(cut(s["pieces"], y["done"], y["x"]["start"]), name(y["x"])))
        return F.concat(F.array_join(out, ""), cut(s["pieces"], F.array_max(F.transform(s["spans"], lambda x: x["end"])), s["length"]))

    parts = F.struct(spans.alias("spans"), running(F.transform(spans, lambda x: x["end"]), _most).alias("done"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), F.length(text).alias("length"))
    return _let(parts, built)


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: float) -> DataFrame:
    """``docs`` with every span replaced: [EMAIL], [IP], [CARD], [PHONE], [TERM] for a generalised term, nothing for a removed one.

    Overlapping spans are replaced as one, under the name of the first. Null texts stay
    null and other columns are kept.
    """
    scanned = stored(scan(docs, id_col, text_col), "spans")
    terms = term_spans(docs, scanned, text_col, **limits)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # the table's columns stay apart from ours
    text = F.col("row")[text_col].cast("string")
    work = row.withColumn("spans", base_spans(F.coalesce(text, F.lit(""))))
    work = _with_terms(work if terms is None else work.withColumn("key", F.sha2(text, 256)), terms)
    return work.select(*[F.when(F.size("all") > 0, replaced(text, F.col("all"))).otherwise(F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
