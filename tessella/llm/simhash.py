"""Near-duplicates by 64-bit SimHash and a binary-trie self-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_group, checkpointed, discard, found_in, slices, stored, utf8
from .graph import connected_components

ALL = (1 << 64) - 1


def simhash(text: bytes, shingle: int = 3) -> int:
    """SimHash of a UTF-8 text: a bit is set if more than half the shingles' XXH64 (seed 42) have it."""
    import xxhash

    words = text.lower().split()  # on bytes, both touch ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=False)), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for part in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[part : part + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every document; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            fp = np.fromiter((simhash(t, shingle) for t in utf8(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _labels(n: int, label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unite rows a[i] and b[i] in ``label`` (each row's smallest known mate)."""
    while True:
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        if (x == y).all():
            return label
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


def _forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the pairs that join rows not yet united, one for each union, and the rows' labels after them."""
    out_a, out_b = [a[:0]], [b[:0]]
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return np.concatenate(out_a), np.concatenate(out_b), label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        root, at = np.unique(np.maximum(x, y), return_index=True)  # each root is put under one smaller one
        out_a.append(a[at])
        out_b.append(b[at])
        label = label.copy()
        label[root] = np.minimum(x, y)[at]
        while (label[label] != label).any():
            label = label[label]


def trie_pairs(groups: np.ndarray, fp: np.ndarray, budget: int, block: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Self-join of several binary tries at once: the pairs of rows (a, b) linked within their group.

    ``fp`` (unsigned) is sorted within each run of equal ``groups``. A trie node is a
    range of rows that agree on the bits above its depth. Node pairs go down together:
    children that differ in the next bit add one to the pair's distance, and a pair
    above ``budget`` is dropped with everything below it. At most about ``block`` pairs
    are expanded at a time, the rest wait on a stack. Of rows with equal fingerprints
    each is paired with the first only, and other rows' pairs name the first.
    """
    n = len(fp)
    if n < 2:
        return
    first = np.flatnonzero(np.r_[True, (groups[1:] != groups[:-1]) | (fp[1:] != fp[:-1])])
    if len(first) < n:  # equal rows of a group
        own = np.repeat(first, np.diff(np.r_[first, n]))
        rest = np.flatnonzero(own != np.arange(n))
        yield own[rest], rest
        groups, fp, n = groups[first], fp[first], len(first)
    cut = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    lo, hi = cut, np.r_[cut[1:], n]
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    ones: dict[int, np.ndarray] = {}

    def below(depth: int) -> np.ndarray:
        if depth not in ones:
            ones[depth] = np.r_[0, np.cumsum((fp >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)]
        return ones[depth]

    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        depth, al, ah, bl, bh, far = stack.pop()
        if len(al) > block:
            half = len(al) // 2
            stack += [(depth, *(x[half:] for x in (al, ah, bl, bh, far))), (depth, *(x[:half] for x in (al, ah, bl, bh, far)))]
            continue
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():
            a, b = al[single], bl[single]
            near = (a != b) & (np.bitwise_count(fp[a] ^ fp[b]) <= budget)
            if near.any():
                yield first[a[near]], first[b[near]]
            al, ah, bl, bh, far = (x[~single] for x in (al, ah, bl, bh, far))
        if not len(al):
            continue
        c = below(depth)
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        own = al == bl  # two ranges of one depth are equal or disjoint
        parts = [(al, am, bl, bm, far), (am, ah, bm, bh, far), (al, am, bm, bh, far + 1), (am[~own], ah[~own], bl[~own], bm[~own], far[~own] + 1)]
        al, ah, bl, bh, far = (np.concatenate([p[i] for p in parts]) for i in range(5))
        live = (ah > al) & (bh > bl) & (far <= budget) & ~((al == bl) & (ah - al == 1))
        if live.any():
            stack.append((depth + 1, al[live], ah[live], bl[live], bh[live], far[live]))


def trie_join(groups: np.ndarray, fp: np.ndarray, budget: int, block: int = 1 << 16) -> np.ndarray:
    """Each row's smallest row among those linked to it within its group; links are united as they come, so memory doesn't follow their number."""
    label = np.arange(len(fp))
    for a, b in trie_pairs(groups, fp, budget, block):
        label = _labels(len(fp), label, a, b)
    return label


def _parts(free: int, n: int) -> list[int]:
    """Split the set bits of ``free`` into n masks of like size."""
    bits = [i for i in range(64) if free >> i & 1]
    return [sum(1 << i for i in bits[len(bits) * k // n : len(bits) * (k + 1) // n]) for k in range(n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _routed(nodes: DataFrame, budget: int, group_rows: int, bits: int, by: list[str]) -> DataFrame:
    """Fingerprints (fp and the columns ``by``) sent to subtries (``by``, mask, at) in one of which every linked pair meets.

    Of budget+1 disjoint sets of bits, two linked fingerprints agree on one whole set, so a
    fingerprint goes to the budget+1 subtries below its value on each set. A subtrie of over
    ``group_rows`` fingerprints is cut again in the same way by its remaining bits, until it
    is small or under 16 bits are free (then it has at most 32,768 different rows).
    """
    n = budget + 1
    used = ALL & ~((1 << 64 - bits) - 1)
    masks = {m: used & ~m for m in _parts(used, n)}
    rows = nodes.select(*by, "fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"))
    ready: list[DataFrame] = []
    key = [*by, "mask", "at"]
    while True:
        rows = rows.select(*by, "mask", F.col("mask").bitwiseAND(F.col("fp")).alias("at"), "fp")
        wide = [m for m, free in masks.items() if free.bit_count() >= 16]
        if not wide:
            ready.append(rows)
            break
        large = rows.where(F.col("mask").isin([_signed(m) for m in wide])).groupBy(*key).count().where(F.col("count") > group_rows)
        hot = checkpointed(large.select(*key))
        if hot.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(hot, key, "left_anti"))
        finer = {m: [m | p for p in _parts(masks[m], n)] for m in wide}
        table = F.create_map(*(x for m, ms in finer.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(y)) for y in ms)))))
        rows = checkpointed(rows.join(hot, key, "left_semi").select(*by, "fp", F.explode(table[F.col("mask")]).alias("mask")))
        masks = {y: used & ~y for ms in finer.values() for y in ms}
    routed = ready[0]
    for more in ready[1:]:
        routed = routed.unionByName(more)
    return routed.repartition(*key).sortWithinPartitions(*key)


def links(distinct: DataFrame, budget: int = 2, group_rows: int = 20_000, bits: int = 64, by: str | None = None) -> DataFrame:
    """Edges (src, dst) among the fingerprints of ``distinct`` (fp) within ``budget`` differing bits, of which the upper ``bits`` count.

    They connect all linked fingerprints: each subtrie gives a forest of its links, so their
    number follows that of the fingerprints, whatever groups they form. With the column ``by``
    fingerprints are linked within equal values of it alone, and the edges carry it and are links themselves.
    """
    keys = ["mask", "at"] if by is None else [by, "mask", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, keys, 40_000):
            cols = [t.column(c).to_numpy() for c in keys]
            fp = t.column("fp").to_numpy().view(np.uint64)
            group = np.cumsum(np.r_[0, np.logical_or.reduce([c[1:] != c[:-1] for c in cols])])
            order = np.lexsort((fp, group))
            fp, group = fp[order], group[order]
            if by is None:
                root = trie_join(group, fp, budget)
                got = np.flatnonzero(root != np.arange(len(fp)))
                yield pa.RecordBatch.from_arrays([pa.array(fp[got].view(np.int64)), pa.array(fp[root[got]].view(np.int64))], ["src", "dst"])
                continue
            own, label = cols[0][order], np.arange(len(fp))
            for a, b in trie_pairs(group, fp, budget):
                a, b, label = _forest(label, a, b)
                yield pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], [by, "src", "dst"])

    head = "" if by is None else f"{by} int, "
    return _routed(distinct, budget, group_rows, bits, [] if by is None else [by]).mapInArrow(run, f"{head}src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id linked, itself included) of every row.

    Texts are compared after lower-casing A-Z and splitting at ASCII white space. A text
    of under three words is one shingle; null texts and texts without words have
    fingerprint zero and are linked like any other. Repeated rows each get a row; rows
    with a null id count as members, but their id is never the smallest unless there is
    no other. No rows give no rows; other columns aren't read.
    """
    own = stored(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = checkpointed(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    group = connected_components(links(distinct.select("fp"), budget))
    member = distinct.join(group.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    member = checkpointed(member)
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    known = member.join(least, "component").select("fp", "component_id")
    return own.join(known, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


class Words(dict):
    """64-bit hash of a word, remembered for up to ``limit`` short words."""

    def __init__(self, limit: int = 100_000):
        import xxhash

        self.limit, self.digest = limit, xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        h = self.digest(word, 42)
        if len(self) < self.limit and len(word) <= 64:
            self[word] = h
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: bytes, words: Words, size: int) -> np.ndarray:
    """The distinct hashes (sorted) of a text's runs of ``size`` words; a shorter text is one run, one without words none."""
    ws = text.lower().split()  # on bytes, both touch ASCII letters and white space only
    if not ws:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, ws), np.uint64, len(ws))
    m = min(size, len(ws))
    h = np.full(len(ws) - m + 1, m, np.uint64)
    for k in range(m):
        h = _mixed(h ^ w[k : len(w) - m + 1 + k]) + np.uint64(k)
    return np.unique(h)


def set_fingerprints(sets: list[np.ndarray], words: int) -> np.ndarray:
    """SimHash of sets of hashes in ``words`` times 64 bits: a bit is set if more than half of a set's members have it.

    Each member gives its bits through ``words`` mixed products. Counts of eight bits are
    added at once, one to a byte, over at most 255 members.
    """
    size = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), words), np.uint64)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    flat = np.concatenate([sets[i] for i in full])
    n = size[full]
    runs = -(-n // 255)
    first = np.cumsum(n) - n
    starts = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    heads = np.cumsum(runs) - runs
    lanes, half = np.uint64(0x0101010101010101), (n // 2)[:, None]
    for j in range(words):
        w = _mixed(flat * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) & ALL | 1) + np.uint64(j))
        for bit in range(8):
            eight = np.add.reduceat(w >> np.uint64(bit) & lanes, starts)
            count = np.add.reduceat(eight.view(np.uint8).reshape(-1, 8).astype(np.int64), heads, axis=0)
            out[full, j] |= (count > half).astype(np.uint8).view(np.uint64).reshape(-1) << np.uint64(bit)
    return out


def _sets(docs: DataFrame, id_col: str, text_col: str, size: int, words: int) -> DataFrame:
    """doc_id, text_hash, sid (hash of the shingle set), n (its size), w0 and so on (its fingerprint) and toks (the set, sorted) of every row."""
    marks = [f"w{k}" for k in range(words)]
    names = ["doc_id", "text_hash", "sid", "n", *marks, "toks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known = Words()
        for batch in slices(batches, 500, "text", 1 << 20):
            sets = [shingle_set(t, known, size) for t in utf8(batch.column(2))]
            sid = np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), 7) for x in sets), np.uint64, len(sets)).view(np.int64)
            n = np.array([len(x) for x in sets], np.int32)
            w = set_fingerprints(sets, words).view(np.int64)
            toks = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sid), pa.array(n), *(pa.array(np.ascontiguousarray(w[:, k])) for k in range(words)), toks], names)

    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return own.mapInArrow(run, f"doc_id long, text_hash long, sid long, n int, {', '.join(f'{m} long' for m in marks)}, toks array<long>")


#: rounds in which components grow by their best candidates before all others are verified
ROUNDS = 2
#: tries whose candidates are verified first; what they join needs no candidates of the other tries
EARLY = 4


def _ordered(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")


def near_sets(own: DataFrame, words: int, budget: int, similarity: float, margin: float = 0.62) -> DataFrame:
    """node and component of the sids of ``own`` that are linked to another by exact Jaccard similarity, of the pairs that any trie finds.

    Every fingerprint word is cut into two tries of 32 bits. Fingerprints within ``budget``
    bits in a trie are candidates, by a spanning forest of each subtrie's links. The first EARLY tries go ahead, and of the
    others only candidates in different components of what these have joined are looked at, so a large group gives few
    times its members and not that for every trie. In each of ROUNDS rounds every
    component's best candidate out of it is verified (at first every set is its own), which joins most members of a
    large group with one comparison each; then all candidates that still lie in different components are. Candidates whose whole fingerprints differ in more bits
    than sets of similarity ``margin`` do on average can't be as similar as asked for (five
    standard deviations) and aren't compared.
    """
    marks = [f"w{k}" for k in range(words)]
    bits = 64 * words
    far = int(bits * np.arccos(2 * margin / (1 + margin)) / np.pi)
    sets = stored(own.where("n > 0").select("sid", "n", *marks).distinct(), "sets")
    upper = F.lit(_signed(ALL ^ 0xFFFFFFFF))
    tries = F.array(*(x for m in marks for x in (F.col(m).bitwiseAND(upper), F.shiftleft(F.col(m), 32))))
    def verified(pairs: DataFrame) -> DataFrame:
        need = stored(pairs.select(F.explode(F.array("src", "dst")).alias("sid")).distinct(), "need")
        toks = found_in(own.select("sid", "toks"), need, ["sid"]).groupBy("sid").agg(F.first("toks").alias("toks"))
        toks = stored(toks, "toks")
        a, b = (toks.select(F.col("sid").alias(k), F.col("toks").alias(t)) for k, t in (("src", "a"), ("dst", "b")))
        both = F.size(F.array_intersect("a", "b"))
        out = stored(pairs.join(a, "src").join(b, "dst").where(both >= similarity * (F.size("a") + F.size("b") - both) - 1e-9).select("src", "dst"), "edges")
        discard(need, toks)
        return out

    def alike(pairs: DataFrame) -> DataFrame:
        """src, dst and bits that differ, of pairs close enough in size and fingerprint."""
        a, b = (sets.select(F.col("sid").alias(k), F.col("n").alias(f"{k}_n"), *(F.col(m).alias(f"{k}_{m}") for m in marks)) for k in ("src", "dst"))
        apart = sum((F.bit_count(F.col(f"src_{m}").bitwiseXOR(F.col(f"dst_{m}"))) for m in marks[1:]), F.bit_count(F.col(f"src_{marks[0]}").bitwiseXOR(F.col(f"dst_{marks[0]}"))))
        joined = pairs.join(a, "src").join(b, "dst").select("src", "dst", "src_n", "dst_n", apart.alias("apart"))
        return joined.where((F.col("apart") <= far) & (F.least("src_n", "dst_n") >= similarity * F.greatest("src_n", "dst_n") - 1e-9)).select("src", "dst", "apart")

    def joined(pairs: DataFrame, known: DataFrame) -> DataFrame:
        """``pairs`` in different components, with these."""
        for k in ("src", "dst"):
            pairs = pairs.join(known.select(F.col("node").alias(k), F.col("component").alias(f"{k}_c")), k, "left").withColumn(f"{k}_c", F.coalesce(f"{k}_c", k))
        return pairs.where("src_c <> dst_c")

    def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Shared nodes, linked nodes and the candidates of heads, of nodes (trie, fp, sid and its component c): those that don't lie in one component.

        A node is mixed if its members are in several components.
        """
        heads = nodes.groupBy("trie", "fp").agg(F.min("sid").alias("head"), F.min_by("c", "sid").alias("c"), F.count("*").alias("m"), (F.min("c") < F.max("c")).alias("mixed"))
        heads = stored(heads, "heads")
        near = stored(links(heads.select("trie", "fp"), budget, 4_000, 32, "trie").distinct(), "near")
        several = stored(heads.where("mixed").withColumnRenamed("c", "head_c"), "several")
        own = found_in(nodes, several.select("trie", "fp"), ["trie", "fp"])
        stars = own.join(several, ["trie", "fp"]).where("c <> head_c").select(*_ordered("sid", "head"))
        ends = stored(near.select("trie", F.explode(F.array("src", "dst")).alias("fp")).distinct(), "ends")
        ended = stored(found_in(heads, ends, ["trie", "fp"]), "ended")
        a, b = (ended.select("trie", F.col("fp").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("head", "c", "m", "mixed"))) for k in ("src", "dst"))
        met = stored(near.join(a, ["trie", "src"]).join(b, ["trie", "dst"]).where("src_c <> dst_c or src_mixed or dst_mixed"), "met")
        pairs = stars.unionByName(met.where("src_c <> dst_c").select(*_ordered("src_head", "dst_head")))
        first = stored(alike(pairs.distinct()), "candidates")
        discard(heads, near, ends, ended)
        return several, met, first

    def grown(open_: DataFrame, edges: DataFrame | None, tried: DataFrame | None, rounds: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """Candidates left, edges and pairs verified after rounds of best candidates."""
        for _ in range(rounds):
            x = F.struct("apart", "src", "dst").alias("x")
            ways = open_.select(F.col("src_c").alias("c"), x).unionByName(open_.select(F.col("dst_c").alias("c"), x))
            best = stored(ways.groupBy("c").agg(F.min("x").alias("x")).select("x.src", "x.dst").distinct(), "best")
            if best.isEmpty():
                break
            new = verified(best)
            edges = new if edges is None else stored(edges.unionByName(new), "edges")
            tried = best if tried is None else stored(tried.unionByName(best), "tried")
            rest = open_.select("src", "dst", "apart").join(tried, ["src", "dst"], "left_anti")
            open_ = stored(joined(rest, connected_components(edges)), "open")
        return open_, edges, tried

    at = F.posexplode(tries).alias("trie", "fp")
    nodes = sets.select("sid", F.col("sid").alias("c"), at)
    early, met_early, first_early = candidates(nodes.where(F.col("trie") < EARLY))
    open_, edges, tried = grown(first_early.withColumn("src_c", F.col("src")).withColumn("dst_c", F.col("dst")), None, None, ROUNDS)
    if edges is None:
        edges = tried = stored(first_early.select("src", "dst"), "edges")
    else:
        left_ = stored(open_.select("src", "dst"), "rest")
        edges, tried = stored(edges.unionByName(verified(left_)), "edges"), stored(tried.unionByName(left_), "tried")
    known = connected_components(edges)
    placed = sets.join(known.withColumnRenamed("node", "sid"), "sid", "left")
    nodes_late = stored(placed.select("sid", F.coalesce("component", "sid").alias("c"), at).where(F.col("trie") >= EARLY), "nodes")
    late, met_late, first_late = candidates(nodes_late)
    open_, edges, tried = grown(joined(first_late.join(tried, ["src", "dst"], "left_anti"), known), edges, tried, 1)
    known = connected_components(edges)
    several, met = early.unionByName(late), met_early.unionByName(met_late)
    nodes = nodes.drop("c")
    known = known.withColumnRenamed("node", "sid")

    # members of shared nodes: those that differ from their node's head, and all where the heads differ
    shared = several.select("trie", F.col("fp").alias("src"), F.col("fp").alias("dst"), F.col("head").alias("src_head"), F.col("head").alias("dst_head"))
    wide = met.where("src_m > 1 or dst_m > 1").select("trie", "src", "dst", "src_head", "dst_head")
    wide = wide.unionByName(wide.select("trie", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("dst_head").alias("src_head"), F.col("src_head").alias("dst_head"))).unionByName(shared)
    c = known.select(F.col("sid").alias("head"), "component")
    for k in ("src", "dst"):
        wide = wide.join(c.select(F.col("head").alias(f"{k}_head"), F.col("component").alias(f"{k}_c")), f"{k}_head", "left").withColumn(f"{k}_c", F.coalesce(f"{k}_c", f"{k}_head"))
    wide = stored(wide.select("trie", "src", "dst", "src_c", "dst_c"), "wide")
    held = stored(wide.select("trie", F.col("src").alias("fp")).distinct(), "held")
    members = stored(found_in(nodes, held, ["trie", "fp"]).join(known, "sid", "left").select("trie", "fp", "sid", F.coalesce("component", "sid").alias("c")), "members")
    left = wide.join(members.select("trie", F.col("fp").alias("src"), F.col("sid").alias("a"), F.col("c").alias("a_c")), ["trie", "src"]).where("src_c <> dst_c or a_c <> src_c")
    across = left.join(members.select("trie", F.col("fp").alias("dst"), F.col("sid").alias("b"), F.col("c").alias("b_c")), ["trie", "dst"]).where("a_c <> b_c")
    rest = alike(across.select(*_ordered("a", "b")).distinct()).select("src", "dst").unionByName(open_.select("src", "dst")).distinct()
    rest = rest.join(tried, ["src", "dst"], "left_anti")
    edges = stored(edges.unionByName(verified(stored(rest, "rest"))), "edges")
    discard(sets, early, late, met_early, met_late, first_early, first_late, nodes_late, wide, held, members)
    return connected_components(edges)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, words: int = 10, budget: int = 2) -> DataFrame:
    """``docs``, all columns, with one document of each group of near copies: that with the smallest id.

    Near copies are texts whose sets of ``shingle``-word runs (A-Z lower-cased, words split
    at ASCII white space) have a Jaccard similarity of at least ``similarity``, computed
    exactly, among the pairs that the trie join finds: fingerprints within ``budget`` bits in
    any of two tries of 32 bits to each of ``words`` fingerprint words. Groups are connected
    components. Equal sets are always found, pairs of similarity 0.8 with a chance of 0.9,
    of 0.9 with 0.999.

    Null texts and texts without words are copies of each other. A null id comes after all
    others. Of repeated rows one stays, and of rows with one id and text any one of them; rows with one id and different texts are different
    documents. No rows give no rows.
    """
    own = stored(_sets(docs, id_col, text_col, shingle, words), "shingles")
    group = near_sets(own, words, budget, similarity).withColumnRenamed("node", "sid")
    rows = own.groupBy("doc_id", "text_hash", "sid").agg(F.count("*").alias("n"))
    rows = rows.join(group, "sid", "left").select("doc_id", "text_hash", "n", F.coalesce("component", "sid").alias("component"))
    least = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n")).alias("x"))
    kept = stored(least.select(F.col("x.doc_id").alias("_id"), F.col("x.text_hash").alias("_hash"), F.col("x.n").alias("_n")), "kept")
    discard(own)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    whole = whole.withColumn("id", F.col("row")[id_col].cast("long")).withColumn("hash", F.xxhash64(F.col("row")[text_col].cast("string")))

    def chosen(some: DataFrame) -> DataFrame:
        return whole.join(some, (F.col("hash") == F.col("_hash")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")

    out = chosen(kept.where("_n = 1")).select("row")
    again = kept.where("_n > 1")
    if not again.isEmpty():
        out = out.unionByName(chosen(again).groupBy("id", "hash").agg(F.first("row").alias("row")).select("row"))
    return out.select("row.*")
