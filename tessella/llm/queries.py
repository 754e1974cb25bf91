"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, decontam, langid, license_scan, pii, pieces, quality, ranked, simhash, token_counts, token_ids, urls, vector_codes
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_private(table(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.token_id_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_pii, op3_nearest, op4_language, op5_token_ids, op6_licenses, op7_pieces, op8_quality, op9_leaks, op10_urls, op11_ranked, op12_vector_codes, op13_token_counts)}

# The URL filter, the ranked search and the vector codes can be said in SQL whole: the others rest on XXH64, trained
# models, tokenizers, corpus statistics over positions, or edit distance. They are held against brute force in tests/llm.


def _split(column: str, prefix: str = "") -> str:
    """host and path of a url column in DuckDB."""
    rest = f"CASE WHEN contains({column}, '://') THEN substr({column}, position('://' IN {column}) + 3) ELSE '' END"
    return f"translate(regexp_extract({rest}, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS {prefix}host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS {prefix}path"


def _judged() -> str:
    """rule and decision from host and path in DuckDB, the longest rule first."""
    rule = decision = ""
    for verdict, host, path in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2])):
        fits = f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN "
        rule += fits + f"'{host + path}' "
        decision += fits + f"'{verdict}' "
    return f"CASE {rule}END AS rule, CASE {decision}END AS decision"


def _node(column: str) -> str:
    query = f"list_filter(string_split(regexp_extract(regexp_replace(coalesce({column}, ''), '#.*$', ''), '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref)(=|$)'))"
    return f"CASE WHEN host <> '' THEN regexp_replace(host, '^www\\.', '') || regexp_replace(regexp_replace(path, '/+$', ''), '(/index)?\\.html$', '') || CASE WHEN len({query}) > 0 THEN '?' || array_to_string({query}, '&') ELSE '' END END AS node"


# RE2 knows no lookahead: a tag is found first, then its parts
_LINKS = "list_concat(list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '<link\\b[^>]*>', 0, 'is'), lambda t: regexp_matches(t, '\\brel\\s*=\\s*[\"'']?canonical\\b', 'is')), lambda t: regexp_extract(t, '\\bhref\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1, 'is')), list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '<meta\\b[^>]*>', 0, 'is'), lambda t: regexp_matches(t, '\\bhttp-equiv\\s*=\\s*[\"'']?refresh\\b', 'is')), lambda t: regexp_extract(t, '\\burl\\s*=\\s*[\"'']?([^\"''\\s>;]+)', 1, 'is')))"

_PARTS = "string_split((CASE WHEN place = '' THEN '/' ELSE regexp_replace(place, '[^/]*$', '') END) || regexp_extract(t, '^[^?#]*'), '/')"
_BESIDE = f"array_to_string(list_reduce(list_prepend([''], list_transform({_PARTS}[2:], lambda p: [p])), lambda d, p: CASE p[1] WHEN '..' THEN d[1:greatest(len(d) - 1, 1)] WHEN '.' THEN d ELSE list_concat(d, p) END), '/')"
_RESOLVED = f"CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN 'http://' || base || t WHEN starts_with(t, '?') THEN 'http://' || base || place || t WHEN NOT starts_with(t, '#') AND NOT regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'http://' || base || {_BESIDE} || regexp_extract(t, '^[^?#]*(.*)$', 1, 's') END"

_URLS = f"""WITH RECURSIVE p AS (SELECT page_id, url, html, {_split("url")} FROM pages), o AS (SELECT *, {_judged()}, {_node("url")} FROM p),
l AS (SELECT node AS src, host AS base, path AS place, unnest({_LINKS}) AS t FROM o WHERE node IS NOT NULL),
a AS (SELECT src, {_RESOLVED} AS u FROM l WHERE t <> ''),
b AS (SELECT src, u, {_split("u")} FROM a), e AS (SELECT src, {_node("u")}, {_judged()} FROM b),
edge AS (SELECT src, node AS dst FROM e WHERE node IS NOT NULL UNION SELECT node, src FROM e WHERE node IS NOT NULL),
votes AS (SELECT node, min(decision) AS d FROM (SELECT node, decision FROM o UNION ALL SELECT node, decision FROM e) WHERE node IS NOT NULL AND decision IS NOT NULL GROUP BY 1),
walk AS (SELECT DISTINCT node AS s, node AS v FROM o WHERE node IS NOT NULL AND decision IS NULL UNION SELECT s, dst FROM walk JOIN edge ON v = src),
found AS (SELECT s AS node, min(d) AS d FROM walk JOIN votes ON v = votes.node GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(decision, d, 'allow') AS verdict FROM o LEFT JOIN found USING (node)"""



def _terms(table_: str, key: str) -> str:
    return f"SELECT {key}, unnest(regexp_extract_all(translate(text, '{urls.UPPER}', '{urls.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM {table_} WHERE text IS NOT NULL"


_RANKED = f"""WITH t AS ({_terms("documents", "doc_id")}), q AS (SELECT item_id, term, count(*) AS times FROM ({_terms("benchmark", "item_id")}) GROUP BY 1, 2),
len AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1), s AS (SELECT count(*) AS total_docs, CAST(sum(n) AS BIGINT) AS total_terms FROM len),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln((2 * total_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, total_docs),
m AS (SELECT doc_id, 75 + (25 * n * total_docs) // total_terms AS m FROM len, s),
found AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM found WHERE score > 0) WHERE rank <= 20"""


def _assigned(book: str) -> str:
    """vec_id, part, the part itself, its nearest entry of a codebook and their squared distance."""
    gap = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    return f"SELECT vec_id, p, x, e, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) AS best FROM (SELECT vec_id, p, x, e, CAST({gap} AS BIGINT) AS d FROM part JOIN {book} USING (p))) WHERE best = 1"


def _moved(book: str, assigned: str) -> str:
    """The codebook whose entries are the floor of their parts' means; unused ones stay."""
    floor = "(sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*)"
    return f"SELECT p, e, coalesce(m, c) AS c FROM {book} LEFT JOIN (SELECT p, e, list(v ORDER BY i) AS m FROM (SELECT p, e, i, CAST({floor} AS BIGINT) AS v FROM {assigned}, range(1, 17) AS t(i) WHERE i <= len(x) GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (p, e)"


_CODES = f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (SELECT vec_id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, range(16) AS t(p)),
seed AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
b0 AS (SELECT p, e, x AS c FROM part JOIN seed USING (vec_id)), a0 AS ({_assigned("b0")}), b1 AS ({_moved("b0", "a0")}), a1 AS ({_assigned("b1")}), b2 AS ({_moved("b1", "a1")}), a2 AS ({_assigned("b2")}),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 JOIN kept USING (vec_id) GROUP BY 1, 2),
digest AS (SELECT sha256(string_agg(CAST(c[i] AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b2, range(1, 17) AS t(i) WHERE i <= len(c))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest"""

ORACLE_SQL: dict[str, str] = {"op10_urls": _URLS, "op11_ranked": _RANKED, "op12_vector_codes": _CODES}
