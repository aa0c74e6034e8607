"""The queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.llm import fingerprints, knn, mixing, ngram_join, pieces, suffix_dedup, toxicity, urls, warc, wrappers
from symgraph.llm.tables import read

#: Words as the operators cut them: maximal runs of characters other than ASCII white space.
_WORDS = r"list_filter(regexp_split_to_array({0}, '[\t\n\x0b\x0c\r ]+'), lambda x: x <> '')"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_scores(read(spark, sf_dir, "pages"), urls.seed_model())


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


_HASH = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_reverse(cs)), lambda h, c: (h * {1} + c) % {0})"
_OP2 = f"""
WITH d AS (SELECT doc_id, text, substring(text, 1, 64) AS opening,
        CASE WHEN text = '' THEN CAST([] AS BIGINT[]) ELSE list_transform(string_split(text, ''), lambda c: CAST(unicode(c) AS BIGINT)) END AS cs
    FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
l AS (SELECT opening, doc_id AS leader, cs AS lead FROM d QUALIFY row_number() OVER (PARTITION BY opening ORDER BY doc_id, text) = 1)
SELECT doc_id, CAST(len(cs) AS BIGINT) AS n, {_HASH.format(fingerprints.PRIMES[0], fingerprints.BASES[0])} * 2147483648 + {_HASH.format(fingerprints.PRIMES[1], fingerprints.BASES[1])} AS fingerprint,
    leader, CAST(CASE WHEN cs = lead THEN len(cs) ELSE coalesce(list_position(list_transform(list_zip(cs, lead), lambda x: x[1] IS DISTINCT FROM x[2]), true) - 1, least(len(cs), len(lead))) END AS BIGINT) AS common
FROM d JOIN l USING (opening)
"""


def op3_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the vectors whose id 50 divides, against all."""
    vectors = read(spark, sf_dir, "embeddings")
    return knn.nearest(vectors, vectors.where("vec_id % 50 = 0")).withColumn("distance", F.round("distance", 4))


_OP3 = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour) AS INTEGER) AS rank, neighbour, round(d, 4) AS distance FROM p
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour) <= 10
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.toxic_scores(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extracted(read(spark, sf_dir, "pages"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(read(spark, sf_dir, "documents"))


_OP6 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
u AS (SELECT doc_id, unnest(list_transform(range(0, len(ws) - 49), lambda s: {{'s': s, 'k': md5(array_to_string(ws[s + 1:s + 50], ' '))}})) AS x FROM w WHERE len(ws) >= 50),
r AS (SELECT doc_id, x.s AS s, count(*) OVER (PARTITION BY x.k) AS n, row_number() OVER (PARTITION BY x.k ORDER BY doc_id, x.s) AS rn FROM u),
c AS (SELECT doc_id, s, rn > 1 AS copy FROM r WHERE n > 1),
i AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id, copy ORDER BY s) + 50 THEN 0 ELSE 1 END AS fresh FROM c),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, copy ORDER BY s) AS island FROM i)
SELECT doc_id, CAST(min(s) AS INTEGER) AS start_word, CAST(max(s) + 50 AS INTEGER) AS end_word, copy FROM g GROUP BY doc_id, copy, island
"""


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(read(spark, sf_dir, "documents"))


_OP7 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("lower(text)")} AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END)) AS gram FROM w WHERE len(ws) > 0),
s AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(gram, chr(10) ORDER BY gram)) AS fp FROM g GROUP BY doc_id),
c AS MATERIALIZED (SELECT fp, min(n) AS n, count(*) AS members, min(doc_id) AS low FROM s GROUP BY fp),
u AS MATERIALIZED (SELECT fp, gram FROM g JOIN c ON c.low = g.doc_id),
o AS (SELECT a.fp AS x, b.fp AS y, count(*) AS k FROM u a JOIN u b USING (gram) WHERE a.fp <> b.fp GROUP BY 1, 2),
e AS MATERIALIZED (SELECT x, y FROM o JOIN c p ON p.fp = x JOIN c q ON q.fp = y WHERE CAST(k AS DOUBLE) / (p.n + q.n - k) >= 0.5),
r(fp, other) AS (SELECT fp, fp FROM c UNION SELECT r.fp, e.y FROM r JOIN e ON r.other = e.x),
k AS (SELECT r.fp, min(c.low) AS class_id FROM r JOIN c ON c.fp = r.other GROUP BY 1),
l AS (SELECT x AS fp, sum(members) AS more FROM e JOIN c ON c.fp = y GROUP BY 1)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, CAST(coalesce(members - 1 + coalesce(more, 0), 0) AS BIGINT) AS links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN c ON c.fp = s.fp LEFT JOIN k ON k.fp = s.fp LEFT JOIN l ON l.fp = s.fp
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.chunk_table(read(spark, sf_dir, "pages"))


_OP8 = f"""
WITH p AS (SELECT page_id, url, hex(encode(coalesce(html, ''))) AS h FROM pages),
c AS (SELECT *, unnest(range(0, greatest(1, (len(h) // 2 + {warc.CHUNK - 1}) // {warc.CHUNK}))) AS i FROM p)
SELECT 'urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || ':' || substr(sha256(unhex(h)), 1, 16) AS record_id, page_id, url, CAST(i AS INTEGER) AS chunk_no, i * {warc.CHUNK} AS start, CAST(least({warc.CHUNK}, len(h) // 2 - i * {warc.CHUNK}) AS INTEGER) AS n_bytes,
    sha256(unhex(h[:2 * {warc.CHUNK} * (i + 1)])) AS digest, (i + 1) * {warc.CHUNK} >= len(h) // 2 AS last, unhex(h[2 * {warc.CHUNK} * i + 1:2 * {warc.CHUNK} * (i + 1)]) AS payload, CAST(NULL AS VARCHAR) AS error FROM c
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_blocks(read(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_fingerprints": op2_fingerprints,
    "op3_knn": op3_knn,
    "op4_toxicity": op4_toxicity,
    "op5_html_extraction": op5_html_extraction,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_warc": op8_warc,
    "op9_mixing": op9_mixing,
    "op10_sentencepiece": op10_sentencepiece,
}

ORACLE_SQL: dict[str, str] = {
    "op2_fingerprints": _OP2,
    "op3_knn": _OP3,
    "op6_suffix_array_dedup": _OP6,
    "op7_ngram_jaccard_join": _OP7,
    "op8_warc": _OP8,
}
