"""The queries of this subpackage, one an operator, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file: in ``METASEINE_TOKENIZERS`` or where the public_tokenizers package has it."""
    folder = os.environ.get("METASEINE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spherical import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), redacted=False)


def op3_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mtree import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import replicate

    return replicate(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import report

    return report(table(spark, sf_dir, "documents"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read, write

    return read(write(table(spark, sf_dir, "pages")), payloads=False).drop("url")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import detect

    return detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_spherical_caps, op2_secret_scan, op3_mtree_topk, op4_poisson_mixing, op5_pii, op6_minhash_dedup, op7_language_id, op8_byte_bpe, op9_warc, op10_toxicity)}

#: Vectors of equal labels by cosine in double precision, then reachability.
OP1_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach(u, v) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
comps AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.u = v.vec_id) AS n_links, c.component_id, c.component_id = v.vec_id AS kept
FROM v JOIN comps c ON c.u = v.vec_id
"""

OP3_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT *, row_number() OVER () AS k FROM v),
s AS (SELECT q.k, q.vec_id AS query_id, c.vec_id, CAST(least(greatest(list_inner_product(q.e, c.e), -9223372036854774784.0), 9223372036854774784.0) AS BIGINT) AS score
  FROM n q JOIN n c ON q.vec_id % 50 = 0 AND q.k <> c.k AND len(q.e) = len(c.e))
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

#: Copies by the inverse of the Poisson distribution at a number from the MD5 of seed and id.
OP4_SQL = r"""
WITH RECURSIVE sizes AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size FROM documents GROUP BY source),
totals AS (SELECT sum(size) AS size, sum(pow(size, 0.5)) AS weight FROM sizes),
rates AS (SELECT s.source, CASE WHEN s.size > 0 THEN pow(s.size, 0.5) / t.weight * t.size / s.size ELSE 1.0 END AS rate FROM sizes s, totals t),
cdf(source, rate, k, p, total) AS (SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), total + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 40)),
u AS (SELECT *, CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM documents),
n AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM u.source AND c.total <= u.u) AS n FROM u)
SELECT doc_id, text, lang, source, n_chars, CAST(k AS INT) AS copy_no, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(k AS VARCHAR)) AS shuffle_key
FROM (SELECT *, unnest(range(0, n)) AS k FROM n WHERE n > 0)
"""

#: A document's distinct 2-word shingles; links by exact Jaccard similarity over classes of equal sets; then reachability.
OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN w
    ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM words),
classes AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
parts AS (SELECT rep, n, unnest(s) AS x FROM classes),
rare AS (SELECT p.rep, p.n, p.x, row_number() OVER (PARTITION BY p.rep ORDER BY f.c, p.x) AS k
  FROM parts p JOIN (SELECT x, count(*) AS c FROM parts GROUP BY x) f ON p.x = f.x),
prefix AS (SELECT rep, n, x FROM rare WHERE k <= n - CAST(ceil(0.8 * n - 1e-9) AS BIGINT) + 1),
pairs AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM prefix a JOIN prefix b ON a.x = b.x AND a.rep < b.rep AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
links AS (SELECT p.a, p.b FROM pairs p JOIN classes x ON x.rep = p.a JOIN classes y ON y.rep = p.b
  WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n - len(list_intersect(x.s, y.s)))),
both_ways AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach(u, v) AS (SELECT rep, rep FROM classes UNION SELECT r.u, e.v FROM reach r JOIN both_ways e ON r.v = e.u),
comps AS (SELECT u AS rep, min(v) AS component_id FROM reach GROUP BY u)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id, coalesce(m.component_id, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN classes c ON c.s = s.s LEFT JOIN comps m ON m.rep = c.rep
"""

#: Base32 of SHA-1 by five bits at a time of its hexadecimal digits.
OP9_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, h,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h || '0', CAST(i * 5 // 4 AS INT) + 1, 2) AS INT) >> CAST(3 - (i * 5) % 4 AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
  min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM d
"""

ORACLES: dict[str, str] = {"op1_spherical_caps": OP1_SQL, "op3_mtree_topk": OP3_SQL, "op4_poisson_mixing": OP4_SQL, "op6_minhash_dedup": OP6_SQL, "op9_warc": OP9_SQL}
