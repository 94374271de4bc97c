"""The registered queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stackroom.llm import bpe, embedding_dedup, exact_dedup, line_dedup, minhash, packing, pii, sharding, toxicity, url_filter

URL_RULES = [
    "allow com/",
    "block example.com/en/",
    "allow www.example.com/en/",
    "block net/es/",
    "block net/fr/",
]
SHARDS = [f"shard-{i:02d}" for i in range(24)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(read(spark, sf_dir, "embeddings"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), bpe.public_path("word_bpe_49k.json"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(read(spark, sf_dir, "documents"), maximal=True).drop("spans")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_round_trip(read(spark, sf_dir, "documents"), bpe.public_path("byte_bpe_50k.json"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), url_filter.parse_rules(URL_RULES))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read(spark, sf_dir, "documents"), "doc_id", SHARDS)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh
  FROM d),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS v FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM x a JOIN x b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c) UNION ALL SELECT b, a FROM p WHERE 100 * c >= 85 * (na + nb - c)),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS low FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
FROM s LEFT JOIN c ON c.a = doc_id
"""

OP5_SQL = r"""
WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
n AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM t),
w AS (SELECT doc_id, ls, i, len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) AS w FROM n),
b AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) - w AS before, sum(w) OVER (PARTITION BY doc_id) AS total FROM w),
r AS (SELECT doc_id, ls, i, before, total, max(i) OVER (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING) AS last FROM b),
z AS (SELECT doc_id, before, max(i) AS i FROM b GROUP BY ALL),
e AS (SELECT b.doc_id, z.i, b.i AS last, b.ls FROM b ASOF JOIN z ON b.doc_id = z.doc_id AND b.before + b.w - 50 >= z.before),
k AS (SELECT doc_id, i, last, ls[i:last] AS run FROM (SELECT doc_id, i, last, ls FROM r WHERE before + 50 <= total UNION SELECT * FROM e)),
f AS (SELECT run, min({'d': doc_id, 'i': i}) AS first FROM k GROUP BY 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, last + 1)) AS i FROM k JOIN f USING (run) WHERE {'d': doc_id, 'i': i} <> first),
q AS (SELECT n.doc_id, string_agg(n.ls[n.i], chr(10) ORDER BY n.i) FILTER (g.i IS NULL) AS text, count(g.i) AS gone FROM n LEFT JOIN g ON g.doc_id = n.doc_id AND g.i = n.i GROUP BY 1)
SELECT t.doc_id, CASE WHEN t.text IS NOT NULL THEN coalesce(q.text, '') END AS text, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(gone, 0) AS BIGINT) AS n_deleted
FROM t LEFT JOIN q USING (doc_id)
"""

OP2_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y
  FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(x, y) AS (
  SELECT x, y FROM l
  UNION
  SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x),
n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x),
c AS (SELECT x, min(y) AS low FROM reach GROUP BY x)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links,
       least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN c ON c.x = vec_id
"""

OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id) AS keep_id
  FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""

OP7_SQL = r"""
WITH u AS (
  SELECT page_id,
         CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
rules(r_verdict, r_host, r_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
f AS (
  SELECT page_id, r_host || r_path AS rule, r_verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r_host) DESC, length(r_path) DESC) AS k
  FROM p JOIN rules ON (host = r_host OR host LIKE '%.' || r_host) AND starts_with(path, r_path))
SELECT p.page_id, host, path, f.rule, coalesce(f.r_verdict, 'allow') AS verdict
FROM p LEFT JOIN f ON f.page_id = p.page_id AND f.k = 1
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash": op1_minhash,
        "op2_embeddings": op2_embeddings,
        "op3_packing": op3_packing,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_line_dedup": op5_line_dedup,
        "op6_bpe": op6_bpe,
        "op7_url_filter": op7_url_filter,
        "op8_sharding": op8_sharding,
        "op9_toxicity": op9_toxicity,
        "op10_pii": op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": OP1_SQL, "op2_embeddings": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op5_line_dedup": OP5_SQL, "op7_url_filter": OP7_SQL}
