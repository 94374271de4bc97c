"""Queries over what a scan sees: predicates, names, interning, journals, digests, manifests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stackroom.functions import hashing, predicates
from stackroom.operators import browse, curate, merge, redundancy, tree
from stackroom.plans import mapping as m
from stackroom.plans.catalog import query
from stackroom.sinks import exports

ENTRY_SQL = """
entry AS (
  SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 1040 WHEN 1 THEN 1024 WHEN 2 THEN 1024 WHEN 3 THEN 4195328 WHEN 4 THEN 32 ELSE 4128 END AS attrs,
         CASE WHEN event_id % 6 = 1 THEN 2684354572 WHEN event_id % 6 = 2 THEN 2415919130 END AS tag, event_id % 6 = 0 AS is_dir, event_id % 41 = 0 AS failed,
         116444736000000000 + (event_id - 50) * 10000000 AS ft,
         CASE event_id % 8 WHEN 0 THEN 'a.TXT' WHEN 1 THEN '.bashrc' WHEN 2 THEN 'x.' WHEN 3 THEN '..a' WHEN 4 THEN 'b.tar.gz' WHEN 5 THEN 'plain' WHEN 6 THEN '~$lock.doc' ELSE 'f' || event_id || '.tmp' END AS name
  FROM events)"""


def _entries(spark, sf_dir):
    i = F.col("event_id")
    k, n = i % 6, i % 8
    name = F.when(n == 0, "a.TXT").when(n == 1, ".bashrc").when(n == 2, "x.").when(n == 3, "..a").when(n == 4, "b.tar.gz").when(n == 5, "plain").when(n == 6, "~$lock.doc").otherwise(F.concat(F.lit("f"), i.cast("string"), F.lit(".tmp")))
    attrs = F.when(k == 0, 1040).when((k == 1) | (k == 2), 1024).when(k == 3, 4_195_328).when(k == 4, 32).otherwise(4128)
    tag = F.when(k == 1, 2_684_354_572).when(k == 2, 2_415_919_130)
    return m.table(spark, sf_dir, "events").select(
        i.alias("id"), attrs.cast("long").alias("attrs"), tag.cast("long").alias("tag"), (k == 0).alias("is_dir"), (i % 41 == 0).alias("failed"),
        (F.lit(predicates.FILETIME_EPOCH) + (i - 50) * 10_000_000).alias("ft"), name.alias("name"),
    )


@query(
    """SELECT id, (attrs & 1024) <> 0 AND (is_dir OR CASE WHEN tag IS NOT NULL THEN (tag & 536870912) <> 0 ELSE (attrs & 4460544) = 0 END) AS link,
              CASE WHEN failed THEN 'unreadable' WHEN (attrs & 4460544) <> 0 THEN 'skipped-dehydrated' ELSE 'ok' END AS read_state,
              greatest((ft - 116444736000000000) * 100, 0) AS ns FROM entry""",
    ENTRY_SQL,
)
def scan_predicates(spark, sf_dir):
    """F3, F4, F5, S7."""
    link = predicates.skip_as_link(F.col("attrs"), F.col("tag"), F.col("is_dir"))
    return _entries(spark, sf_dir).select("id", link.alias("link"), predicates.read_state(F.col("failed"), F.col("attrs")).alias("read_state"), predicates.filetime_ns(F.col("ft")).alias("ns"))


@query(
    """SELECT id, nullif(lower(regexp_extract(name, '^.*[^.].*\\.([^.]+)$', 1)), '') AS ext,
              name ILIKE '%.tmp' OR name LIKE '~$%' OR lower(name) LIKE 'b.%' OR name = 'plain' AS excluded FROM entry""",
    ENTRY_SQL,
)
def names_in_scope(spark, sf_dir):
    """F2, F6."""
    skip = predicates.exclusion(["b.*", "[op]lain"], "/")
    return _entries(spark, sf_dir).select("id", curate.extension(F.col("name")).alias("ext"), skip(F.col("name"), F.col("name"), F.col("name")).alias("excluded"))


@query(
    """SELECT DISTINCT page_id % 3 AS volume_id, k AS depth, CASE WHEN k = 0 THEN '' ELSE p[k] END AS name
       FROM (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM pages), range(0, 20) r(k) WHERE k <= len(p)"""
)
def intern_dirs(spark, sf_dir):
    """M4, K10: url paths as directories."""
    paths = m.table(spark, sf_dir, "pages").select((F.col("page_id") % 3).alias("volume_id"), F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("path"))
    return merge.intern_dirs(paths).select("volume_id", F.col("depth").cast("long").alias("depth"), "name").distinct()


@query(
    """SELECT doc_id AS id, CASE WHEN s < 60 THEN 'just now' WHEN s // 60 < 90 THEN (s // 60) || ' minutes ago' WHEN s // 3600 < 36 THEN (s // 3600) || ' hours ago'
              WHEN s // 86400 < 60 THEN (s // 86400) || ' days ago' ELSE (s // 86400 // 30) || ' months ago' END AS text
       FROM (SELECT doc_id, doc_id * n_chars AS s FROM documents)"""
)
def staleness_text(spark, sf_dir):
    """D4."""
    return m.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), browse.staleness(F.col("doc_id") * F.col("n_chars")).alias("text"))


@query(
    """, tree(frn) AS (SELECT user_id FROM t WHERE user_id = 1 UNION ALL SELECT t.user_id FROM t JOIN tree ON t.parent = tree.frn WHERE t.user_id <> 1)
       SELECT user_id AS frn FROM t WHERE user_id NOT IN (SELECT frn FROM tree)""",
    "t AS (SELECT DISTINCT user_id, CASE WHEN user_id % 10 = 9 THEN 100000 + user_id ELSE user_id // 3 END AS parent FROM events)",
    recursive=True,
)
def frn_orphans(spark, sf_dir):
    """M12's orphans."""
    u = F.col("user_id")
    nodes = m.table(spark, sf_dir, "events").select(u.alias("frn"), F.when(u % 10 == 9, 100_000 + u).otherwise(F.expr("user_id div 3")).alias("parent_frn")).distinct().where("frn > 0 OR frn = 0")
    # 0 is its own parent in this mapping: a root of its own, and an orphan.
    nodes = nodes.withColumn("parent_frn", F.when(F.col("frn") == 0, F.lit(None)).otherwise(F.col("parent_frn")))
    return tree.orphans(nodes, 1).select("frn")


@query(
    """, alive AS (SELECT content_id, size_bytes, quick, count(*) AS live FROM c GROUP BY ALL),
       s AS (SELECT *, sum(live) OVER (PARTITION BY size_bytes, quick) AS sharing FROM alive)
       SELECT content_id AS id, CAST(sharing AS BIGINT) AS sharing FROM s WHERE sharing > 1 AND content_id NOT LIKE '%f'""",
    "c AS (SELECT p_size AS size_bytes, p_brand || (p_partkey % 9) AS quick, p_size || p_brand || (p_partkey % 9) || CASE WHEN p_partkey % 4 = 0 THEN 'f' ELSE 'q' END AS content_id FROM part)",
)
def hash_collisions(spark, sf_dir):
    """H6, J9."""
    k = F.col("p_partkey")
    quick = F.concat("p_brand", (k % 9).cast("string"))
    full = F.when(k % 4 == 0, "f")
    rows = m.table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_size").cast("long").alias("size_bytes"), quick.alias("quick_hash"), full.alias("full_hash"), F.lit(None).cast("string").alias("vanished_at"))
    rows = rows.withColumn("content_id", F.concat(F.col("size_bytes").cast("string"), "quick_hash", F.coalesce("full_hash", F.lit("q"))))
    contents = rows.select(F.col("content_id").alias("id"), "size_bytes", "quick_hash", "full_hash").distinct()
    return redundancy.collisions(contents, rows).select("id", "sharing")


@F.pandas_udf(StringType())
def _quick_digest(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: hashing.quick_digest((t or "").encode()).hex())


@query()
def quick_hash_blake2b(spark, sf_dir):
    """H2, H3."""
    return m.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), _quick_digest("text").alias("quick_hash"), (F.octet_length("text") <= hashing.SMALL).alias("exact"))


PLACE_SQL = """
place AS (SELECT *, CASE WHEN drive_id IS NOT NULL THEN 'drive' ELSE 'volume' END AS kind, coalesce(drive_id, volume_id) AS ident FROM live),
spread AS (SELECT content_id, count(DISTINCT kind || ident) AS places FROM place WHERE content_id IS NOT NULL GROUP BY 1)"""


def _manifest(spark, sf_dir):
    files = m.files(spark, sf_dir).withColumn("path", F.concat_ws("/", F.lit("v"), F.col("ext"), F.col("name")))
    none = spark.createDataFrame([], "id string, full_hash binary, hash_algo string")
    return exports.manifest_files(files, m.volumes(spark, sf_dir), none)


@query(
    """SELECT kind, ident, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) FILTER (coalesce(places, 1) = 1) AS only_here
       FROM place LEFT JOIN spread USING (content_id) GROUP BY 1, 2""",
    m.FILE_SQL, PLACE_SQL,
)
def manifest_totals(spark, sf_dir):
    """K4, A26, J6, J19."""
    return exports.manifest_totals(_manifest(spark, sf_dir))


@query("SELECT kind, ident, 'v/' || ext AS top, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM place GROUP BY 1, 2, 3", m.FILE_SQL, PLACE_SQL)
def manifest_by_top_folder(spark, sf_dir):
    """A26 by top folder."""
    return exports.by_top_folder(_manifest(spark, sf_dir))


@query(
    """SELECT id, (CASE WHEN manufacturer = 'Maker1' THEN 1 ELSE 0 END) + (CASE WHEN purchase_date IS NOT NULL THEN 1 ELSE 0 END) + 1 AS filled,
              7 - (CASE WHEN manufacturer = 'Maker1' THEN 1 ELSE 0 END) - (CASE WHEN purchase_date IS NOT NULL THEN 1 ELSE 0 END) - 1 AS missing FROM drives""",
    m.DRIVE_SQL,
)
def completeness(spark, sf_dir):
    """C6."""
    none = F.lit(None).cast("string")
    rows = m.drives(spark, sf_dir).select("id", F.col("model").alias("title"), F.when(F.col("manufacturer") == "Maker1", "x").otherwise(" ").alias("description"), F.col("purchase_date").alias("coverage"), *[none.alias(c) for c in ("creators", "subject", "license", "contact")])
    return curate.completeness(rows).select("id", "filled", "missing")


@query(
    """SELECT k.id FROM dirs k JOIN dirs p ON p.id = k.parent_id WHERE NOT k.vanished AND p.depth = 1 AND p.id % 2 = 0 AND k.id % 4 <> 1""",
    m.TREE_SQL, recursive=True,
)
def missing_children(spark, sf_dir):
    """U5, M10's comparison of a listing with the catalogue."""
    dirs = m.tree_dirs(spark, sf_dir)
    listed = dirs.where("depth = 1 AND id % 2 = 0").select(F.col("id").alias("dir_id"))
    seen = dirs.where("id % 4 = 1").select(F.col("id").alias("dir_id"))
    return merge.missing_children(dirs, listed, seen).select(F.col("dir_id").alias("id"))
