"""The catalog's tables as views over the benchmark tables.

``documents`` are files of twenty volumes, two to a drive, the last two volumes unverified;
region > nation > customer > order is the directory forest; ``lineitem`` is a second fleet of
eight drives; ``supplier`` describes drives; ``events`` are journals and health readings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.operators.redundancy import identified


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    number = F.substring("source", 4, 18).cast("long")
    rows = d.select(
        F.col("doc_id").alias("id"),
        number.alias("volume_id"),
        number.alias("dir_id"),
        F.concat_ws("_", "source", F.col("doc_id").cast("string")).alias("name"),
        F.col("lang").alias("ext"),
        F.col("n_chars").alias("size_bytes"),
        ((F.lit(1_500_000_000) + F.col("doc_id") * 259_200) * 1_000_000_000).cast("long").alias("mtime_ns"),
        F.when(F.col("doc_id") % 3 == 0, F.expr("doc_id div 6")).alias("frn"),
        F.when(F.col("doc_id") % 53 == 7, "unreadable").otherwise("ok").alias("read_state"),
        F.when(F.col("doc_id") % 97 == 5, "2026-01-01T00:00:00Z").alias("vanished_at"),
        F.sha2("text", 256).alias("h"),
    )
    return identified(rows, "h").drop("h")


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return spark.range(20).select(
        "id",
        F.when(i < 18, F.expr("id div 2")).alias("drive_id"),
        F.concat(F.lit("vol"), F.expr("id div 2 div 3").cast("string")).alias("label"),
        ((i % 4 + 1) * 100_000_000).alias("capacity_bytes"),
        ((i * 7 % 5) * 20_000_000).alias("free_bytes"),
        F.when(i % 2 == 0, 4096).otherwise(131_072).cast("long").alias("cluster_bytes"),
    )


def drives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as drives."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("id"),
        F.concat(F.lit("SN"), F.lpad((k * 37).cast("string"), 8, "0")).alias("serial"),
        F.concat(F.lit("Maker"), (k % 3).cast("string")).alias("manufacturer"),
        F.concat(F.lit("ST40"), F.lpad((k % 7).cast("string"), 2, "0"), F.lit("VN-"), (k % 5).cast("string")).alias("model"),
        F.when(k % 4 == 0, "usb").otherwise("sata").alias("bus"),
        F.when(k % 5 == 0, "ssd").when(k % 11 == 0, "flash").otherwise("hdd").alias("media"),
        F.when(k % 6 != 0, F.concat((F.lit(2017) + k % 9).cast("string"), F.lit("-"), F.lpad((k % 12 + 1).cast("string"), 2, "0"))).alias("purchase_date"),
        F.when(k % 10 == 3, "box-a").alias("batch_key"),
        F.when(F.col("s_nationkey") % 3 != 0, F.concat(F.lit("zone"), (F.col("s_nationkey") % 3).cast("string"))).alias("disaster_zone"),
        F.when(k % 13 == 0, "working").otherwise("archive").alias("role"),
    )


def fleet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as files of contents (parts) on eight drives, 1 to 8; drive 8 is unverified."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("content_id"), (F.col("l_suppkey") % 8 + 1).alias("drive"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("content_id"), F.round(F.col("p_retailprice") * 100).cast("long").alias("size_bytes"))
    return li.join(part, "content_id").withColumn("drive_id", F.when(F.col("drive") < 8, F.col("drive")))


def tree_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as directories; ids in ranges of their own."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("name"), F.lit(0).alias("depth"))
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1000).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("parent_id"), F.col("n_name").alias("name"), F.lit(1).alias("depth"))
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1_000_000).alias("id"), (F.col("c_nationkey") + 1000).cast("long").alias("parent_id"), F.col("c_name").alias("name"), F.lit(2).alias("depth"))
    dirs = r.unionByName(n).unionByName(c)
    return dirs.withColumn("vanished_at", F.when(F.col("id") % 101 == 7, "2026-01-01T00:00:00Z"))


def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of their customer's directory, bytes the price in cents."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") + 1_000_000).alias("dir_id"),
        F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"), F.lit("."), F.lower(F.substring("o_orderpriority", 3, 3))).alias("name"),
        F.lower(F.substring("o_orderpriority", 3, 3)).alias("ext"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("size_bytes"),
        F.col("o_orderdate").alias("modified"),
        F.when(F.col("o_orderkey") % 89 == 3, "2026-01-01T00:00:00Z").alias("vanished_at"),
    )


#: The same views in SQL.
FILE_SQL = """
base AS (
  SELECT doc_id AS id, CAST(substr(source, 4) AS BIGINT) AS volume_id, n_chars AS size_bytes, lang AS ext,
         source || '_' || doc_id AS name, (1500000000 + doc_id * 259200) * 1000000000 AS mtime_ns,
         CASE WHEN doc_id % 3 = 0 THEN doc_id // 6 END AS frn,
         CASE WHEN doc_id % 53 = 7 THEN 'unreadable' ELSE 'ok' END AS read_state,
         doc_id % 97 = 5 AS vanished, sha256(text) AS h
  FROM documents),
shared AS (SELECT size_bytes FROM base WHERE NOT vanished AND read_state = 'ok' AND size_bytes > 0 GROUP BY 1 HAVING count(*) > 1),
file AS (
  SELECT *, CASE WHEN NOT vanished AND read_state = 'ok' AND size_bytes > 0 AND size_bytes IN (SELECT size_bytes FROM shared) THEN h END AS content_id
  FROM base),
live AS (SELECT *, CASE WHEN volume_id < 18 THEN volume_id // 2 END AS drive_id FROM file WHERE NOT vanished),
groups AS (
  SELECT content_id, max(size_bytes) AS size_bytes, count(*) AS paths,
         greatest(count(DISTINCT drive_id), 1) AS drives,
         count(DISTINCT coalesce(drive_id, -volume_id)) AS drives_possible,
         count(DISTINCT volume_id || ':' || coalesce(CAST(frn AS VARCHAR), 'f' || id)) AS physical_copies
  FROM live WHERE content_id IS NOT NULL GROUP BY content_id),
grouped AS (SELECT *, greatest(0, physical_copies - drives_possible) * size_bytes AS reclaimable_bytes FROM groups),
alone AS (SELECT size_bytes FROM live GROUP BY 1 HAVING count(*) = 1),
single AS (SELECT * FROM live WHERE content_id IS NULL AND size_bytes > 0 AND size_bytes IN (SELECT size_bytes FROM alone))
"""

TREE_SQL = """
dirs AS (
  SELECT *, id % 101 = 7 AS vanished FROM (
    SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, r_name AS name, 0 AS depth FROM region
    UNION ALL SELECT n_nationkey + 1000, n_regionkey, n_name, 1 FROM nation
    UNION ALL SELECT c_custkey + 1000000, c_nationkey + 1000, c_name, 2 FROM customer)),
tfile AS (
  SELECT o_orderkey AS id, o_custkey + 1000000 AS dir_id, lower(substr(o_orderpriority, 3, 3)) AS ext,
         'order_' || o_orderkey || '.' || lower(substr(o_orderpriority, 3, 3)) AS name,
         CAST(round(o_totalprice * 100) AS BIGINT) AS size_bytes, o_orderdate AS modified, o_orderkey % 89 = 3 AS vanished
  FROM orders),
closure(ancestor, descendant, distance) AS (
  SELECT id, id, 0 FROM dirs
  UNION ALL
  SELECT d.parent_id, c.descendant, c.distance + 1 FROM closure c JOIN dirs d ON d.id = c.ancestor WHERE d.parent_id IS NOT NULL)
"""

DRIVE_SQL = """
drives AS (
  SELECT s_suppkey AS id, 'SN' || lpad(CAST(s_suppkey * 37 AS VARCHAR), 8, '0') AS serial,
         'Maker' || (s_suppkey % 3) AS manufacturer,
         'ST40' || lpad(CAST(s_suppkey % 7 AS VARCHAR), 2, '0') || 'VN-' || (s_suppkey % 5) AS model,
         CASE WHEN s_suppkey % 4 = 0 THEN 'usb' ELSE 'sata' END AS bus,
         CASE WHEN s_suppkey % 5 = 0 THEN 'ssd' WHEN s_suppkey % 11 = 0 THEN 'flash' ELSE 'hdd' END AS media,
         CASE WHEN s_suppkey % 6 <> 0 THEN (2017 + s_suppkey % 9) || '-' || lpad(CAST(s_suppkey % 12 + 1 AS VARCHAR), 2, '0') END AS purchase_date,
         CASE WHEN s_suppkey % 10 = 3 THEN 'box-a' END AS batch_key,
         CASE WHEN s_nationkey % 3 <> 0 THEN 'zone' || (s_nationkey % 3) END AS disaster_zone,
         CASE WHEN s_suppkey % 13 = 0 THEN 'working' ELSE 'archive' END AS role
  FROM supplier)
"""
