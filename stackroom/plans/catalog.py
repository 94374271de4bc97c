"""Redundancy, browsing and tree queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.operators import browse, redundancy, tree
from stackroom.plans import mapping as m
from stackroom.session import checkpointed

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str, recursive: bool = False):
    """Register a function under its name, with its SQL behind the views it needs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            head = f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(ctes) if ctes else ""
            ORACLES[f.__name__] = f"{head}\n{sql}"
        return f

    return add


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redundancy.content_groups(m.files(spark, sf_dir), m.volumes(spark, sf_dir))


def _singles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redundancy.single_copies(m.files(spark, sf_dir), m.volumes(spark, sf_dir))


@query("SELECT * FROM grouped", m.FILE_SQL)
def redundancy_groups(spark, sf_dir):
    """A1, A2, J1, J2, J7, H1, T1, T2, T25."""
    return _groups(spark, sf_dir)


@query("SELECT content_id, size_bytes, paths FROM grouped WHERE paths > 1 ORDER BY size_bytes * paths DESC, content_id LIMIT 100", m.FILE_SQL)
def duplicate_groups(spark, sf_dir):
    """A4, O4."""
    rows = redundancy.duplicate_groups(_groups(spark, sf_dir)).select("content_id", "size_bytes", "paths")
    return rows.orderBy((F.col("size_bytes") * F.col("paths")).desc(), "content_id").limit(100)


@query("SELECT content_id, size_bytes, paths, drives, physical_copies, reclaimable_bytes FROM grouped WHERE paths > 1 AND reclaimable_bytes > 0", m.FILE_SQL)
def reclamation(spark, sf_dir):
    """A6."""
    return redundancy.reclamation(_groups(spark, sf_dir)).select("content_id", "size_bytes", "paths", "drives", "physical_copies", "reclaimable_bytes")


@query("SELECT id, volume_id, size_bytes FROM single", m.FILE_SQL)
def single_copy(spark, sf_dir):
    """A3, W1."""
    return _singles(spark, sf_dir).select("id", "volume_id", "size_bytes")


@query(
    """SELECT content_id, CAST(NULL AS BIGINT) AS file_id, size_bytes, paths, drives FROM grouped WHERE drives < 2
       UNION ALL SELECT NULL, id, size_bytes, 1, 1 FROM single""",
    m.FILE_SQL,
)
def under_protected(spark, sf_dir):
    """A5, U1."""
    return redundancy.under_protected(_groups(spark, sf_dir), _singles(spark, sf_dir))


@query("SELECT id, size_bytes, read_state FROM live WHERE content_id IS NULL AND size_bytes NOT IN (SELECT size_bytes FROM alone)", m.FILE_SQL)
def unhashed(spark, sf_dir):
    """A8, J8, T3, T4."""
    return redundancy.unhashed(m.files(spark, sf_dir)).select("id", "size_bytes", "read_state")


@query(
    """SELECT count(*) AS identified, count(*) FILTER (paths > 1) AS duplicate_groups,
              CAST(coalesce(sum(paths - 1) FILTER (paths > 1), 0) AS BIGINT) AS extra_paths,
              CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS identified_bytes,
              count(*) FILTER (reclaimable_bytes > 0) AS reclamation_groups,
              CAST(coalesce(sum(reclaimable_bytes), 0) AS BIGINT) AS reclaimable_bytes,
              count(*) FILTER (drives_possible <> drives) AS identity_uncertain,
              (SELECT count(*) FROM single) AS single_copy_files,
              (SELECT CAST(coalesce(sum(size_bytes), 0) AS BIGINT) FROM single) AS single_copy_bytes,
              count(*) FILTER (drives < 2) + (SELECT count(*) FROM single) AS under_protected,
              CAST(coalesce(sum(size_bytes) FILTER (drives < 2), 0) + (SELECT coalesce(sum(size_bytes), 0) FROM single) AS BIGINT) AS under_protected_bytes,
              (SELECT count(*) FROM live WHERE content_id IS NULL AND size_bytes NOT IN (SELECT size_bytes FROM alone)) AS unhashed_files
       FROM grouped""",
    m.FILE_SQL,
)
def redundancy_summary(spark, sf_dir):
    """A7."""
    files = m.files(spark, sf_dir)
    # What is written holds the columns that are read, so no other expression of the view is computed.
    singles = _singles(spark, sf_dir).select("id", "size_bytes")
    return redundancy.summary(files, checkpointed(_groups(spark, sf_dir)), checkpointed(singles))


@query(
    """SELECT b.id, b.volume_id, b.size_bytes FROM base b WHERE NOT vanished AND read_state = 'ok' AND size_bytes > 0
       AND size_bytes IN (SELECT size_bytes FROM shared)""",
    m.FILE_SQL,
)
def hash_candidates(spark, sf_dir):
    """H1, J7, O3: before any file has an identity."""
    fresh = m.files(spark, sf_dir).withColumn("content_id", F.lit(None).cast("string"))
    return redundancy.reading_order(redundancy.hash_candidates(fresh)).select("id", "volume_id", "size_bytes")


@query(
    """SELECT count(*) FILTER (NOT vanished) AS files, CAST(coalesce(sum(size_bytes) FILTER (NOT vanished), 0) AS BIGINT) AS bytes,
              count(*) FILTER (vanished) AS vanished_files, count(*) FILTER (NOT vanished AND content_id IS NOT NULL) AS identified_files,
              count(*) FILTER (NOT vanished AND read_state <> 'ok') AS unread_files,
              (SELECT count(*) FROM dirs WHERE NOT vanished) AS dirs, 20 AS volumes, (SELECT count(*) FROM drives) AS drives FROM file""",
    m.FILE_SQL, m.TREE_SQL.partition("tfile AS")[0].rstrip().rstrip(","), m.DRIVE_SQL,
)
def catalog_counts(spark, sf_dir):
    """A9."""
    return redundancy.counts(m.files(spark, sf_dir), m.tree_dirs(spark, sf_dir), m.volumes(spark, sf_dir), m.drives(spark, sf_dir))


@query(
    """SELECT count(*) AS files, count(content_id) AS identified, (SELECT count(*) FROM single) AS single,
              least(1.0, round((count(content_id) + (SELECT count(*) FROM single)) / count(*), 6)) AS coverage FROM live""",
    m.FILE_SQL,
)
def identity_coverage(spark, sf_dir):
    """D2."""
    return redundancy.identity_coverage(m.files(spark, sf_dir), _singles(spark, sf_dir))


@query(
    """, places AS (SELECT content_id, count(DISTINCT coalesce(drive_id, -volume_id - 1)) - 1 AS elsewhere FROM live WHERE content_id IS NOT NULL GROUP BY 1)
       SELECT id, content_id, CAST(elsewhere AS INTEGER) AS elsewhere FROM live JOIN places USING (content_id)""",
    m.FILE_SQL,
)
def copies_elsewhere(spark, sf_dir):
    """J19, K4's count per file, A15."""
    return redundancy.copies_elsewhere(m.files(spark, sf_dir), m.volumes(spark, sf_dir)).select("id", "content_id", "elsewhere")


FIXITY_SQL = """
fixity AS (
  SELECT event_id AS id, user_id AS file_id, ts, CASE WHEN event_type = 'error' THEN 'mismatch' WHEN event_id % 50 = 1 THEN 'unreadable'
         WHEN event_id % 50 = 2 THEN 'modified' ELSE 'ok' END AS result FROM events)"""


def _fixity(spark, sf_dir):
    e = m.table(spark, sf_dir, "events")
    k = F.col("event_id") % 50
    result = F.when(F.col("event_type") == "error", "mismatch").when(k == 1, "unreadable").when(k == 2, "modified").otherwise("ok")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("file_id"), F.col("ts"), result.alias("result"))


@query(
    """SELECT x.id, x.file_id, x.result, f.name, coalesce(g.paths - 1, 0) AS other_copies
       FROM fixity x JOIN file f ON f.id = x.file_id LEFT JOIN groups g ON g.content_id = f.content_id
       WHERE x.result NOT IN ('ok', 'modified') ORDER BY x.id DESC LIMIT 200""",
    m.FILE_SQL, FIXITY_SQL,
)
def integrity_incidents(spark, sf_dir):
    """H11, J11, O7."""
    files = m.files(spark, sf_dir)
    fixity = _fixity(spark, sf_dir).join(files.select(F.col("id").alias("file_id"), "content_id"), "file_id")
    rows = redundancy.incidents(fixity, files, _groups(spark, sf_dir))
    return rows.select("id", "file_id", "result", "name", "other_copies").orderBy(F.desc("id")).limit(200)


@query("SELECT ancestor, descendant, distance FROM closure", m.TREE_SQL, recursive=True)
def dir_closure(spark, sf_dir):
    """J10, U3, M12's walk."""
    return tree.closure(m.tree_dirs(spark, sf_dir))


@query(
    """SELECT descendant AS id, string_agg(d.name, '/' ORDER BY distance DESC) AS path FROM closure c JOIN dirs d ON d.id = c.ancestor GROUP BY 1""",
    m.TREE_SQL, recursive=True,
)
def dir_paths(spark, sf_dir):
    """M5, J10 upwards."""
    dirs = m.tree_dirs(spark, sf_dir)
    return tree.paths(dirs, tree.closure(dirs))


@query(
    """, direct AS (SELECT dir_id, count(*) AS files, sum(size_bytes) AS bytes FROM tfile WHERE NOT vanished GROUP BY 1),
       sub AS (SELECT ancestor, sum(files) AS f, sum(bytes) AS b FROM closure JOIN direct ON dir_id = descendant GROUP BY 1)
       SELECT id, coalesce(files, 0) AS files, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes,
              CAST(coalesce(f, 0) AS BIGINT) AS subtree_files, CAST(coalesce(b, 0) AS BIGINT) AS subtree_bytes
       FROM dirs LEFT JOIN direct ON dir_id = id LEFT JOIN sub ON ancestor = id WHERE NOT dirs.vanished""",
    m.TREE_SQL, recursive=True,
)
def dir_rollup(spark, sf_dir):
    """A10, A11, J4, J5."""
    dirs = m.tree_dirs(spark, sf_dir)
    return tree.rollup(dirs, m.tree_files(spark, sf_dir), tree.closure(dirs))


@query(
    """, direct AS (SELECT dir_id, count(*) AS files, sum(size_bytes) AS bytes FROM tfile WHERE NOT vanished GROUP BY 1),
       sub AS (SELECT ancestor, sum(files) AS f FROM closure JOIN direct ON dir_id = descendant GROUP BY 1)
       SELECT d.id, d.name, CAST(coalesce(f, 0) AS BIGINT) AS subtree_files,
              EXISTS (SELECT 1 FROM dirs k WHERE k.parent_id = d.id AND NOT k.vanished) AS has_children
       FROM dirs d LEFT JOIN sub ON ancestor = d.id WHERE NOT d.vanished AND d.parent_id IS NULL""",
    m.TREE_SQL, recursive=True,
)
def child_dirs(spark, sf_dir):
    """J9, F12, F1."""
    dirs = m.tree_dirs(spark, sf_dir)
    rollups = tree.rollup(dirs, m.tree_files(spark, sf_dir), tree.closure(dirs))
    return tree.child_dirs(dirs, rollups, None).select("id", "name", "subtree_files", "has_children")


@query(
    """SELECT count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM tfile
       WHERE NOT vanished AND dir_id IN (SELECT descendant FROM closure WHERE ancestor IN (2, 1005))""",
    m.TREE_SQL, recursive=True,
)
def subtree_stats(spark, sf_dir):
    """A19, C7, F7: a region and a nation as one collection."""
    roots = spark.createDataFrame([(2,), (1005,)], "dir_id long")
    dirs = m.tree_dirs(spark, sf_dir)
    rows = tree.subtree_files(m.tree_files(spark, sf_dir), tree.closure(dirs), roots)
    return rows.agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


@query("SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part WHERE p_partkey > 25 ORDER BY id LIMIT 200")
def dir_page_keyset(spark, sf_dir):
    """O1, O2."""
    part = m.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return tree.page(part, "id", 25)


@query("SELECT id, name FROM tfile WHERE NOT vanished AND lower(name) LIKE '%er_1_2%.%' ORDER BY id LIMIT 50", m.TREE_SQL, recursive=True)
def find_like(spark, sf_dir):
    """F11, T5."""
    return browse.find_like(m.tree_files(spark, sf_dir), "%ER_1_2%.%").select("id", "name")


@query(
    """, words AS (SELECT id, string_split_regex(lower(name), '[^a-z0-9]+') AS ts, dir_id FROM tfile WHERE NOT vanished),
       dw AS (SELECT id AS d, string_split_regex(lower(name), '[^a-z0-9]+') AS ds FROM dirs WHERE NOT vanished)
       SELECT w.id FROM words w LEFT JOIN dw ON d = dir_id
       WHERE (len(list_filter(ts, lambda t: starts_with(t, 'ord'))) > 0 AND len(list_filter(ts, lambda t: starts_with(t, '12'))) > 0)
          OR (len(list_filter(ds, lambda t: starts_with(t, 'ord'))) > 0 AND len(list_filter(ds, lambda t: starts_with(t, '12'))) > 0)
       ORDER BY w.id LIMIT 50""",
    m.TREE_SQL, recursive=True,
)
def search_words(spark, sf_dir):
    """F10."""
    return browse.search(m.tree_files(spark, sf_dir), m.tree_dirs(spark, sf_dir), "ORD_12").select("id")


SCAN_SQL = "scans AS (SELECT event_id AS id, user_id % 20 AS volume_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status, event_id AS finished_at FROM events)"


def _scans(spark, sf_dir):
    e = m.table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("volume_id"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"), F.col("event_id").alias("finished_at"))


@query("SELECT volume_id, max(finished_at) AS last_scan FROM scans WHERE status = 'done' GROUP BY 1", SCAN_SQL)
def last_scan(spark, sf_dir):
    """A25."""
    return browse.last_scan(_scans(spark, sf_dir), "volume_id")


@query(
    """SELECT v.range AS id, CASE WHEN v.range < 18 THEN v.range // 2 END AS drive_id, d.serial, coalesce(f.files, 0) AS files,
              CAST(coalesce(f.bytes, 0) AS BIGINT) AS bytes, s.last_scan
       FROM range(20) v LEFT JOIN (SELECT volume_id, count(*) AS files, sum(size_bytes) AS bytes FROM live GROUP BY 1) f ON f.volume_id = v.range
       LEFT JOIN drives d ON d.id = CASE WHEN v.range < 18 THEN v.range // 2 END
       LEFT JOIN (SELECT volume_id, max(finished_at) AS last_scan FROM scans WHERE status = 'done' GROUP BY 1) s ON s.volume_id = v.range""",
    m.FILE_SQL, m.DRIVE_SQL, SCAN_SQL,
)
def drive_inventory(spark, sf_dir):
    """A12, J3, D10, S13."""
    rows = browse.inventory(m.volumes(spark, sf_dir), m.drives(spark, sf_dir), m.files(spark, sf_dir), _scans(spark, sf_dir))
    return rows.select("id", "drive_id", "serial", "files", "bytes", "last_scan")


@query(
    """SELECT size_bytes, count(*) AS files FROM live GROUP BY 1 HAVING count(*) > 1 ORDER BY size_bytes * count(*) DESC, size_bytes LIMIT 20""",
    m.FILE_SQL,
)
def duplicated_sizes(spark, sf_dir):
    """O6."""
    from stackroom.schema import live

    rows = live(m.files(spark, sf_dir)).groupBy("size_bytes").agg(F.count("*").alias("files")).where("files > 1")
    return rows.orderBy((F.col("size_bytes") * F.col("files")).desc(), "size_bytes").limit(20)


@query(
    """SELECT user_id AS id,
         CASE WHEN user_id % 5 = 0 THEN 'walk' WHEN user_id % 7 = 0 THEN 'walk' WHEN user_id % 11 = 0 THEN 'usn-full' WHEN user_id % 13 = 0 THEN 'usn-full'
              WHEN user_id % 17 = 0 THEN 'usn-full' WHEN lo + 40 < user_id % 100 THEN 'usn-full' WHEN lo + 40 > hi THEN 'usn-full' ELSE 'usn-delta' END AS method,
         CASE WHEN user_id % 5 = 0 THEN 'no change journal' WHEN user_id % 7 = 0 THEN 'journal needs administrator rights'
              WHEN user_id % 11 = 0 THEN 'journal could not be queried' WHEN user_id % 13 = 0 THEN 'first scan' WHEN user_id % 17 = 0 THEN 'journal was recreated'
              WHEN lo + 40 < user_id % 100 THEN 'records were purged' WHEN lo + 40 > hi THEN 'journal is older than the cursor'
              WHEN lo + 40 = hi THEN 'no activity' ELSE 'changes since the last scan' END AS reason
       FROM (SELECT user_id, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY 1)"""
)
def enumeration_decision(spark, sf_dir):
    """M11, T-S2."""
    e = m.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    i = F.col("id")
    v = e.select(
        "id", (i % 5 != 0).alias("supports_usn"), (i % 7 != 0).alias("elevated"),
        F.when(i % 11 != 0, F.lit(1)).alias("journal_id"), (i % 100).alias("lowest_valid_usn"), F.col("hi").alias("next_usn"),
        F.when(i % 13 != 0, F.when(i % 17 == 0, 2).otherwise(1)).alias("cursor_id"), (F.col("lo") + 40).alias("cursor_usn"),
    )
    return browse.enumeration_decision(v).select("id", "method", "reason")


@query(
    """, b AS (SELECT *, CASE WHEN id % 8 = 0 THEN 'Big ' || (id % 3) ELSE model END AS base FROM drives)
       SELECT id, CASE WHEN count(*) OVER (PARTITION BY lower(base)) = 1 THEN base
                       WHEN count(*) OVER (PARTITION BY lower(base), right(serial, 4)) = 1 THEN base || ' (…' || right(serial, 4) || ')'
                       ELSE base || ' (#' || id || ')' END AS name FROM b""",
    m.DRIVE_SQL,
)
def drive_names(spark, sf_dir):
    """C12, W5."""
    d = m.drives(spark, sf_dir).withColumn("nickname", F.when(F.col("id") % 8 == 0, F.concat(F.lit("Big "), (F.col("id") % 3).cast("string"))))
    none = spark.createDataFrame([], "id long, drive_id long, label string, last_letter string, free_bytes long")
    return browse.drive_names(d, none)
