"""Merge, curation, scorecard and planning queries."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from stackroom.operators import curate, merge, planner, redundancy, risk, scorecard, tree
from stackroom.plans import durability as d
from stackroom.plans import mapping as m
from stackroom.plans.catalog import query
from stackroom.session import checkpointed

EVENT_HALF = """
half AS (SELECT CAST(floor(count(*) / 2) AS BIGINT) AS h FROM events),
ev AS (SELECT event_id, user_id AS dir_id, 'n' || (event_id % 37) AS name, CAST(round(value * 100) AS BIGINT) AS size_bytes, event_id % 5 AS mtime_ns, event_id >= h AS later FROM events, half),
old AS (SELECT dir_id, name, max(event_id) AS event_id FROM ev WHERE NOT later GROUP BY 1, 2),
new AS (SELECT dir_id, name, max(event_id) AS event_id FROM ev WHERE later AND dir_id % 3 <> 0 GROUP BY 1, 2),
o AS (SELECT old.*, size_bytes, mtime_ns, 'c' || old.event_id AS content_id FROM old JOIN ev USING (event_id)),
n AS (SELECT new.*, size_bytes, mtime_ns FROM new JOIN ev USING (event_id))"""


def _merged(spark, sf_dir):
    e = m.table(spark, sf_dir, "events")
    half = e.count() // 2
    rows = e.select("event_id", F.col("user_id").alias("dir_id"), F.concat(F.lit("n"), (F.col("event_id") % 37).cast("string")).alias("name"), F.round(F.col("value") * 100).cast("long").alias("size_bytes"), (F.col("event_id") % 5).alias("mtime_ns"))
    last = lambda part: part.groupBy("dir_id", "name").agg(F.max_by(F.struct("event_id", "size_bytes", "mtime_ns"), "event_id").alias("r")).select("dir_id", "name", "r.*")
    old = last(rows.where(F.col("event_id") < half)).select(
        F.col("event_id").alias("id"), "dir_id", "name", "size_bytes", "mtime_ns", F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("content_id"),
        F.lit(1).cast("long").alias("first_seen_scan"), F.lit(1).cast("long").alias("last_seen_scan"), F.lit(None).cast("string").alias("vanished_at"),
    )
    new = last(rows.where((F.col("event_id") >= half) & (F.col("dir_id") % 3 != 0))).withColumnRenamed("event_id", "id")
    return old, new, merge.merge_files(old, new, 2)


@query(
    """SELECT coalesce(o.event_id, n.event_id) AS id, coalesce(o.dir_id, n.dir_id) AS dir_id, coalesce(o.name, n.name) AS name, coalesce(n.size_bytes, o.size_bytes) AS size_bytes,
              CASE WHEN o.event_id IS NULL THEN 'inserted' WHEN n.event_id IS NOT NULL THEN 'updated' END AS change,
              CASE WHEN n.event_id IS NULL THEN o.content_id WHEN n.size_bytes = o.size_bytes AND n.mtime_ns = o.mtime_ns THEN o.content_id END AS content_id,
              CASE WHEN n.event_id IS NULL THEN 1 ELSE 2 END AS last_seen_scan
       FROM o FULL JOIN n ON o.dir_id = n.dir_id AND o.name = n.name""",
    EVENT_HALF,
)
def merge_upsert(spark, sf_dir):
    """M1, K1, K2, H12, T9."""
    return _merged(spark, sf_dir)[2].select("id", "dir_id", "name", "size_bytes", "change", "content_id", "last_seen_scan")


@query(
    """SELECT o.event_id AS id, o.dir_id, o.name FROM o WHERE o.dir_id IN (SELECT dir_id FROM n)
       AND NOT EXISTS (SELECT 1 FROM n WHERE n.dir_id = o.dir_id AND n.name = o.name)""",
    EVENT_HALF,
)
def tombstones(spark, sf_dir):
    """M2 in the staged directories, U5."""
    _, new, merged = _merged(spark, sf_dir)
    rows = merge.tombstone(merged.drop("change"), 2, "now", new.select("dir_id"))
    return rows.where("vanished_at IS NOT NULL").select("id", "dir_id", "name")


@query(
    """SELECT count(*) FILTER (n.size_bytes = o.size_bytes AND n.mtime_ns = o.mtime_ns) AS kept,
              count(*) FILTER (NOT (n.size_bytes = o.size_bytes AND n.mtime_ns = o.mtime_ns)) AS lost FROM o JOIN n ON o.dir_id = n.dir_id AND o.name = n.name""",
    EVENT_HALF,
)
def identity_keep(spark, sf_dir):
    """H12."""
    rows = _merged(spark, sf_dir)[2].where("change = 'updated'")
    return rows.agg(F.count_if(F.col("content_id").isNotNull()).alias("kept"), F.count_if(F.col("content_id").isNull()).alias("lost"))


@query("SELECT id FROM closure JOIN dirs d ON d.id = descendant WHERE ancestor IN (3, 1007) AND NOT d.vanished", m.TREE_SQL, recursive=True)
def subtree_tombstone(spark, sf_dir):
    """M6, M2 for missing folders: what newly vanishes."""
    dirs = m.tree_dirs(spark, sf_dir)
    gone = spark.createDataFrame([(3,), (1007,)], "dir_id long")
    after = merge.tombstone_dirs(dirs, tree.closure(dirs), gone, "now")
    return after.where("vanished_at = 'now'").select("id")


@query(
    """SELECT DISTINCT frn FROM (SELECT user_id % 40 AS frn FROM events UNION ALL SELECT event_id FROM events WHERE event_id % 16 >= 8)"""
)
def journal_touched_dirs(spark, sf_dir):
    """M10's first step, T-S4's input."""
    e = m.table(spark, sf_dir, "events")
    records = e.select(F.col("event_id").alias("frn"), (F.col("user_id") % 40).alias("parent_frn"), F.when(F.col("event_id") % 16 >= 8, 0x10).otherwise(0x20).alias("attributes"))
    return merge.touched(records)


@query("SELECT user_id AS frn, max(event_id) AS usn, arg_max(event_type, event_id) AS name FROM events GROUP BY 1")
def last_record_per_frn(spark, sf_dir):
    """M12's repeats, T-S4."""
    e = m.table(spark, sf_dir, "events").select(F.col("user_id").alias("frn"), F.col("event_id").alias("usn"), F.lit(0).alias("parent_frn"), F.col("event_type").alias("name"), F.col("event_id").alias("attributes"))
    return tree.frn_tree(e).select("frn", F.col("attributes").alias("usn"), "name")


@query("SELECT event_id AS id FROM (SELECT event_id, lag(event_id) OVER (ORDER BY event_id) AS prev FROM events WHERE event_id % 31 <> 4) WHERE prev IS NOT NULL AND event_id <> prev + 1")
def audit_gap_check(spark, sf_dir):
    """W3, M17's missing ids: by a self-join on the previous id, so no task holds the whole log."""
    e = m.table(spark, sf_dir, "events").where("event_id % 31 <> 4").select(F.col("event_id").alias("id"))
    before = e.select((F.col("id") + 1).alias("id"))
    return e.join(before, "id", "left_anti").where(F.col("id") > e.agg(F.min("id")).first()[0])


NAMES_SQL = """
named AS (
  SELECT p_partkey AS id, p_size % 10 AS dir_id, CAST(round(p_retailprice * 100) AS BIGINT) AS size_bytes, p_partkey % 1000 AS mtime_ns,
         'doc' || (p_partkey % 40) || 'x' || CASE p_partkey % 5 WHEN 0 THEN '_v' || (p_partkey % 7) WHEN 1 THEN ' final' WHEN 2 THEN ' (' || (p_partkey % 3) || ')' ELSE '' END || '.txt' AS name
  FROM part),
split AS (
  SELECT *, 'doc' || (id % 40) || 'x' AS stem, id % 5 < 3 AS marked, CASE WHEN id % 5 = 0 THEN id % 7 END AS number FROM named),
vset AS (
  SELECT dir_id, stem, count(*) AS members, min(size_bytes) AS lo, max(size_bytes) AS hi,
         CASE WHEN count(DISTINCT number) = count(*) THEN arg_max(id, number) END AS by_number
  FROM split GROUP BY 1, 2 HAVING count(*) > 1 AND bool_or(marked)),
newest AS (SELECT dir_id, stem, id FROM (SELECT *, row_number() OVER (PARTITION BY dir_id, stem ORDER BY mtime_ns DESC, size_bytes DESC, id) AS k FROM split) WHERE k = 1)"""


def _named(spark, sf_dir):
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    mark = F.when(k % 5 == 0, F.concat(F.lit("_v"), s(k % 7))).when(k % 5 == 1, " final").when(k % 5 == 2, F.concat(F.lit(" ("), s(k % 3), F.lit(")"))).otherwise("")
    return m.table(spark, sf_dir, "part").select(
        k.alias("id"), (F.col("p_size") % 10).alias("dir_id"), F.round(F.col("p_retailprice") * 100).cast("long").alias("size_bytes"), (k % 1000).alias("mtime_ns"),
        F.concat(F.lit("doc"), s(k % 40), F.lit("x"), mark, F.lit(".txt")).alias("name"), F.lit("ok").alias("read_state"), F.lit(None).cast("string").alias("content_id"), F.lit(None).cast("string").alias("vanished_at"),
    )


@query(
    """SELECT v.dir_id, v.stem || '.txt' AS label, v.members, CAST(round((0.6 + 0.4 * lo / hi) * 1000) AS INTEGER) AS confidence_milli, coalesce(by_number, n.id) AS preferred
       FROM vset v JOIN newest n USING (dir_id, stem)""",
    NAMES_SQL,
)
def version_sets(spark, sf_dir):
    """C9, W7, W8, T13, T14."""
    rows = curate.version_sets(curate.version_members(_named(spark, sf_dir)))
    return rows.select("dir_id", "label", "members", F.round(F.col("confidence") * 1000).cast("int").alias("confidence_milli"), "preferred")


INFER_SQL = """
own AS (SELECT ancestor AS id, ext, modified, size_bytes FROM closure JOIN tfile f ON f.dir_id = descendant WHERE NOT f.vanished),
types AS (SELECT id, ext, count(*) AS n, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, ext) AS k FROM own GROUP BY 1, 2),
tops AS (SELECT id, sum(n) AS files, sum(n) FILTER (k <= 2) AS top_two FROM types GROUP BY 1),
byt AS (SELECT id, sum(size_bytes) AS bytes FROM own GROUP BY 1),
months AS (SELECT id, year(modified) * 12 + month(modified) - 1 AS month, count(*) AS n FROM own GROUP BY 1, 2),
cum AS (SELECT *, sum(n) OVER (PARTITION BY id ORDER BY month) AS seen, sum(n) OVER (PARTITION BY id) AS total FROM months),
span AS (SELECT id, min(month) FILTER (seen >= 0.9 * total) - min(month) FILTER (seen >= 0.1 * total) AS span FROM cum GROUP BY 1),
shaped AS (SELECT *, trim(regexp_replace(lower(name), '[0-9]+', '#', 'g')) AS shape FROM dirs WHERE NOT vanished),
alike AS (SELECT *, count(*) OVER (PARTITION BY parent_id, shape) AS alike FROM shaped),
sig AS (
  SELECT a.id, a.parent_id, CAST(files AS BIGINT) AS files, CAST(bytes AS BIGINT) AS bytes, top_two / files AS homogeneity,
         CASE WHEN span <= 3 THEN 1.0 ELSE greatest(0.0, 1 - (span - 3) / 33) END AS time,
         CASE WHEN contains(shape, '#') AND alike >= 3 THEN 1.0 ELSE 0.0 END AS series,
         CASE WHEN bytes BETWEEN 65536 AND 1099511627776 THEN 1.0 ELSE 0.75 END AS size
  FROM alike a JOIN tops t ON t.id = a.id JOIN byt b ON b.id = a.id JOIN span s ON s.id = a.id WHERE parent_id IS NOT NULL AND files >= 5)"""


def _signals(spark, sf_dir):
    dirs = m.tree_dirs(spark, sf_dir)
    closure = tree.closure(dirs)
    return curate.folder_signals(dirs, m.tree_files(spark, sf_dir), closure), closure


@query(
    """SELECT id, files, bytes, CAST(round(round_even(homogeneity, 3) * 1000) AS INTEGER) AS homogeneity_milli, CAST(round(round_even(time, 3) * 1000) AS INTEGER) AS time_milli, CAST(series * 2 AS INTEGER) AS series2 FROM sig""",
    m.TREE_SQL, INFER_SQL, recursive=True,
)
def infer_signals(spark, sf_dir):
    """A18, C1's signals, W4, W6."""
    rows = _signals(spark, sf_dir)[0]
    milli = lambda c: F.round(F.col(c) * 1000).cast("int").alias(f"{c}_milli")
    return rows.select("id", "files", "bytes", milli("homogeneity"), milli("time"), (F.col("series") * 2).cast("int").alias("series2"))


@query("SELECT id, CAST(span AS INTEGER) AS span FROM span", m.TREE_SQL, INFER_SQL, recursive=True)
def percentile_months(spark, sf_dir):
    """W4."""
    dirs, files = m.tree_dirs(spark, sf_dir), m.tree_files(spark, sf_dir).where("vanished_at IS NULL")
    months = files.groupBy("dir_id", curate.month_index(F.col("modified")).alias("month")).agg(F.count("*").alias("n"))
    c = tree.closure(dirs)
    months = c.join(months, c["descendant"] == months["dir_id"]).groupBy(F.col("ancestor").alias("dir_id"), "month").agg(F.sum("n").alias("n"))
    return curate.month_span(months).select(F.col("dir_id").alias("id"), F.col("span").cast("int").alias("span"))


@query(
    """, sc AS (SELECT id, parent_id, round(size * (0.4 * round_even(homogeneity, 3) + 0.35 * round_even(time, 3) + 0.25 * series), 4) AS score FROM sig),
       best AS (SELECT ancestor AS id, max(score) AS inner_best FROM closure c JOIN sc ON sc.id = descendant WHERE distance > 0 GROUP BY 1),
       good AS (SELECT sc.* FROM sc LEFT JOIN best USING (id) WHERE score >= 0.6 AND score >= coalesce(inner_best, 0) - 0.05
                AND id NOT IN (SELECT descendant FROM closure WHERE ancestor = 1004))
       SELECT id FROM good WHERE id NOT IN (SELECT descendant FROM closure WHERE distance > 0 AND ancestor IN (SELECT id FROM good))""",
    m.TREE_SQL, INFER_SQL, recursive=True,
)
def infer_collections(spark, sf_dir):
    """C1."""
    signals, closure = _signals(spark, sf_dir)
    return curate.infer_collections(signals, closure, spark.createDataFrame([(1004,)], "dir_id long")).select("id")


@query(
    """, chosen AS (SELECT id FROM sig WHERE files >= 200),
       f AS (SELECT ancestor AS top, t.* FROM closure JOIN tfile t ON t.dir_id = descendant WHERE NOT t.vanished AND ancestor IN (SELECT id FROM chosen)),
       big AS (SELECT top, string_agg(name, ',' ORDER BY k) AS samples FROM (SELECT top, name, row_number() OVER (PARTITION BY top ORDER BY size_bytes DESC, id) AS k FROM f) WHERE k <= 5 GROUP BY 1),
       ty AS (SELECT top, string_agg(ext || ':' || n, ',' ORDER BY k) AS types FROM (SELECT top, ext, count(*) AS n, row_number() OVER (PARTITION BY top ORDER BY count(*) DESC, ext) AS k FROM f GROUP BY 1, 2) WHERE k <= 5 GROUP BY 1),
       sp AS (SELECT top, strftime(min(modified), '%Y-%m') AS first_month, strftime(max(modified), '%Y-%m') AS last_month FROM f GROUP BY 1)
       SELECT top AS id, samples, types, first_month, last_month FROM big JOIN ty USING (top) JOIN sp USING (top)""",
    m.TREE_SQL, INFER_SQL, recursive=True,
)
def collection_evidence(spark, sf_dir):
    """C2, O5."""
    signals, closure = _signals(spark, sf_dir)
    rows = curate.collection_evidence(signals.where("files >= 200"), m.tree_files(spark, sf_dir), closure)
    types = F.array_join(F.transform("types", lambda t: F.concat(t["ext"], F.lit(":"), t["n"].cast("string"))), ",")
    return rows.select("id", F.array_join("samples", ",").alias("samples"), types.alias("types"), "first_month", "last_month")


ITEM_SQL = """
items AS (
  SELECT coalesce(content_id, 'f' || id) AS item, max(size_bytes) AS size_bytes, count(DISTINCT drive_id) AS drives, bool_or(drive_id IS NULL) AS on_unverified, bool_or(content_id IS NOT NULL) AS hashed
  FROM live WHERE content_id IS NOT NULL OR id IN (SELECT id FROM single) GROUP BY 1),
members AS (SELECT DISTINCT coalesce(content_id, 'f' || id) AS item, ext AS collection FROM live WHERE ext IN ('de', 'en') AND (content_id IS NOT NULL OR id IN (SELECT id FROM single)))"""


def _items(spark, sf_dir):
    files, volumes = m.files(spark, sf_dir), m.volumes(spark, sf_dir)
    rows = redundancy.placed(files, volumes)
    single = redundancy.single_copies(files, volumes).select("id")
    rows = rows.where("content_id IS NOT NULL").unionByName(rows.join(single, "id", "left_semi"))
    rows = rows.withColumn("item", F.coalesce("content_id", F.concat(F.lit("f"), F.col("id").cast("string"))))
    items = rows.groupBy("item").agg(F.max("size_bytes").alias("size_bytes"), F.count_distinct("drive_id").alias("drives"), F.max(F.col("drive_id").isNull()).alias("on_unverified"), F.max(F.col("content_id").isNotNull()).alias("hashed"))
    members = rows.where("ext IN ('de', 'en')").select("item", F.col("ext").alias("collection")).distinct()
    return rows, items, members


@query(
    """, i AS (SELECT *, 0.015 * greatest(1, 4 - drives) AS p, greatest(drives, 1) < 2 AS under FROM items),
       b AS (SELECT 'total' AS bucket, * FROM i UNION ALL SELECT CASE WHEN item IN (SELECT item FROM members) THEN 'filed' ELSE 'unfiled' END, * FROM i
             UNION ALL SELECT 'collection ' || collection, i.* FROM i JOIN members USING (item))
       SELECT bucket, count(*) AS items, CAST(sum(size_bytes) AS BIGINT) AS bytes, CAST(round(sum(size_bytes * p)) AS BIGINT) AS expected,
              count(*) FILTER (under) AS under_items, CAST(coalesce(sum(size_bytes) FILTER (under), 0) AS BIGINT) AS under_bytes FROM b GROUP BY 1""",
    m.FILE_SQL, ITEM_SQL,
)
def coverage_buckets(spark, sf_dir):
    """A17, C8, D9, J14, T19."""
    _, items, members = _items(spark, sf_dir)
    # A decimal, as in SQL: sums of doubles miss halves, and their last digits hang on the order of the rows.
    items = items.withColumn("p_loss", F.lit(Decimal("0.015")) * F.greatest(F.lit(1), F.lit(4) - F.col("drives")))
    rows = curate.coverage_buckets(items.select("item", "size_bytes", "drives", "p_loss"), members)
    return rows.withColumn("expected", F.round("expected").cast("long"))


EVIDENCE_SQL = """
dfacts AS (SELECT r.id, coalesce(r.batch, 'drive ' || r.id) AS b, r.disaster_zone AS z, d.purchase_date IS NOT NULL AS dated FROM risks r JOIN drives d ON d.id = r.id),
per AS (SELECT coalesce(content_id, 'f' || l.id) AS item, count(DISTINCT f.id) AS copies, count(DISTINCT z) AS zones, count(DISTINCT b) AS batches
        FROM live l JOIN dfacts f ON f.id = l.drive_id + 1 GROUP BY 1),
ev AS (
  SELECT m.collection, count(*) AS n, count(*) FILTER (on_unverified AND copies IS NULL) AS unidentified, count(*) FILTER (copies >= 2) AS two_copies,
         count(*) FILTER (copies >= 3 AND zones >= 2) AS three_copies, count(*) FILTER (zones >= 2) AS two_zones, count(*) FILTER (zones >= 3) AS three_zones,
         count(*) FILTER (batches >= 2) AS two_batches, count(*) FILTER (hashed) AS hashed, count(*) FILTER (hashed AND size_bytes % 2 = 0) AS verified
  FROM members m JOIN items i USING (item) LEFT JOIN per USING (item) GROUP BY 1),
hold AS (SELECT collection, count(*) AS holding_drives, count(*) FILTER (dated) AS dated_drives FROM (
  SELECT DISTINCT m.collection, f.id, f.dated FROM members m JOIN live l ON coalesce(l.content_id, 'f' || l.id) = m.item JOIN dfacts f ON f.id = l.drive_id + 1) GROUP BY 1),
e AS (SELECT ev.*, coalesce(holding_drives, 0) AS holding_drives, coalesce(dated_drives, 0) AS dated_drives, verified > 0 AS ever, CASE WHEN collection = 'de' THEN 2 ELSE 0 END AS missing FROM ev LEFT JOIN hold USING (collection))"""

def _share(k: str, n: str = "n") -> str:
    return f"CASE WHEN {n} = 0 THEN 'fail' WHEN {k} = {n} THEN 'pass' WHEN {k} >= 1 THEN 'partial' ELSE 'fail' END"


META = "CASE WHEN missing = 0 THEN 'pass' WHEN missing <= 3 THEN 'partial' ELSE 'fail' END"
FAIR_RULES = {
    "F1": "'pass'", "F2": META, "F3": "'planned'", "F4": "'partial'", "A1": _share("(n - unidentified)"), "A1.1": "'judgement'", "A1.2": "'judgement'", "A2": "'pass'",
    "I1": "'planned'", "I2": "'planned'", "I3": "CASE WHEN collection = 'en' THEN 'pass' ELSE 'fail' END", "R1": META, "R1.1": "CASE WHEN collection = 'en' THEN 'pass' ELSE 'fail' END",
    "R1.2": "CASE WHEN n > 0 AND hashed = n AND verified = n THEN 'pass' WHEN ever OR hashed > 0 THEN 'partial' ELSE 'fail' END", "R1.3": "'planned'",
}
LEVEL_RULES = {
    "storage-1a": _share("two_copies"), "storage-1b": _share("(n - unidentified)"), "storage-2a": _share("three_copies"), "storage-3a": _share("two_zones"),
    "storage-3b": _share("dated_drives", "holding_drives"), "storage-4a": _share("three_zones"), "storage-4b": _share("two_batches"),
    "integrity-1b": _share("hashed"), "integrity-2b": "'pass'", "integrity-2c": "'pass'", "integrity-3a": _share("verified"), "integrity-3b": "CASE WHEN ever THEN 'pass' ELSE 'fail' END",
    "integrity-3c": "CASE WHEN hashed > 0 THEN 'pass' ELSE 'fail' END", "control-1a": "'judgement'", "metadata-1a": "'pass'", "metadata-1b": "'pass'", "metadata-2a": META,
    "metadata-3b": "CASE WHEN missing = 0 THEN 'pass' ELSE 'fail' END", "metadata-4a": "'pass'", "content-1a": "'planned'",
}


def _long_sql(rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT collection, '{k}' AS criterion, {v} AS result FROM e" for k, v in rules.items())


def _evidence(spark, sf_dir):
    rows, items, members = _items(spark, sf_dir)
    dr = m.drives(spark, sf_dir)
    facts = dr.withColumn("batch", risk.batch_key(dr)).select("id", "batch", "disaster_zone", "purchase_date")
    held = rows.where("drive_id IS NOT NULL").select("item", (F.col("drive_id") + 1).alias("drive_id")).distinct()
    checked = items.withColumn("verified", F.col("hashed") & (F.col("size_bytes") % 2 == 0)).withColumn("ever_verified", F.col("verified"))
    e = scorecard.evidence(members.join(checked, "item"), held, facts)
    en = F.col("collection") == "en"
    return e.withColumn("has_pid", F.lit(True)).withColumn("missing", F.when(F.col("collection") == "de", 2).otherwise(0)).withColumn("has_license", en).withColumn("relations", F.when(en, 1).otherwise(0))


@query(_long_sql(FAIR_RULES), m.FILE_SQL, m.DRIVE_SQL, d.HEALTH_SQL, d.RISK_SQL, ITEM_SQL, EVIDENCE_SQL)
def scorecard_fair(spark, sf_dir):
    """C10, A23, C6, J12, J15, T20."""
    return scorecard.fair_card(_evidence(spark, sf_dir))


@query(
    f""", c AS ({_long_sql(FAIR_RULES)}) SELECT collection, CAST(round(avg(CASE result WHEN 'pass' THEN 1.0 WHEN 'partial' THEN 0.5 WHEN 'fail' THEN 0.0 END) * 1e6) AS BIGINT) AS score_ppm FROM c GROUP BY 1""",
    m.FILE_SQL, m.DRIVE_SQL, d.HEALTH_SQL, d.RISK_SQL, ITEM_SQL, EVIDENCE_SQL,
)
def fair_score(spark, sf_dir):
    """C10's score, D11."""
    return scorecard.fair_score(scorecard.fair_card(_evidence(spark, sf_dir))).select("collection", F.round(F.col("score") * 1e6).cast("long").alias("score_ppm"))


@query(
    f""", c AS ({_long_sql(LEVEL_RULES)}),
       l AS (SELECT collection, split_part(criterion, '-', 1) AS area, CAST(substr(split_part(criterion, '-', 2), 1, 1) AS INTEGER) AS lv, result FROM c)
       SELECT collection, area, CASE WHEN count(*) FILTER (result IN ('pass', 'partial', 'fail')) > 0 THEN coalesce(min(lv) FILTER (result IN ('partial', 'fail')) - 1, 4) END AS level FROM l GROUP BY 1, 2""",
    m.FILE_SQL, m.DRIVE_SQL, d.HEALTH_SQL, d.RISK_SQL, ITEM_SQL, EVIDENCE_SQL,
)
def scorecard_ndsa(spark, sf_dir):
    """C11, T21."""
    return scorecard.ndsa_levels(scorecard.ndsa_card(_evidence(spark, sf_dir)))


@query(
    """, f AS (SELECT id, 'a/' || lower(ext) || '/' || (size_bytes % 50) || '.txt' AS new FROM live)
       SELECT id, CASE WHEN k = 1 THEN new ELSE regexp_replace(new, '\\.txt$', ' (' || k || ').txt') END AS new
       FROM (SELECT *, row_number() OVER (PARTITION BY new ORDER BY id) AS k FROM f)""",
    m.FILE_SQL,
)
def name_mapping(spark, sf_dir):
    """C13, W9, F15, T12."""
    rows = m.files(spark, sf_dir).where("vanished_at IS NULL").select("id", F.col("id").alias("seq"), F.concat(F.lit("a/"), curate.safe_name(F.lower("ext")), F.lit("/"), (F.col("size_bytes") % 50).cast("string"), F.lit(".txt")).alias("new"))
    return curate.name_mapping(rows).select("id", "new")


UNIT_SQL = """
urow AS (
  SELECT 'u' || (l_partkey % 50) AS unit, l_partkey AS item, max(round(p_retailprice * 100))::BIGINT AS size_bytes,
         coalesce(list_sort(list(DISTINCT CASE WHEN l_suppkey % 8 + 1 < 8 THEN l_suppkey % 8 + 1 END) FILTER (l_suppkey % 8 + 1 < 8)), []) AS ds
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
onu AS (SELECT unit, d, count(*) AS k FROM (SELECT unit, unnest(ds) AS d FROM urow) GROUP BY 1, 2),
us AS (SELECT unit, count(*) AS items, CAST(sum(size_bytes) AS BIGINT) AS bytes, greatest(min(len(ds)), 1) AS copies,
       CAST(sum(((size_bytes + 4095) // 4096) * 4096) AS BIGINT) AS footprint_4096 FROM urow GROUP BY 1)"""


def _unit_rows(spark, sf_dir):
    rows = m.fleet_files(spark, sf_dir).groupBy("content_id").agg(F.max("size_bytes").alias("size_bytes"), F.array_sort(F.collect_set("drive_id")).alias("drive_ids"))
    return rows.select(F.concat(F.lit("u"), (F.col("content_id") % 50).cast("string")).alias("unit"), F.col("content_id").alias("item"), "size_bytes", "drive_ids")


@query(
    """SELECT us.unit, items, bytes, copies, footprint_4096, coalesce((SELECT string_agg(d, ',' ORDER BY d) FROM onu WHERE onu.unit = us.unit AND k = items), '') AS holders FROM us""",
    UNIT_SQL,
)
def units_measures(spark, sf_dir):
    """A21, A22, P2, U4."""
    rows = planner.unit_measures(_unit_rows(spark, sf_dir))
    return rows.select("unit", "items", "bytes", "copies", "footprint_4096", F.array_join(F.transform("holders", lambda x: x.cast("string")), ",").alias("holders"))


@query(
    """, direct AS (SELECT dir_id AS id, sum(size_bytes) AS b FROM tfile WHERE NOT vanished GROUP BY 1),
       owner AS (SELECT descendant AS id, arg_min(ancestor, distance) AS o FROM closure WHERE ancestor IN (1003, 1010) GROUP BY 1),
       free AS (SELECT d.id, d.parent_id, coalesce(b, 0) AS b FROM dirs d LEFT JOIN direct USING (id) WHERE d.id NOT IN (SELECT id FROM owner)),
       th AS (SELECT greatest(CAST(sum(b) AS BIGINT) // 40, 1048576) AS t FROM free),
       bl AS (SELECT ancestor AS id, sum(f.b) AS below FROM closure JOIN free f ON f.id = descendant WHERE ancestor IN (SELECT id FROM free) GROUP BY 1),
       sm AS (SELECT bl.id, below, below <= t OR bl.id NOT IN (SELECT parent_id FROM dirs WHERE parent_id IS NOT NULL) AS small FROM bl, th),
       tp AS (SELECT descendant AS id, arg_max(ancestor, distance) AS top FROM closure JOIN sm ON sm.id = ancestor WHERE small GROUP BY 1)
       SELECT id AS dir_id, 'c' || o AS unit FROM owner
       UNION ALL SELECT sm.id, CASE WHEN top IS NOT NULL THEN 'f' || top ELSE 'l' || sm.id END FROM sm LEFT JOIN tp ON tp.id = sm.id WHERE below > 0""",
    m.TREE_SQL, recursive=True,
)
def placement_units(spark, sf_dir):
    """P1."""
    dirs = m.tree_dirs(spark, sf_dir)
    direct = tree.direct_totals(m.tree_files(spark, sf_dir)).select("dir_id", "bytes")
    filed = spark.createDataFrame([(1003,), (1010,)], "dir_id long")
    return planner.cut_units(dirs.select("id", "parent_id"), direct, tree.closure(dirs), filed, target_units=40)


@query(
    """SELECT sum(CASE WHEN size_bytes > 0 THEN ((size_bytes + 4095) // 4096) * 4096 ELSE 0 END)::BIGINT AS small,
              sum(CASE WHEN size_bytes > 0 THEN ((size_bytes + 131071) // 131072) * 131072 ELSE 0 END)::BIGINT AS large FROM live""",
    m.FILE_SQL,
)
def footprint(spark, sf_dir):
    """A22."""
    rows = m.files(spark, sf_dir).where("vanished_at IS NULL")
    size = F.col("size_bytes")
    return rows.agg(F.sum(planner.footprint(size, 4096)).alias("small"), F.sum(planner.footprint(size, 131_072)).alias("large"))


@query(
    """, v AS (SELECT range AS id, CASE WHEN range < 18 THEN range // 2 END AS drive_id, (range % 4 + 1) * 1000000000000 AS cap, (range * 7 % 5) * 200000000000 AS fr FROM range(20)),
       b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY drive_id ORDER BY fr DESC, id) AS k FROM v WHERE drive_id IS NOT NULL) WHERE k = 1)
       SELECT d.id, b.id AS volume_id, CASE WHEN role = 'working' THEN 'working drive' WHEN b.id IS NULL THEN 'no volume' ELSE '' END AS excluded,
              CASE WHEN b.id IS NOT NULL THEN greatest(fr - greatest(cap // 10, 1073741824), 0) END AS room FROM drives d LEFT JOIN b ON b.drive_id = d.id""",
    m.DRIVE_SQL,
)
def destinations(spark, sf_dir):
    """P3, W2."""
    dr = m.drives(spark, sf_dir).withColumn("retired_at", F.lit(None).cast("string"))
    v = m.volumes(spark, sf_dir).withColumn("capacity_bytes", F.col("capacity_bytes") * 10_000).withColumn("free_bytes", F.col("free_bytes") * 10_000)
    return planner.destinations(dr, v).select("id", "volume_id", "excluded", F.when(F.col("volume_id").isNotNull(), F.col("room")).alias("room"))


@query(
    """, x AS (SELECT drive_id, content_id, (count(DISTINCT volume_id || ':' || coalesce(CAST(frn AS VARCHAR), 'f' || id)) - 1) * max(size_bytes) AS e
               FROM live WHERE content_id IS NOT NULL AND drive_id IS NOT NULL GROUP BY 1, 2)
       SELECT drive_id, CAST(sum(e) AS BIGINT) AS extra_bytes FROM x GROUP BY 1 HAVING sum(e) > 0""",
    m.FILE_SQL,
)
def same_drive_extra(spark, sf_dir):
    """A20, P6's extras."""
    rows = redundancy.placed(m.files(spark, sf_dir), m.volumes(spark, sf_dir))
    physical = F.concat_ws(":", F.col("volume_id").cast("string"), F.coalesce(F.col("frn").cast("string"), F.concat(F.lit("f"), F.col("id").cast("string"))))
    return planner.same_drive_extra(rows.withColumn("physical", physical))


def _plan(spark, sf_dir):
    rows = planner.unit_measures(_unit_rows(spark, sf_dir)).collect()  # one row a unit
    units = [planner.Unit(r.unit, r.bytes, frozenset(r.holders), frozenset({frozenset(r.holders)}), 3, 0.015, {4096: r.footprint_4096, 131_072: r.footprint_131072}) for r in sorted(rows, key=lambda r: r.unit)]
    total = sum(u.bytes for u in units)
    drives = [planner.Destination(k, total // 3, 4096 if k % 2 else 131_072, f"b{k % 3}", f"z{k % 2}", k == 5) for k in range(1, 8)]
    return units, drives, planner.greedy(units, drives, lambda held: 0.015 ** len(held) * (1 + sum(held) / 1000))


@query()
def greedy_plan(spark, sf_dir):
    """P4, J18."""
    _, _, plan = _plan(spark, sf_dir)
    return spark.createDataFrame([(c.unit, c.drive_id, c.footprint, ",".join(c.crowds)) for c in plan.copies], "unit string, drive_id long, footprint long, crowds string")


@query()
def plan_rounds(spark, sf_dir):
    """P6's rounds, W10, D8, T24."""
    units, _, plan = _plan(spark, sf_dir)
    source = {u.key: min(u.holders, default=None) for u in units}
    numbers = planner.rounds((source[c.unit], c.drive_id) for c in plan.copies)
    steps = [(c.unit, source[c.unit], c.drive_id, c.footprint, n) for c, n in zip(plan.copies, numbers)]
    return spark.createDataFrame(steps, "unit string, source long, destination long, bytes long, round int")


@query("SELECT id, n FROM (SELECT id, count(*) OVER (PARTITION BY size_bytes) AS n FROM live) WHERE n > 1", m.FILE_SQL)
def size_sharing(spark, sf_dir):
    """W1."""
    rows = m.files(spark, sf_dir).where("vanished_at IS NULL")
    # Counted first, so that a size which very many files have is one row until the join.
    sizes = rows.groupBy("size_bytes").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(checkpointed(sizes), "size_bytes").select("id", "n")
