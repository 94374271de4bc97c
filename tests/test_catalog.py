"""Every registered query against its SQL, and the small fixtures that no table holds."""

import datetime
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from stackroom.operators import curate, merge, redundancy, risk, scorecard, tree
from stackroom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.schema.fields
        return
    rel = duck.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in rel.fetchall())
    assert got == want


def fleet(spark):
    """Drives 1 and 2, volumes 1 and 2 on them, volume 9 unverified."""
    volumes = spark.createDataFrame([(1, 1), (2, 2), (9, None)], "id long, drive_id long")
    rows = [
        (1, 1, 10, "a", 100, "x", None, "ok", None), (2, 1, 10, "b", 100, "x", None, "ok", None), (3, 2, 20, "c", 100, "x", None, "ok", None),
        (4, 9, 30, "d", 70, "y", "5", "ok", None), (5, 9, 30, "e", 70, "y", "5", "ok", None), (6, 1, 10, "f", 7, None, None, "ok", None),
        (7, 1, 10, "g", 8, None, None, "ok", None), (8, 2, 20, "h", 8, None, None, "unreadable", None), (9, 1, 10, "i", 0, None, None, "ok", None),
        (10, 2, 20, "j", 0, None, None, "ok", None), (11, 2, 20, "k", 100, "x", None, "ok", "gone"),
    ]
    files = spark.createDataFrame(rows, "id long, volume_id long, dir_id long, name string, size_bytes long, content_id string, frn string, read_state string, vanished_at string")
    return files, volumes


def test_copies_count_drives_not_paths(spark):
    files, volumes = fleet(spark)
    groups = {r.content_id: r for r in redundancy.content_groups(files, volumes).collect()}
    assert (groups["x"].paths, groups["x"].drives, groups["x"].drives_possible, groups["x"].physical_copies, groups["x"].reclaimable_bytes) == (3, 2, 2, 3, 100)
    assert (groups["y"].paths, groups["y"].drives, groups["y"].drives_possible, groups["y"].physical_copies, groups["y"].reclaimable_bytes) == (2, 1, 1, 1, 0)
    assert [r.id for r in redundancy.single_copies(files, volumes).collect()] == [6]
    assert sorted(r.id for r in redundancy.unhashed(files).collect()) == [7, 8, 9, 10]
    assert redundancy.hash_candidates(files).collect() == []


def test_closure_depth_and_cycles(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "id long, parent_id long")
    assert tree.closure(chain).count() == 40 * 41 // 2
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, parent_id long")
    with pytest.raises(ValueError):
        tree.closure(ring, max_depth=8)


def test_set_risk_rules(spark):
    facts = spark.createDataFrame([(1, 0.02, "measured", "b", "home"), (2, 0.03, "estimated", "b", "home"), (3, 0.05, "measured", None, None), (4, 0.04, "measured", None, None)], "id long, afr double, confidence string, batch string, disaster_zone string")
    sets = spark.createDataFrame([([1],), ([1, 2],), ([3, 4],), ([1, 3],), ([],)], "drive_ids array<long>").withColumn("bytes", F.lit(10)).withColumn("items", F.lit(1))
    got = {tuple(r.drive_ids): (round(r.correlation, 9), round(r.p_loss, 12), r.confidence) for r in risk.set_risk(sets, facts, 0.015).collect()}
    assert got == {(1,): (1, 0.02, "measured"), (1, 2): (50, min(0.02 * 0.03 * 50, 0.02), "estimated"), (3, 4): (10, 0.02, "measured"), (1, 3): (1, 0.001, "measured"), (): (1, 0.015, "unknown")}


def test_merge_is_idempotent_and_keeps_what_it_must(spark):
    files, _ = fleet(spark)
    old = files.select("id", "volume_id", "dir_id", "name", "size_bytes", F.lit(5).cast("long").alias("mtime_ns"), "content_id", "read_state", F.lit("txt").alias("ext"), F.lit(1).cast("long").alias("first_seen_scan"), F.lit(1).cast("long").alias("last_seen_scan"), "vanished_at")
    staged = spark.createDataFrame([(10, "a", 100, 5, "ok"), (10, "b", 100, 6, "ok"), (10, "new", 1, 1, "ok"), (20, "k", 100, None, "ok")], "dir_id long, name string, size_bytes long, mtime_ns long, read_state string")
    once = merge.merge_files(old, staged, 2)
    rows = {(r.dir_id, r.name): r for r in once.collect()}
    assert rows[10, "a"].content_id == "x" and rows[10, "b"].content_id is None
    assert rows[20, "k"].vanished_at is None and rows[20, "k"].content_id is None and rows[20, "k"].first_seen_scan == 1
    assert rows[10, "new"].change == "inserted" and rows[10, "new"].first_seen_scan == 2
    again = merge.merge_files(once.drop("change"), staged, 2).drop("change")
    assert sorted(map(str, again.collect())) == sorted(map(str, once.drop("change").collect()))
    gone = merge.tombstone(once.drop("change"), 2, "t", spark.createDataFrame([(10,)], "dir_id long"))
    assert {r.name for r in gone.where("vanished_at = 't'").collect()} == {"f", "g", "i"}


def brute_strip(stem):
    """Strip whichever marker shortens the name without emptying it, until none does."""
    stem = stem.lower()
    shorter = [s for s in (re.sub(m, "", stem, count=1) for m in curate.MARKERS) if s and s != stem]
    return brute_strip(shorter[0]) if shorter else stem.strip()


def test_version_names_strip_to_a_fixpoint(spark):
    rng = random.Random(3)
    bits = ["thesis", "cover", "old", " ", "_", "-", "v2", "r12", "final", "(1)", "(22)", "2021-03-04", "rev", "3", "x", ".", "threshold", "copy", "version 7"]
    names = sorted({"".join(rng.choice(bits) for _ in range(rng.randint(1, 5))) for _ in range(3000)})
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", F.trim(curate.strip_markers(F.lower("n"))).alias("s"))
    assert {r.n: r.s for r in df.collect()} == {n: brute_strip(n) for n in names}


def test_version_sets_of_drafts(spark):
    rows = [("thesis_v1.docx", 20000, 1), ("thesis_v2.docx", 21000, 2), ("thesis_v3.docx", 21500, 3), ("aims.docx", 9000, 5), ("aims final.docx", 9400, 6), ("aims (1).docx", 30000, 7), ("p1.jpg", 5, 1), ("p2.jpg", 6, 1)]
    files = spark.createDataFrame([(i, 1, n, s, t, None, "ok", None) for i, (n, s, t) in enumerate(rows)], "id long, dir_id long, name string, size_bytes long, mtime_ns long, content_id string, read_state string, vanished_at string")
    sets = {r.label: r for r in curate.version_sets(curate.version_members(files)).collect()}
    assert set(sets) == {"thesis.docx", "aims.docx"}
    assert (sets["thesis.docx"].members, sets["thesis.docx"].preferred) == (3, 2) and sets["thesis.docx"].confidence > 0.9
    assert (sets["aims.docx"].members, sets["aims.docx"].preferred) == (3, 5) and sets["aims.docx"].confidence < 0.8


def test_scorecards_golden(spark):
    """One collection: a hashed file on two drives of two zones, and a file never hashed."""
    items = spark.createDataFrame([("p", "x", True, False, False, False), ("p", "f", False, False, False, False)], "collection string, item string, hashed boolean, verified boolean, ever_verified boolean, on_unverified boolean")
    held = spark.createDataFrame([("x", 1), ("x", 2), ("f", 1)], "item string, drive_id long")
    drives = spark.createDataFrame([(1, None, "home", "2022-01"), (2, None, "office", "2022-01")], "id long, batch string, disaster_zone string, purchase_date string")
    e = scorecard.evidence(items, held, drives).withColumn("has_pid", F.lit(True)).withColumn("missing", F.lit(6)).withColumn("has_license", F.lit(False)).withColumn("relations", F.lit(0))
    card = scorecard.fair_card(e)
    got = {r.criterion: r.result for r in card.collect()}
    assert got == {"F1": "pass", "F2": "fail", "F3": "planned", "F4": "partial", "A1": "pass", "A1.1": "judgement", "A1.2": "judgement", "A2": "pass", "I1": "planned", "I2": "planned", "I3": "fail", "R1": "fail", "R1.1": "fail", "R1.2": "partial", "R1.3": "planned"}
    assert abs(scorecard.fair_score(card).first().score - 4 / 9) < 1e-12
    levels = {r.area: r.level for r in scorecard.ndsa_levels(scorecard.ndsa_card(e)).collect()}
    assert levels == {"storage": 0, "integrity": 0, "control": None, "metadata": 1, "content": None}


def test_collections_queue(spark):
    queue = spark.createDataFrame([(1, 0.7, "rejected"), (2, 0.7, "open")], "dir_id long, score double, status string")
    new = spark.createDataFrame([Row(id=1, score=0.9), Row(id=2, score=0.9), Row(id=3, score=0.8)])
    got = {r.dir_id: (r.score, r.status) for r in curate.propose(queue, new).collect()}
    assert got == {1: (0.7, "rejected"), 2: (0.9, "open"), 3: (0.8, "open")}
    assert curate.accept_all(curate.propose(queue, new), 0.85).where("status = 'accepted'").count() == 1


def test_mapping_is_one_to_one(spark):
    rows = [(1, "a/x.txt"), (2, "a/X.txt"), (3, "a/x (2).txt"), (4, "b/x.txt"), (5, "a/x.txt")]
    got = {r.seq: r.new for r in curate.name_mapping(spark.createDataFrame(rows, "seq long, new string")).collect()}
    assert got == {1: "a/x.txt", 2: "a/X (2).txt", 3: "a/x (2) (2).txt", 4: "b/x.txt", 5: "a/x (3).txt"}


def test_any_number_of_version_marks_goes(spark):
    names = ["report" + " draft v2" * 9, "report" + "_final(1)" * 20, "report", "(1)(2)", None]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(curate.strip_markers(F.lower("n")).alias("s"))
    assert [r.s for r in df.collect()] == ["report", "report", "report", "(1)", None]
