"""Sources, identity over real files, the audit chain, exports and the journal stream."""

import json
import os
import random
import struct
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stackroom.functions import hashing, predicates
from stackroom.catalog import checked_drive_fields
from stackroom.operators import audit, browse, identity, merge, planner, risk, tree
from stackroom.sinks import bundle, exports
from stackroom.sources import binary, discovery, layout, listing, readings
from stackroom.streaming import journal


def ask(spark, *rows, schema, **columns):
    df = spark.createDataFrame(list(rows), schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_exclusions_by_name_path_and_prefix(spark):
    skip = predicates.exclusion(["*.bak", "raw/old*", "[ab]?.log"], r"C:\Users\me\AppData\Local\Temp\keep", windows=True)
    rows = [("x.TMP", "x", r"D:\x"), ("a1.log", "a1.log", "D:\\"), ("c1.log", "c1.log", "D:\\"), ("y", r"RAW\older\y", "D:\\"), ("z", "z", r"C:\Windows\z"), ("z", "z", r"C:\WindowsBackups"), ("t", "t", r"C:\Users\me\AppData\Local\Temp\keep\t"), ("~$a.doc", "q", "/")]
    got = ask(spark, *rows, schema="n string, r string, a string", x=skip(F.col("n"), F.col("r"), F.col("a")))
    assert [x for (x,) in got] == [True, True, False, True, True, False, False, True]
    assert predicates.nests(["/a/b"], "/a") == "/a/b" and predicates.nests(["/a/b"], "/a/bc") is None


def test_links_placeholders_and_times(spark):
    rows = [(0x400, 0, True), (0x400, 0xA000000C, False), (0x400, 0x9000001A, False), (0x400 | 0x400000, None, False), (0x400, None, False), (0x20, None, False)]
    got = ask(spark, *rows, schema="a long, t long, d boolean", x=predicates.skip_as_link(F.col("a"), F.col("t"), F.col("d")), s=predicates.read_state(F.lit(False), F.col("a")))
    assert [x for x, _ in got] == [True, True, False, False, True, False]
    assert got[3][1] == "skipped-dehydrated"
    assert ask(spark, (predicates.FILETIME_EPOCH + 5,), (7,), schema="f long", x=predicates.filetime_ns(F.col("f"))) == [(500,), (0,)]


def record(version, frn, parent, name, usn, reason=1, attributes=0x20):
    raw = name.encode("utf-16-le")
    header = 60 if version == 2 else 76
    width = 8 if version == 2 else 16
    length = -(-(header + len(raw)) // 8) * 8
    body = struct.pack("<IHH", length, version, 0) + frn.to_bytes(width, "little") + parent.to_bytes(width, "little")
    body += struct.pack("<qqIIIIHH", usn, predicates.FILETIME_EPOCH + 10, reason, 0, 0, attributes, len(raw), header)
    return (body + raw).ljust(length, b"\0")


def test_journal_buffers(spark):
    good = struct.pack("<q", 99) + record(2, 5, 1, "a.txt", 40) + record(3, 2**70, 5, "Résumé", 50, attributes=0x10)
    rows = [tuple(r) for r in binary.parse_journal(spark.createDataFrame([(bytearray(good),)], "content binary")).collect()]
    assert [(int(r[0]), int(r[1]), r[2], r[4], r[5]) for r in rows] == [(5, 1, "a.txt", 40, 1000), (2**70, 5, "Résumé", 50, 1000)]
    for bad in (good[:-4], good.replace(struct.pack("<HH", 2, 0), struct.pack("<HH", 7, 0), 1)):
        with pytest.raises(ValueError):
            list(binary.journal_records(bad))


def test_directory_buffers(spark):
    def entry(name, step, with_id):
        raw = name.encode("utf-16-le")
        head = struct.pack("<IIqqqqqqIII", step, 0, 0, 0, predicates.FILETIME_EPOCH + 1, 0, 123, 4096, 0x20, len(raw), 0)
        return (head + (b"\0" * 28 + struct.pack("<q", 77) if with_id else b"") + raw).ljust(step or 0, b"\0")

    for with_id in (False, True):
        buffer = entry("one", 128, with_id) + entry("two", 0, with_id)
        rows = binary.parse_directory(spark.createDataFrame([(bytearray(buffer),)], "content binary"), with_id=with_id).collect()
        assert [(r.name, r.size, r.mtime_ns, r.file_id) for r in rows] == [("one", 123, 100, 77 if with_id else None), ("two", 123, 100, 77 if with_id else None)]
        with pytest.raises(ValueError):
            list(binary.directory_entries(buffer[:60], with_id))


def test_smart_json(spark):
    ata = {"smartctl": {"exit_status": 0}, "model_name": "M", "smart_status": {"passed": True}, "power_on_time": {"hours": 9}, "ata_smart_attributes": {"table": [{"id": 5, "value": 100, "raw": {"value": 3}}, {"id": 187, "value": 1, "raw": {"value": 4}}, {"id": 231, "value": 88, "raw": {"value": 0}}, {"id": 241, "value": 1, "raw": {"value": 10}}]}}
    nvme = {"smart_status": {"passed": True}, "nvme_smart_health_information_log": {"media_errors": 0, "percentage_used": 4, "data_units_written": 2, "power_on_hours": 7}}
    none = {"smartctl": {"exit_status": 2, "messages": [{"severity": "error", "string": "unknown USB bridge"}]}}
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate((ata, nvme, none))] + [(3, "oops")], "i int, json string")
    r = sorted(readings.smart_readings(df).collect())
    assert (r[0].available, r[0].reallocated, r[0].pending, r[0].uncorrectable, r[0].wear_leveling, r[0].bytes_written) == (True, 3, None, 4, 88, 5120)
    assert (r[1].wear_leveling, r[1].bytes_written, r[1].power_on_hours) == (96, 1_024_000, 7)
    assert (r[2].available, r[2].reason, r[2].reallocated) == (False, "unknown USB bridge", None)
    assert not r[3].available


def test_drive_stats_csv_and_zip(spark, tmp_path):
    text = "date,serial_number,model,capacity_bytes,failure\n" + "d,s, ST1 ,1,0\n" * 730 + "d,s,ST1,1,1\nd,s,ST1,1,1\nshort\n"
    (tmp_path / "a.csv").write_text(text)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("x/c.csv", "model,failure\nOther,1\n")
        z.writestr("__MACOSX/c.csv", "junk")
    rows = {r.model: r for r in risk.fleet_rates(readings.drive_stats(spark, str(tmp_path)), 1).collect()}
    assert (rows["ST1"].days, rows["ST1"].failures, rows["ST1"].afr) == (732, 2, round(2 / (732 / 365), 6))
    assert rows["Other"].failures == 1
    t = readings.rate_table('{"source": "s", "version": 2, "basis": "fleet", "models": [{"model": "WDC WD40EFRX", "afr": 0.02}]}')
    assert t.models == (("WD40EFRX", 0.02),)


@pytest.fixture
def tree_on_disk(tmp_path):
    root = tmp_path / "drive"
    (root / "docs" / "2024").mkdir(parents=True)
    (root / "media").mkdir()
    (root / "docs" / "a.txt").write_bytes(b"same" * 500)
    (root / "docs" / "2024" / "b.txt").write_bytes(b"same" * 500)
    (root / "media" / "c.bin").write_bytes(b"x" * 4096)
    (root / "media" / "d.bin").write_bytes(b"y" * 4096)
    (root / "media" / "empty").write_bytes(b"")
    big = random.Random(1).randbytes(300_000)
    for n, name in enumerate(("e", "f", "g")):
        body = bytearray(big)
        if n == 2:
            body[100_000] ^= 1  # differs where no sample looks
        (root / "media" / name).write_bytes(body)
    (root / "link").symlink_to(root / "docs")
    return root


def catalogued(spark, root):
    rows = listing.listing(spark, str(root)).where("NOT is_dir AND NOT stat_failed AND attributes & 1024 = 0")
    path = F.concat_ws("/", "dir", "name")
    return rows.select(
        F.xxhash64(path).alias("id"), F.lit(1).cast("long").alias("volume_id"), F.xxhash64("dir").alias("dir_id"), "name", path.alias("path"), F.col("size").alias("size_bytes"), "mtime_ns",
        F.lit(None).cast("string").alias("frn"), F.lit("ok").alias("read_state"), F.lit(None).cast("string").alias("content_id"), F.lit(None).cast("string").alias("vanished_at"), F.lit("1").alias("device"), F.lit("hdd").alias("media"),
    )


def test_listing_identity_and_verification(spark, tree_on_disk):
    files = catalogued(spark, tree_on_disk)
    assert sorted(r.name for r in files.collect()) == ["a.txt", "b.txt", "c.bin", "d.bin", "e", "empty", "f", "g"]
    hashed, contents = identity.hash_pass(files)
    ids = {r.name: r.content_id for r in hashed.collect()}
    assert ids["a.txt"] == ids["b.txt"] and ids["c.bin"] != ids["d.bin"] and ids["e"] == ids["f"] != ids["g"] and ids["empty"] is None
    known = {r.id: r for r in contents.collect()}
    assert known[ids["e"]].full_hash is not None and known[ids["a.txt"]].full_hash is None
    path = str(tree_on_disk / "docs" / "a.txt")
    assert bytes(known[ids["a.txt"]].quick_hash) == hashing.quick_hash(path, 2000)

    hashed = spark.createDataFrame(hashed.collect(), hashed.schema)
    contents = spark.createDataFrame(contents.collect(), contents.schema)
    before = os.stat(tree_on_disk / "media" / "e").st_mtime_ns
    with open(tree_on_disk / "media" / "e", "r+b") as f:
        f.seek(200_000)
        f.write(b"\0\1\2")
    os.utime(tree_on_disk / "media" / "e", ns=(before, before))
    (tree_on_disk / "media" / "c.bin").write_bytes(b"edited")
    os.utime(tree_on_disk / "media" / "c.bin", ns=(5, 5))
    os.remove(tree_on_disk / "media" / "d.bin")
    names = {r.id: r.name for r in hashed.collect()}
    got = {names[r.file_id]: r.result for r in identity.verify_pass(hashed, contents).collect()}
    assert got == {"a.txt": "ok", "b.txt": "ok", "c.bin": "modified", "d.bin": "unreadable", "e": "mismatch", "f": "ok", "g": "ok"}


def test_drives_are_merged_by_serial_then_layout(spark):
    columns = "id long, serial string, layout_id string, model string"
    old = spark.createDataFrame([(1, "S1", "L1", "old"), (2, None, "L2", None)], columns)
    seen = spark.createDataFrame([("S1", "L9", "new"), ("S2", "L2", "gained"), ("S3", "L1", "other")], "serial string, layout_id string, model string")
    got = {r.id: (r.serial, r.layout_id, r.model) for r in merge.upsert_drives(old, seen).collect()}
    assert got[1] == ("S1", "L1", "old") and got[2] == ("S2", "L2", "gained") and len(got) == 3


def test_disk_layouts_and_mounts(spark):
    gpt = bytes(512) + b"EFI PART" + bytes(48) + bytes(range(16)) + bytes(440)
    mbr = bytes(440) + b"\1\2\3\4" + bytes(66) + b"\x55\xaa"
    df = spark.createDataFrame([(bytearray(gpt),), (bytearray(mbr),), (bytearray(512),), (None,)], "head binary")
    assert [r.layout_id for r in layout.with_layout_id(df).collect()] == ["gpt:03020100-0504-0706-0809-0a0b0c0d0e0f", "mbr:04030201", None, None]
    assert discovery.mounted_volumes(spark).where("capacity_bytes > 0").count() >= 1


def test_audit_chain(spark):
    log = audit.append(spark, None, "me", [("scan", {"n": 1}), ("hash", {"é": "ü"})], "2026-01-01T00:00:00+00:00")
    log = log.union(audit.append(spark, log, "me", [("plan", {"sha256": "ab"})], "2026-01-02T00:00:00+00:00"))
    assert audit.problems(log).count() == 0 and audit.accepted(log, "plan", "ab").count() == 1
    assert [tuple(r) for r in audit.problems(log.where("id <> 2")).collect()] == [(3, "missing entry before")]
    edited = log.withColumn("action", F.when(F.col("id") == 2, "x").otherwise(F.col("action")))
    assert [tuple(r) for r in audit.problems(edited).collect()] == [(2, "changed entry")]


def test_exports(spark, tmp_path):
    files = spark.createDataFrame([(1, 1, "A/p", 300, "x", None, None), (2, 2, "B/p", 300, "x", None, None), (3, 9, "U/p", 300, "x", None, None), (4, 1, "A/u", 77, None, None, None), (5, 1, "A/d/v", 5, None, None, None)], "id long, volume_id long, path string, size_bytes long, content_id string, frn string, vanished_at string")
    volumes = spark.createDataFrame([(1, 1), (2, 2), (9, None)], "id long, drive_id long")
    contents = spark.createDataFrame([("x", bytearray(b"\1\2"), "blake2b-256")], "id string, full_hash binary, hash_algo string")
    m = exports.manifest_files(files, volumes, contents)
    totals = {(r.kind, r.ident): (r.files, r.bytes, r.only_here) for r in exports.manifest_totals(m).collect()}
    assert totals == {("drive", 1): (3, 382, 2), ("drive", 2): (1, 300, 0), ("volume", 9): (1, 300, 0)}
    with bundle.bundle(str(tmp_path), "all") as b:
        exports.write_manifests(b, m)
        exports.write_package(b, {"title": "Lake survey", "local_pid": "pid-1", "creators": ["N"]}, m.where("kind = 'drive'").select("path", "bytes", "hash", F.array("ident").alias("drives")))
        exports.write_reports(b, {"totals": exports.manifest_totals(m)})
        exports.write_previews(b, [{"src": "/A//x", "dst": "<B>/x", "note": "step 1"}])
        with pytest.raises(FileExistsError):
            b.write("copy-commands.sh", "# again\n")
        for bad in ("../x", "a//b", "/etc/x"):
            with pytest.raises(bundle.ExportError):
                b.write(bad, "# x")
        with pytest.raises(bundle.ExportError):
            b.write("evil.sh", 'rsync -a --delete "a/" "b/"\n')
    listed = json.loads((b.path / bundle.LISTING).read_text())["files"]
    assert "Lake_survey/manifest-sha256.txt" in {f["path"] for f in listed}
    assert len((b.path / "Lake_survey/data/members.csv").read_text().splitlines()) == 5
    assert "<td>382</td>" in (b.path / "report.html").read_text()


@pytest.mark.parametrize("seed", range(25))
def test_greedy_plan_invariants(seed):
    rng = random.Random(seed)
    gib = 1 << 30
    drives = [planner.Destination(k, rng.choice([0, 5, 20, 80]) * gib, rng.choice([4096, 131_072]), rng.choice(["", "b1", "b2"]), rng.choice(["", "home", "office"]), rng.random() < 1 / 6) for k in range(1, rng.randint(2, 7))]
    units = []
    for n in range(rng.randint(1, 12)):
        size, held = rng.randint(1, 30) * gib + rng.randint(0, 9999), frozenset(rng.sample([d.drive_id for d in drives], min(len(drives), rng.randint(0, 2))))
        units.append(planner.Unit(f"u{n}", size, held, frozenset({held}), rng.choice([2, 2, 3]), 0.01, {c: -(-size // c) * c for c in (4096, 131_072)}))
    plan = planner.greedy(units, drives, lambda h: 0.02 ** max(1, len(h)))
    by_key, by_id, spent = {u.key: u for u in units}, {d.drive_id: d for d in drives}, dict.fromkeys((d.drive_id for d in drives), 0)
    for c in plan.copies:
        assert not by_id[c.drive_id].excluded and c.drive_id not in by_key[c.unit].holders
        spent[c.drive_id] += c.footprint
    assert all(spent[d.drive_id] <= d.room and plan.room[d.drive_id] == d.room - spent[d.drive_id] for d in drives)
    for u in units:
        extra = {c.drive_id for c in plan.copies if c.unit == u.key}
        assert plan.holders[u.key] == u.holders | extra
        assert plan.short.get(u.key, 0) == max(0, u.target - u.copies(extra))
    p_of = lambda h: 0.02 ** max(1, len(h))
    better = planner.refine(units, drives, p_of, plan, tries=20)
    assert planner.objective(units, better, p_of) <= planner.objective(units, plan, p_of)


def test_rounds_keep_drives_apart():
    pairs = [(1, 2), (1, 3), (4, 5), (None, 2), (2, 4)]
    assert planner.rounds(pairs) == [1, 2, 1, 2, 3]


def test_snapshots_and_journal_stream_equal_a_full_scan(spark, tmp_path):
    tables = merge.Snapshots(spark, f"file://{tmp_path}/catalog")
    dirs = spark.createDataFrame([(1, 11, "root", None), (2, 12, "docs", None), (3, 13, "media", None), (4, 14, "other", None), (5, 15, "more", None)], "id long, frn long, name string, vanished_at string")
    cols = "id long, dir_id long, name string, size_bytes long, mtime_ns long, content_id string, read_state string, first_seen_scan long, last_seen_scan long, vanished_at string"
    old = spark.createDataFrame([(1, 2, "a", 10, 1, "c1", "ok", 1, 1, None), (2, 2, "b", 20, 1, "c2", "ok", 1, 1, None), (3, 3, "c", 30, 1, "c3", "ok", 1, 1, None)], cols)
    tables.write("dir", dirs)
    tables.write("file", old)
    now = pd.DataFrame([(21, 2, "a", 10, 1, "ok"), (22, 2, "n", 5, 2, "ok"), (23, 3, "c", 30, 1, "ok")], columns=["id", "dir_id", "name", "size_bytes", "mtime_ns", "read_state"])
    disk = spark.createDataFrame(now)
    pages = tmp_path / "journal"
    pages.mkdir()
    (pages / "100.bin").write_bytes(struct.pack("<q", 200) + record(2, 91, 12, "n", 100) + record(2, 92, 12, "b", 150, reason=0x200))
    relist = lambda hit: disk.join(hit.select(F.col("id").alias("dir_id")), "dir_id", "left_semi")
    q = journal.follow(journal.journal_stream(spark, str(pages), 100), tables, relist, f"{tmp_path}/ck", first_scan=2)
    q.awaitTermination(120)
    q.stop()
    after = {(r.dir_id, r.name): (r.size_bytes, r.content_id, r.vanished_at is None) for r in tables.read("file").collect()}
    full = merge.tombstone(merge.merge_files(old, disk, 2).drop("change"), 2, "t", dirs.select(F.col("id").alias("dir_id")))
    assert after == {(r.dir_id, r.name): (r.size_bytes, r.content_id, r.vanished_at is None) for r in full.collect()}
    assert after[2, "b"] == (20, "c2", False) and after[2, "n"] == (5, None, True)
    tables.purge("file")
    assert tables.read("file").count() == 4
    with pytest.raises(journal.JournalGap):
        journal._Stream({"path": str(pages), "startingUsn": "5"}).initialOffset()


def test_interned_directories(spark):
    d = merge.intern_dirs(spark.createDataFrame([(1, "a/b/c"), (1, "a//b"), (2, "a")], "volume_id long, path string"))
    rows = {(r.volume_id, r.name, r.depth): r for r in d.collect()}
    assert set(rows) == {(1, "", 0), (1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "", 0), (2, "a", 1)}
    assert rows[1, "c", 3].parent_id == rows[1, "b", 2].id and rows[1, "", 0].parent_id is None


def test_live_tree_follows_renames(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "0.bin").write_bytes(struct.pack("<q", 50) + record(2, 7, 1, "old", 10) + record(2, 8, 1, "other", 20))
    (pages / "50.bin").write_bytes(struct.pack("<q", 90) + record(2, 7, 2, "new", 60))
    seen = {}
    stream = journal.live_tree(journal.journal_stream(spark, str(pages)))
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.update({int(r.frn): (int(r.parent_frn), r.name, r.usn) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert seen == {7: (2, "new", 60), 8: (1, "other", 20)}


def test_root_restriction_keeps_none_apart_from_empty(spark):
    files = spark.createDataFrame([(1, 10), (2, 20)], "id long, dir_id long")
    dirs = spark.createDataFrame([(10, 1), (20, 2)], "id long, root_id long")
    assert [tree.in_roots(files, dirs, x).count() for x in (None, [], [1])] == [2, 0, 1]
    records = spark.createDataFrame([(1, 1, "r", 0, 1), (2, 1, "a", 0, 2), (3, 2, "b", 0, 3), (9, 8, "lost", 0, 4), (2, 1, "a2", 0, 5)], "frn long, parent_frn long, name string, attributes long, usn long")
    last = tree.frn_tree(records)
    assert last.where("frn = 2").first().name == "a2"
    assert [r.frn for r in tree.orphans(last, 1).collect()] == [9]


def test_drive_metadata_is_checked():
    assert checked_drive_fields({"purchase_date": "2021-03", "price_cents": "990", "nickname": ""}) == {"purchase_date": "2021-03", "price_cents": 990, "nickname": None}
    for bad in ({"colour": "red"}, {"purchase_date": "March"}, {"media": "cloud"}):
        with pytest.raises(ValueError):
            checked_drive_fields(bad)


def test_small_texts(spark):
    df = spark.createDataFrame([(0,), (1023,), (1536,), (5 * 1024**3,)], "n long")
    assert [r.t for r in df.select(browse.human_bytes(F.col("n")).alias("t")).collect()] == ["0 B", "1023 B", "1.5 KiB", "5.0 GiB"]


def test_journal_reads_raise_where_the_cursor_no_longer_holds(tmp_path):
    def page(first, following, *usns):
        (tmp_path / f"{first}.bin").write_bytes(struct.pack("<q", following) + b"".join(record(2, 7, 1, "x", u) for u in usns))

    stream = journal._Stream({"path": str(tmp_path)})
    usns = lambda found: [r[4] for r in found[0]]
    at = lambda usn, number=None: {"usn": usn, "journal": number}
    assert stream.initialOffset() == at(-1) and usns(stream.read(at(-1))) == [] and stream.read(at(-1))[1] == at(-1)
    page(100, 200, 100, 150)
    page(200, 300, 200, 250)
    assert usns(stream._from(at(-1))) == usns(stream._from(at(100))) == [100, 150, 200, 250] and stream.read(at(100))[1] == at(300)
    # Inside a page, records are chosen by their number; an offset of an older checkpoint has no id.
    assert usns(stream._from({"usn": 150})) == [150, 200, 250] and usns(stream._from(at(150), at(250))) == [150, 200]
    assert usns(stream._from(at(100), at(200))) == [100, 150] and usns(stream._from(at(300))) == []
    for cursor in (50, 301):  # purged, ahead
        with pytest.raises(journal.JournalGap):
            stream.read(at(cursor))
    page(300, 400, 300)
    os.remove(tmp_path / "200.bin")
    for cursor in (100, 200):  # pages that don't join, a first unread page beyond the cursor
        with pytest.raises(journal.JournalGap):
            stream.read(at(cursor))
    with pytest.raises(journal.JournalGap):
        list(stream.readBetweenOffsets(at(200), at(400)))
    assert usns(stream._from(at(300))) == [300]


def test_journal_state_tells_a_recreated_journal(tmp_path):
    (tmp_path / "100.bin").write_bytes(struct.pack("<q", 200) + record(2, 7, 1, "x", 100))
    save = lambda number, following, lowest: (tmp_path / journal.STATE).write_bytes(struct.pack("<Qqqqqqq", number, 0, following, lowest, 1 << 40, 0, 0))
    stream = journal._Stream({"path": str(tmp_path)})
    save(2**63 + 5, 200, 0)
    first = stream.initialOffset()
    rows, end = stream.read(first)
    assert first == {"usn": 100, "journal": 2**63 + 5} and len(list(rows)) == 1 and end == {"usn": 200, "journal": 2**63 + 5}
    for number, following, lowest in ((6, 200, 0), (2**63 + 5, 400, 300), (2**63 + 5, 150, 0)):
        save(number, following, lowest)
        with pytest.raises(journal.JournalGap):
            stream.read(end)
    os.remove(tmp_path / journal.STATE)
    with pytest.raises(journal.JournalGap):
        stream.read(end)


def test_journal_restart_from_a_checkpoint_sees_the_gap(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    seen = []

    def run():
        df = journal.journal_stream(spark, str(pages), 100)
        q = df.writeStream.foreachBatch(lambda b, n: seen.extend(r.usn for r in b.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    (pages / "100.bin").write_bytes(struct.pack("<q", 200) + record(2, 7, 1, "x", 100))
    run()
    (pages / "300.bin").write_bytes(struct.pack("<q", 400) + record(2, 7, 1, "y", 300))
    with pytest.raises(Exception, match="JournalGap"):
        run()
    (pages / "200.bin").write_bytes(struct.pack("<q", 300) + record(2, 7, 1, "z", 200))
    run()
    assert seen == [100, 200, 300]
