"""Exports' guards, plans, deltas over whole directories, commits, search and discovery."""

import json
import os
import random
import struct
from collections import Counter

import pytest

from stackroom.catalog import Catalog, CatalogError
from stackroom.operators import browse, curate, merge, planner
from stackroom.sinks import bundle, exports
from stackroom.sources import discovery, listing
from stackroom.streaming import journal

GIB = 1 << 30


def test_links_are_never_followed(tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "elsewhere").mkdir()
    b = bundle.Bundle(str(tmp_path / "out"), "t")
    os.symlink(tmp_path / "elsewhere", b.path / "sub")
    os.symlink(tmp_path / "elsewhere" / "f.txt", b.path / "f.txt")
    for name in ("sub/x.txt", "sub/deep/x.txt"):
        with pytest.raises(bundle.ExportError):
            b.write(name, "x")
    with pytest.raises(OSError):
        b.write("f.txt", "x")
    assert os.listdir(tmp_path / "elsewhere") == []
    b.discard()
    assert os.listdir(tmp_path / "out") == []


def test_a_bundle_is_a_new_folder_or_nothing(tmp_path):
    first, second = (bundle.Bundle(str(tmp_path), "t") for _ in range(2))
    first.write("a/b.txt", "one")
    for bad in ("/etc/passwd", "../x", "a/../../b", "C:/x", "a\\..\\b", "", "./a", "a//b", bundle.LISTING):
        with pytest.raises(bundle.ExportError):
            first.write(bad, "x")
    first.close()
    second.close()
    assert first.path != second.path and (first.path / "a/b.txt").read_text() == "one"
    with pytest.raises(bundle.ExportError):
        first.write("late.txt", "x")
    with pytest.raises(RuntimeError):
        with bundle.bundle(str(tmp_path), "t") as third:
            third.write("x", "y")
            raise RuntimeError
    assert not third.path.exists()
    for root, kind in ((tmp_path, "../x"), (tmp_path / "missing", "t")):
        with pytest.raises(bundle.ExportError):
            bundle.Bundle(str(root), kind)


def test_only_copies_pass_as_previews():
    good = 'REM round 1\r\nrobocopy "A\\x" "B\\x" /E /COPY:DAT /DCOPY:DAT /R:1 /W:1 /XJ\r\n'
    exports.copy_only("a.cmd", good.encode())
    exports.copy_only("a.sh", b"# note\nrsync -a --protect-args --exclude=*/ '/a/' '/b/'\n")
    for bad in ('robocopy "A" "B" /MIR', 'robocopy "A" "B" & del x', "rsync -a --delete '/a/' '/b/'", "rsync -a '/a/' '/b/' > c", "rm -r x", "rsync -a '/a/' '/b/'; rm x", 'rsync -a "$(rm x)/" "b/"'):
        for name in ("a.sh", "a.cmd"):
            with pytest.raises(bundle.ExportError):
                exports.copy_only(name, bad.encode())


def test_package_lists_its_members(spark, tmp_path):
    members = spark.createDataFrame([("/A/p 1", 300, "blake2b-256:01", [1, 2]), ("/A/q", 77, None, [1])], "path string, bytes long, hash string, drives array<long>")
    with bundle.bundle(str(tmp_path), "collections") as b:
        exports.write_package(b, {"title": "Lake", "local_pid": "sr-1", "creators": ["A. Smith", "B. Jones"], "license": "CC-BY-4.0"}, members, [{"relation": "IsVersionOf", "target": "10.1234/abc"}], 2026)
    data = b.path / "Lake/data"
    graph = {e["@id"]: e for e in json.loads((data / "ro-crate-metadata.json").read_text())["@graph"]}
    parts = [graph[p["@id"]] for p in graph["./"]["hasPart"]]
    assert sorted(int(p["contentSize"]) for p in parts) == [77, 300] and all(p["@id"].startswith("file:///") for p in parts)
    assert [graph[c["@id"]]["name"] for c in graph["./"]["creator"]] == ["A. Smith", "B. Jones"]
    cite = json.loads((data / "datacite.json").read_text())
    assert all(cite[k] for k in ("identifiers", "creators", "titles", "publisher", "publicationYear", "types"))
    assert cite["relatedIdentifiers"] == [{"relatedIdentifier": "10.1234/abc", "relationType": "IsVersionOf", "relatedIdentifierType": "DOI"}]


def toy_risk(drives):
    by_id = {d.drive_id: d for d in drives}

    def p_of(held):
        p = 0.02 ** max(1, len(held))
        for what in ("batch", "zone"):
            for n in Counter(v for h in held if h in by_id and (v := getattr(by_id[h], what))).values():
                p *= 2 ** (n - 1)
        return min(p, 0.02)

    return p_of


def unit(key, size, held=(), target=2):
    held = frozenset(held)
    return planner.Unit(key, size, held, frozenset({held}), target, 0.02 ** max(1, len(held)), {c: -(-size // c) * c for c in (4096, 131_072)})


@pytest.mark.parametrize("seed", range(30))
def test_plans_keep_their_rules(seed):
    rng = random.Random(seed)
    drives = [planner.Destination(k, rng.choice([0, 5, 20, 80]) * GIB, rng.choice([4096, 131_072]), rng.choice(["", "b1", "b2"]), rng.choice(["", "home", "office"]), rng.random() < 1 / 6) for k in range(1, rng.randint(2, 7))]
    ids, p_of = [d.drive_id for d in drives], toy_risk(drives)
    units = [unit(f"u{n}", rng.randint(1, 30) * GIB + rng.randint(0, 9999), rng.sample(ids, rng.randint(0, min(2, len(ids)))), rng.choice([2, 2, 3])) for n in range(rng.randint(1, 12))]
    plan = planner.greedy(units, drives, p_of)
    by_id, spent = {d.drive_id: d for d in drives}, Counter()
    for c in plan.copies:
        spent[c.drive_id] += c.footprint
    assert all(spent[d.drive_id] <= d.room and not (d.excluded and spent[d.drive_id]) for d in drives)
    for u in units:
        after = plan.holders[u.key]
        assert u.holders <= after and len(after) + (not u.holders) + plan.short.get(u.key, 0) >= u.target
        assert (p_of(after) if after != u.holders else u.p_loss) <= u.p_loss + 1e-15
        for c in (c for c in plan.copies if c.unit == u.key):
            want = ()
            for what in ("batch", "zone"):
                v = getattr(by_id[c.drive_id], what)
                if v and sum(getattr(by_id[h], what) == v for h in after if h in by_id) > max(1, u.target - 1):
                    want += (what, v)
            assert c.crowds == want
    assert sum(planner.risk_deltas(units, plan, p_of)) <= 1e-9


def test_plan_cases():
    d = lambda k, room=100 * GIB, **more: planner.Destination(k, room, **more)
    one = lambda drives, u: planner.greedy([u], drives, toy_risk(drives))
    assert one([d(1, batch="b1"), d(2, batch="b1"), d(3, batch="b2")], unit("u", GIB, [1])).holders["u"] == {1, 3}
    same = one([d(1, batch="b1"), d(2, batch="b1")], unit("u", GIB, [1]))
    assert same.holders["u"] == {1, 2} and same.copies[0].crowds == ("batch", "b1")
    small = unit("u", 10 * 4096, [1])
    assert one([d(1), d(2, 100 * 1024, cluster=131_072)], small).short == {"u": 1}
    assert one([d(1), d(2, 131_072, cluster=131_072)], small).holders["u"] == {1, 2}
    assert len(one([d(1), d(2)], unit("u", GIB)).holders["u"]) == 1  # the unproven copy is one
    risky, safe = unit("risky", 8 * GIB, [1]), unit("safe", 8 * GIB, [1])
    risky.p_loss, safe.p_loss = 0.05, 0.01
    drives = [d(1), d(2, 10 * GIB)]
    plan = planner.greedy([safe, risky], drives, toy_risk(drives))
    assert plan.holders["risky"] == {1, 2} and plan.short == {"safe": 1}
    assert one([d(1), d(2), d(3)], unit("u", GIB, [1, 2])).copies == []
    assert [planner.target_copies(n) for n in (None, 1, 2, 4)] == [2, 2, 3, 3]


DIRS = "id long, parent_id long, frn long, name string, last_seen_scan long, vanished_at string"
FILES = "id long, dir_id long, name string, size_bytes long, mtime_ns long, content_id string, read_state string, first_seen_scan long, last_seen_scan long, vanished_at string"
RECORDS = "frn long, parent_frn long, usn long, attributes long, name string, reason long"


def test_delta_takes_in_subtrees_and_drops_what_is_gone(spark, tmp_path):
    tables = merge.Snapshots(spark, f"file://{tmp_path}/catalog")
    dirs = [(1, None, 11, "root"), (2, 1, 12, "docs"), (3, 2, 13, "old"), (4, 3, 14, "deep"), (5, 1, 15, "other"), (9, 1, 19, "more"), (10, 1, 20, "rest"), (11, 1, 21, "last")]
    tables.write("dir", spark.createDataFrame([(*d, 1, None) for d in dirs], DIRS))
    tables.write("file", spark.createDataFrame([(k, d, f"f{k}", 1, 1, f"c{k}", "ok", 1, 1, None) for k, d in enumerate((2, 3, 4, 5), 1)], FILES))
    # Now: docs holds a new folder with one below it, and old is gone with all it held.
    kids = {1: [(2, 12, "docs"), (5, 15, "other"), (9, 19, "more"), (10, 20, "rest"), (11, 21, "last")], 2: [(6, 16, "new")], 6: [(7, 17, "below")], 7: [], 5: []}
    held = {2: ["f1"], 6: ["g"], 7: ["h"], 5: ["f4"]}

    def relist(some):
        ids = [r.id for r in some.select("id").collect()]
        files = [(100 + d, d, n, 1, 1, "ok") for d in ids for n in held.get(d, [])]
        return journal.Listing(
            spark.createDataFrame(files, "id long, dir_id long, name string, size_bytes long, mtime_ns long, read_state string"),
            spark.createDataFrame([(i, d, f, n) for d in ids for i, f, n in kids[d]], "id long, parent_id long, frn long, name string"),
        )

    records = spark.createDataFrame([(16, 12, 100, 16, "new", 0), (13, 12, 101, 0, "old", 0), (5, 99, 102, 0, "x", 0)], RECORDS)
    counters = {}
    assert journal.apply_delta(tables, records, relist, 2, "t", counters) == "delta"
    assert (counters["unknown_parents"], counters["new_subtrees"], counters["vanished_dirs"]) == (2, 1, 1)
    alive = {r.id: r.last_seen_scan for r in tables.read("dir").where("vanished_at IS NULL").collect()}
    assert alive == {1: 1, 2: 2, 5: 1, 6: 2, 7: 2, 9: 1, 10: 1, 11: 1}
    assert {(r.dir_id, r.name) for r in tables.read("file").where("vanished_at IS NULL").collect()} == {(2, "f1"), (6, "g"), (7, "h"), (5, "f4")}
    before = {tuple(r) for r in tables.read("file").collect()}
    assert journal.apply_delta(tables, records, relist, 2, "t") == "delta"
    assert {tuple(r) for r in tables.read("file").collect()} == before
    many = spark.createDataFrame([(k, k, k, 0, "x", 0) for k in range(11, 18)], RECORDS)
    assert journal.apply_delta(tables, many, relist, 3, "t") == "full"


def test_commits(spark, tmp_path):
    one, two = (merge.Snapshots(spark, f"file://{tmp_path}/c") for _ in range(2))
    row = lambda k: spark.createDataFrame([(k,)], "id long")
    one.write_all({"a": row(1), "b": row(1)})
    one.read("a"), two.read("a")
    two.append("a", row(2))
    one.append("a", row(3))
    assert sorted(r.id for r in two.read("a").collect()) == [1, 2, 3]
    two.write("a", row(4))
    with pytest.raises(merge.ConcurrentWrite):
        one.write_all({"a": row(5), "b": row(5)})
    assert [r.id for r in one.read("a").collect()] == [4] and [r.id for r in one.read("b").collect()] == [1]
    last = sorted((tmp_path / "c/_log").glob("*.json"))[-1]
    (last.parent / f"{int(last.name[:12]) + 1:012d}.json").write_text('{"a": [')  # a writer that died
    two.PATIENCE = one.PATIENCE = 0.2
    assert [r.id for r in two.read("a").collect()] == [4]
    two.append("a", row(6))
    assert one.read("a").count() == 2


def test_marks_and_versions(spark):
    files = spark.createDataFrame([(k, n, None, 1) for k, n in enumerate(("Škoda őr.txt", "S\u030ckoda.txt", "skoda_2.txt", "ko.txt"))], "id long, name string, vanished_at string, dir_id long")
    dirs = spark.createDataFrame([(1, "x", None)], "id long, name string, vanished_at string")
    found = lambda q: [r.id for r in browse.search(files, dirs, q).collect()]
    assert found("skoda") == found("ŠKODA") == [0, 1, 2] and found("or") == [0] and found("koda") == []


def test_disks_and_volumes(spark, tmp_path):
    for name, files in {"sda": {"size": "2000", "queue/rotational": "1", "device/serial": " S1 ", "device/model": "M"}, "nvme0n1": {"size": "8", "queue/rotational": "0", "removable": "0"}, "loop0": {"size": "9"}, "sdb": {"size": "0"}}.items():
        for f, text in files.items():
            path = tmp_path / name / f
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text + "\n")
    assert [tuple(r) for r in discovery.disk_table(spark, str(tmp_path)).collect()] == [("/dev/nvme0n1", None, None, "ssd", 4096), ("/dev/sda", "S1", "M", "hdd", 1_024_000)]
    mounts = [("/", "d", "k", "sys", 1, 1, 1), ("/mnt/x", "d", "k", "ext", 1, 1, 1)]
    assert [discovery.volume_guid_of(p, mounts) for p in ("/mnt/x/a", "/mnt/xy", "/")] == ["ext", "sys", "sys"]


def test_exports_stay_off_catalogued_drives(spark, tmp_path, monkeypatch):
    (tmp_path / "in" / "inner").mkdir(parents=True)
    (tmp_path / "in" / "a b.txt").write_text("x")
    (tmp_path / "out").mkdir()
    c = Catalog(spark, f"file://{tmp_path}/cat")
    for k in (1, 2):
        c.add_drive(serial=f"S{k}", media="hdd")
        c.add_volume(drive_id=k, volume_guid=f"V{k}", capacity_bytes=1 << 40, free_bytes=1 << 39, cluster_bytes=4096)
    root = c.add_root(1, str(tmp_path / "in"))
    c.scan(root)
    with pytest.raises(CatalogError):
        c.export(str(tmp_path / "in" / "inner"))
    assert os.listdir(tmp_path / "in" / "inner") == []
    monkeypatch.setattr(discovery, "volume_guid_of", lambda path: "V1")
    monkeypatch.setattr(discovery, "system_volume_guid", lambda: "SYS")
    with pytest.raises(CatalogError):
        c.export(str(tmp_path / "out"))
    monkeypatch.setattr(discovery, "system_volume_guid", lambda: "V1")
    i = c.create_collection("Lake", [c.table("dir").where("parent_id IS NULL").first().id], ndsa_target=2)
    number = c.plan(2, "2026-10-30")
    kinds = [r.kind for r in c.table("plan_step").where(f"plan_id = {number}").orderBy("id").collect()]
    assert kinds == ["copy", "describe", "acquire"]
    summary = json.loads(c.table("plan").first().summary)
    assert summary["units_at_target_before"] == 0 and summary["short_copies"] == 1 and {p["statement"]: p["after"] for p in summary["projection"]}["storage-1a"] == "pass"
    assert [tuple(r) for r in c.mapping(i).collect()][0][1].startswith("Lake/")
    path = c.export(str(tmp_path / "out"), ("manifests", "collections", "mappings", "reports", "previews"), "2026-10-30")
    names = {f["path"] for f in json.load(open(f"{path}/_EXPORT.json"))["files"]}
    assert {"copy-commands.sh", "copy-commands.cmd", "report.html", "Lake/data/ro-crate-metadata.json"} <= names
    assert any(n.startswith("mappings/Lake-1/inverse/") for n in names) and any(n.startswith("csv/durability/") for n in names)
    listed = [json.loads(line) for n in names if n.startswith("files/kind=drive/ident=1/") for line in open(f"{path}/{n}")]
    assert [r["path"].rpartition("/")[2] for r in listed] == ["a b.txt"]


def record(frn, parent, name, usn):
    raw = name.encode("utf-16-le")
    length = -(-(60 + len(raw)) // 8) * 8
    body = struct.pack("<IHHQQqqIIIIHH", length, 2, 0, frn, parent, usn, 116_444_736_000_000_000, 1, 0, 0, 0x20, len(raw), 60)
    return (body + raw).ljust(length, b"\0")


def test_journal_batches_end_within_a_page_and_lose_nothing(spark, tmp_path):
    (tmp_path / "100.bin").write_bytes(struct.pack("<q", 160) + b"".join(record(u, 11, "a", u) for u in range(100, 160, 10)))
    (tmp_path / "160.bin").write_bytes(struct.pack("<q", 200))
    (tmp_path / "200.bin").write_bytes(struct.pack("<q", 230) + b"".join(record(u, 11, "a", u) for u in (200, 210, 220)))
    for most in (1, 2, 4, 6, 9, 100):
        stream = journal._Stream({"path": str(tmp_path), "recordsPerBatch": str(most)})
        at, seen = stream.initialOffset(), []
        while True:
            rows, end = stream.read(at)
            got = [r[4] for r in rows]
            assert len(got) <= most and got == [r[4] for r in stream.readBetweenOffsets(at, end)]
            seen += got
            if end == at:
                break
            at = end
        assert seen == [*range(100, 160, 10), 200, 210, 220] and at["usn"] == 230
    with pytest.raises(ValueError):
        journal._Stream({"path": str(tmp_path), "recordsPerBatch": "0"})


def test_follow_all_reads_to_the_end_in_batches(spark, tmp_path):
    pages = tmp_path / "journal"
    pages.mkdir()
    (pages / "0.bin").write_bytes(struct.pack("<q", 70) + b"".join(record(90 + u, 11 + u // 10 % 3, f"f{u}", u) for u in range(0, 70, 10)))
    tables = merge.Snapshots(spark, f"file://{tmp_path}/catalog")
    tables.write("dir", spark.createDataFrame([(k, 10 + k, f"d{k}", None) for k in range(1, 20)], "id long, frn long, name string, vanished_at string"))
    cols = "id long, dir_id long, name string, size_bytes long, mtime_ns long, content_id string, read_state string, first_seen_scan long, last_seen_scan long, vanished_at string"
    tables.write("file", spark.createDataFrame([], cols))
    asked = []

    def relist(hit):
        ids = sorted(r.id for r in hit.select("id").collect())
        asked.append(ids)
        return spark.createDataFrame([(100 + i, i, f"n{i}", 1, 1, "ok") for i in ids], "id long, dir_id long, name string, size_bytes long, mtime_ns long, read_state string")

    run = lambda: journal.follow_all(spark, str(pages), tables, relist, f"{tmp_path}/ck", 0, 3, first_scan=2)
    assert run() == 3 and asked == [[1, 2, 3], [1, 2, 3], [1]]
    assert sorted((r.dir_id, r.name) for r in tables.read("file").where("vanished_at IS NULL").collect()) == [(1, "n1"), (2, "n2"), (3, "n3")]
    assert run() == 0 and len(asked) == 3


def test_one_top_folder_is_cut_into_many_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "SUBTREES", 8)
    for a in range(3):
        for b in range(4):
            for c in range(2):
                (tmp_path / "top" / f"a{a}" / f"b{b}" / f"c{c}").mkdir(parents=True)
                (tmp_path / "top" / f"a{a}" / f"b{b}" / f"c{c}" / "f.txt").write_text("x")
    (tmp_path / "top" / "a0" / "skip").mkdir()
    os.symlink(tmp_path, tmp_path / "top" / "loop")
    reader = listing._Reader({"path": str(tmp_path), "prune": "skip"})
    parts = reader.partitions()
    assert 8 <= len(parts) <= 24
    rows = sorted(r[:3] for p in parts for r in reader.read(p))
    assert rows == sorted(r[:3] for r in listing.walk(str(tmp_path), reader.prune)) and len(rows) == len(set(rows)) == 1 + 3 + 1 + 12 + 24 + 24
    gone = listing._Reader({"path": str(tmp_path / "none")})
    assert [bool(r[11]) for p in gone.partitions() for r in gone.read(p)] == [True]


def test_name_mapping_equals_one_pass_over_all_names(spark):
    rng, taken, want, rows = random.Random(5), set(), {}, []
    leaves = ["a.txt", "A.txt", "a (2).txt", "a (2) (2).txt", "a (3).TXT", "b", "b (2)", "B", ".x", ".x (2)", ".x.y", "a.b.c", "a.b (2).c", "...", "... (2)", "e.", "e (2).", "n\nl.t", "n\nl (2).t"]
    for seq in range(400):
        rows.append((seq, f"{rng.choice(['', 'd/', 'D/', 'd/e.f/'])}{rng.choice(leaves)}"))
    for seq, path in rows:
        folder, slash, leaf = path.rpartition("/")
        cut = leaf.rfind(".") if "." in leaf.lstrip(".") else len(leaf)
        name, n = path, 2
        while name.lower() in taken:
            name, n = f"{folder}{slash}{leaf[:cut]} ({n}){leaf[cut:]}", n + 1
        taken.add(name.lower())
        want[seq] = name
    got = {r.seq: r.new for r in curate.name_mapping(spark.createDataFrame(rows, "seq long, new string").repartition(5)).collect()}
    assert got == want
    many = curate.name_mapping(spark.range(20_000).selectExpr("id AS seq", "'d/x.jpg' AS new"))
    assert many.select("new").distinct().count() == 20_000
