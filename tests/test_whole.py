"""The catalog from the first scan to an export, over a tree on disk."""

import json
import os
import random

import pytest

from stackroom.__main__ import parser, run
from stackroom.catalog import Catalog, CatalogError
from stackroom.schema import TABLES


def write(path, body):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(body)


def test_from_scan_to_export(spark, tmp_path):
    rng = random.Random(4)
    for drive in ("one", "two"):
        for k in range(6):
            write(tmp_path / drive / "2021-03 Survey" / f"station_{k:02}.csv", rng.randbytes(2000 + k) if drive == "one" else (tmp_path / "one" / "2021-03 Survey" / f"station_{k:02}.csv").read_bytes())
    write(tmp_path / "one" / "misc" / "only.txt", b"x" * 77)
    write(tmp_path / "one" / "misc" / "draft_v1.txt", b"a" * 900)
    write(tmp_path / "one" / "misc" / "draft_v2.txt", b"b" * 950)
    write(tmp_path / "one" / "skip" / "a.tmp", b"t")
    c = Catalog(spark, f"file://{tmp_path}/catalog")
    drives = [c.add_drive(serial=f"S{k}", model="M", media="hdd", purchase_date="2022-01", disaster_zone=z) for k, z in enumerate(("home", "office"))]
    vols = [c.add_volume(drive_id=d, capacity_bytes=10**12, free_bytes=5 * 10**11, cluster_bytes=4096) for d in drives]
    roots = [c.add_root(v, str(tmp_path / n), ["skip/*"]) for v, n in zip(vols, ("one", "two"))]
    with pytest.raises(CatalogError):
        c.add_root(vols[0], str(tmp_path / "one" / "misc"))
    assert c.preview(roots[0]).first().files == 9
    assert c.scan(roots[0]) == {"staged": 9, "inserted": 9, "updated": 0, "vanished": 0}
    assert c.scan(roots[1])["inserted"] == 6
    assert c.hash() == 12
    s = c.summary().first()
    assert (s.identified, s.duplicate_groups, s.single_copy_files, s.under_protected, s.unhashed_files) == (6, 6, 3, 3, 0)
    assert {r.name for r in c.find("surv stat").collect()} == set() and c.find("stati").count() == 12 and c.find("%ONLY%").count() == 1

    before = os.stat(tmp_path / "two" / "2021-03 Survey" / "station_00.csv").st_mtime_ns
    write(tmp_path / "two" / "2021-03 Survey" / "station_00.csv", b"z" * 2000)
    os.utime(tmp_path / "two" / "2021-03 Survey" / "station_00.csv", ns=(before, before))
    assert c.verify() == {"ok": 11, "mismatch": 1}
    assert [r.name for r in c.incidents().collect()] == ["station_00.csv"]

    os.remove(tmp_path / "one" / "misc" / "only.txt")
    os.rename(tmp_path / "two" / "2021-03 Survey", tmp_path / "two" / "moved")
    assert c.scan(roots[0])["vanished"] == 1
    again = c.scan(roots[1])
    assert (again["inserted"], again["vanished"]) == (6, 6)
    assert c.scan(roots[1]) == {"staged": 6, "inserted": 0, "updated": 6, "vanished": 0}

    queue = c.propose().collect()
    assert queue
    i = c.accept(queue[0].dir_id, "Survey", license="CC0")
    with pytest.raises(CatalogError):
        c.create_collection("again", [queue[0].dir_id])
    assert c.members(i).count() == 6
    assert {r.bucket for r in c.coverage(today="2026-10-30").collect()} >= {"total", "filed", f"collection {i}"}
    assert [r.label for r in c.find_versions().collect()] == ["draft.txt"]
    fair, levels = c.score("2026-10-30")
    assert fair.count() == 15 and levels.count() == 5
    plan = c.plan(2, "2026-10-30")
    assert c.plan(2, "2026-10-30") == plan + 1
    assert {r.status for r in c.table("plan").collect()} == {"draft", "superseded"}
    (tmp_path / "out").mkdir()
    path = c.export(str(tmp_path / "out"))
    assert json.load(open(f"{path}/_EXPORT.json"))["files"]
    assert c.audit_problems().count() == 0
    c.backup(f"file://{tmp_path}/copy")
    assert Catalog(spark, f"file://{tmp_path}/copy").status().first() == c.status().first()
    os.rename(tmp_path / "two", tmp_path / "away")
    with pytest.raises(CatalogError):
        c.scan(roots[1])
    assert c.table("scan").where("status = 'failed'").count() == 1
    c.import_rates('{"source": "fleet", "version": "1", "basis": "fleet", "classes": {"hdd": 0.02}, "models": []}')
    assert {r.base_afr for r in c.drive_risks().collect()} == {0.02} and len(c.rates) == 2
    c.forget_rates("fleet-1")
    assert {r.base_afr for r in c.drive_risks().collect()} == {0.015}
    c.edit_collection(i, description="lake", license="CC-BY")
    got = c.collections("2026-10-30").first()
    assert (got.files, got.filled) == (6, 3) and 0 < got.score <= 1
    assert c.versions().count() == 2 and c.recent("scan", 3).count() == 3
    assert c.split(c.table("dir").where(f"parent_id IS NULL AND volume_id = {vols[0]}").first().id).count() >= 1
    mounts = spark.createDataFrame([("/", c.table("volume").first().volume_guid)], "mount string, volume_guid string")
    assert sorted(r.bound for r in c.bound_roots(mounts).collect()) == [False, True]
    assert len(c.analyze()) == len(TABLES)
    shown = run(c, parser().parse_args([c.root, "report", "duplicates"]))
    assert shown.columns[0] == "content_id"
    run(c, parser().parse_args([c.root, "drive-edit", "1", "nickname=Shelf", "price_cents=9900"]))
    assert c.drive_names().where("id = 1").first().name == "Shelf"
