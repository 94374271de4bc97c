"""The catalog as a whole: tables on shared storage, and what a person asks of them.

A ``Catalog`` keeps every table of ``schema.TABLES`` as snapshots below its root. It reads
the drives it catalogues and writes nowhere but below that root and into export folders.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom import schema
from stackroom.functions import predicates
from stackroom.operators import audit, browse, curate, identity, merge, planner, redundancy, risk, scorecard, tree
from stackroom.session import checkpointed
from stackroom.sinks import exports
from stackroom.sinks.bundle import bundle
from stackroom.sources import discovery, listing
from stackroom.sources.readings import rate_table

DRIVE_FIELDS = ("nickname", "manufacturer", "model", "media", "purchase_date", "price_cents", "warranty_until", "batch_key", "role", "location", "disaster_zone", "retired_at")


class CatalogError(ValueError):
    """What the catalog refuses to do."""


def now() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")


def checked_drive_fields(fields: dict) -> dict:
    """Valid metadata of a drive; an empty text clears a field."""
    out = {}
    for name, value in fields.items():
        if name not in DRIVE_FIELDS:
            raise CatalogError(f"a drive has no field {name}")
        if value in ("", None):
            out[name] = None
        elif name in ("purchase_date", "warranty_until"):
            dt.date.fromisoformat(value + "-15" if len(value) == 7 else value)
            out[name] = value
        elif name == "price_cents":
            out[name] = int(value)
        elif name == "media" and value not in ("hdd", "ssd", "flash", "optical", "tape"):
            raise CatalogError(f"no such medium: {value}")
        else:
            out[name] = str(value).strip()
    return out


class Catalog:
    def __init__(self, spark: SparkSession, root: str, actor: str = "stackroom"):
        self.spark, self.root, self.actor = spark, root, actor
        self.tables = merge.Snapshots(spark, root)
        self._prepare()

    # tables

    def _prepare(self) -> None:
        """Create missing tables and columns; refuse a catalog newer than this build."""
        found = self.tables.current("meta")
        version = self.tables.read("meta").first().version if found else schema.VERSION
        if version > schema.VERSION:
            raise CatalogError(f"the catalog has version {version}; this build knows {schema.VERSION}")
        for name, columns in schema.TABLES.items():
            if self.tables.current(name) is None:
                self.tables.write(name, self.spark.createDataFrame([], columns))
            elif version < schema.VERSION:
                want = self.spark.createDataFrame([], columns)
                self.tables.write(name, want.unionByName(self.tables.read(name), allowMissingColumns=True))
        if not found or version < schema.VERSION:
            self.tables.write("meta", self.spark.createDataFrame([(schema.VERSION,)], "version int"))

    def table(self, name: str) -> DataFrame:
        return self.tables.read(name)

    def replace(self, name: str, df: DataFrame) -> None:
        self.tables.write(name, df.select(*[f.split()[0] for f in schema.TABLES[name].split(", ")]))

    def append(self, name: str, rows: list[dict]) -> None:
        """Add rows to a small table; missing columns are null."""
        columns = [f.split()[0] for f in schema.TABLES[name].split(", ")]
        new = self.spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schema.TABLES[name])
        self.tables.append(name, new)

    def edit(self, name: str, row_id: int, **values) -> None:
        """Write over fields of one row of a small table."""
        df = self.table(name)
        for column, value in values.items():
            df = df.withColumn(column, F.when(F.col("id") == row_id, F.lit(value).cast(df.schema[column].dataType)).otherwise(F.col(column)))
        self.replace(name, df)

    def next_id(self, name: str) -> int:
        return (self.table(name).agg(F.max("id")).first()[0] or 0) + 1

    def record(self, action: str, **detail) -> None:
        log = self.table("audit")
        self.tables.append("audit", audit.append(self.spark, log, self.actor, [(action, detail)], now()))

    # scope, drives, volumes

    def add_drive(self, **fields) -> int:
        i = self.next_id("drive")
        hardware = {k: fields.pop(k) for k in ("serial", "layout_id", "identity", "bus", "capacity_bytes") if k in fields}
        self.append("drive", [{"id": i, **hardware, **checked_drive_fields(fields)}])
        self.record("drive.add", id=i)
        return i

    def edit_drive(self, drive_id: int, **fields) -> None:
        checked = checked_drive_fields(fields)
        self.edit("drive", drive_id, **checked)
        self.record("drive.edit", id=drive_id, fields=sorted(checked))

    def discover(self, seen: DataFrame) -> None:
        """Merge drives that a discovery found: by serial, else by disk layout."""
        self.replace("drive", merge.upsert_drives(self.table("drive"), seen))
        self.record("drive.discover")

    def add_volume(self, **fields) -> int:
        i = self.next_id("volume")
        self.append("volume", [{"id": i, "volume_guid": fields.pop("volume_guid", uuid.uuid4().hex), **fields}])
        return i

    def assign(self, volume_id: int, drive_id: int) -> None:
        """Say which drive a volume is on; one that hardware identified can't be overruled."""
        v = self.table("volume").where(F.col("id") == volume_id).join(self.table("drive").select(F.col("id").alias("drive_id"), "identity"), "drive_id", "left").first()
        if v is not None and v.drive_id is not None and v.drive_id != drive_id and v.identity in ("serial", "layout"):
            raise CatalogError("the volume's drive is known by its hardware")
        self.edit("volume", volume_id, drive_id=drive_id)
        self.record("volume.assign", volume=volume_id, drive=drive_id)

    def unverified(self) -> DataFrame:
        return self.table("volume").where("drive_id IS NULL")

    def roots(self) -> DataFrame:
        return self.table("scope_root").where("removed_at IS NULL AND enabled")

    def add_root(self, volume_id: int, path: str, excludes: list[str] | None = None) -> int:
        path = os.path.abspath(path)
        own = self.root.removeprefix("file://")
        if os.path.abspath(own).startswith(path + os.sep):
            raise CatalogError("the catalog lies inside that folder")
        clash = predicates.nests([r.path for r in self.roots().where(F.col("volume_id") == volume_id).collect()], path)
        if clash:
            raise CatalogError(f"{path} and {clash} lie in one another")
        i = self.next_id("scope_root")
        self.append("scope_root", [{"id": i, "volume_id": volume_id, "path": path, "excludes": excludes or [], "enabled": True, "added_at": now()}])
        self.record("scope.add", path=path)
        return i

    def remove_root(self, root_id: int) -> None:
        self.edit("scope_root", root_id, removed_at=now())
        self.record("scope.remove", id=root_id)

    # scanning

    def _listing(self, root) -> DataFrame:
        return listing.listing(self.spark, root.path, [*predicates.DEFAULT_NAMES, *(root.excludes or [])])

    def preview(self, root_id: int) -> DataFrame:
        """What a scan would take in; nothing is written."""
        rows = self._listing(self._root(root_id)).where("name <> ''")
        return rows.agg(F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("dirs"), F.sum(F.when(~F.col("is_dir"), F.col("size"))).alias("bytes"))

    def _root(self, root_id: int):
        root = self.roots().where(F.col("id") == root_id).first()
        if root is None:
            raise CatalogError(f"no root {root_id}")
        return root

    def scan(self, root_id: int) -> dict:
        """List a root and merge what was found; what was not seen any more gets a tombstone."""
        root, scan_id, at = self._root(root_id), self.next_id("scan"), now()
        start = {"id": scan_id, "root_id": root_id, "volume_id": root.volume_id, "method": "walk", "started_at": at}
        try:
            if not os.path.isdir(root.path):
                raise CatalogError(f"{root.path} can't be listed; nothing was merged")
            rows = checkpointed(self._listing(root))
            counts = self._merge(root, rows, scan_id, at)
        except Exception as e:
            self.append("scan", [{**start, "status": "failed", "finished_at": now(), "error": str(e)[:500]}])
            raise
        self.append("scan", [{**start, "status": "done", "finished_at": now(), "files": counts["staged"]}])
        self.record("scan", root=root_id, **counts)
        return counts

    def _merge(self, root, rows: DataFrame, scan_id: int, at: str) -> dict:
        v = F.lit(root.volume_id)
        ident = lambda path: F.xxhash64(v, path)
        full = F.concat_ws("/", F.regexp_replace("dir", "/$", ""), "name")
        folders = rows.where("is_dir AND name <> '' AND attributes & 1024 = 0").select(full.alias("path"), F.col("dir").alias("up"), "name", F.col("file_id").alias("frn"))
        top = self.spark.createDataFrame([(root.path, None, root.path, None)], "path string, up string, name string, frn long")
        here = top.unionByName(folders).select(
            ident(F.col("path")).alias("id"), F.lit(root.id).alias("root_id"), v.alias("volume_id"), F.when(F.col("up").isNotNull(), ident(F.col("up"))).alias("parent_id"), "name",
            (F.size(F.split("path", "/")) - len(root.path.split("/"))).alias("depth"), "frn", F.lit(scan_id).cast("long").alias("last_seen_scan"), F.lit(None).cast("string").alias("vanished_at"),
        )
        failed = rows.where("name = '' AND error IS NOT NULL").select(ident(F.col("dir")).alias("dir_id"))
        old = self.table("dir")
        gone = old.where((F.col("root_id") == root.id) & F.col("vanished_at").isNull()).join(here.select("id"), "id", "left_anti")
        # Below a folder that could not be listed nothing is known to be gone.
        blind = tree.closure(old.select("id", "parent_id")).join(failed.select(F.col("dir_id").alias("ancestor")), "ancestor", "left_semi").select(F.col("descendant").alias("id")).distinct()
        gone = gone.join(blind, "id", "left_anti")
        dirs = old.join(here.select("id"), "id", "left_anti").join(gone.select("id", F.lit(at).alias("_at")), "id", "left")
        dirs = dirs.withColumn("vanished_at", F.coalesce("_at", "vanished_at")).drop("_at").unionByName(here)
        staged = rows.where("NOT is_dir").where(~predicates.skip_as_link(F.col("attributes"), F.lit(None).cast("long"), F.col("is_dir"))).select(
            v.alias("volume_id"), ident(F.col("dir")).alias("dir_id"), "name", curate.extension(F.col("name")).alias("ext"), F.coalesce("size", F.lit(0)).alias("size_bytes"), F.col("alloc_size").alias("alloc_bytes"),
            "mtime_ns", "ctime_ns", F.col("file_id").alias("frn"), "nlink", F.col("attributes").alias("attrs"), predicates.read_state(F.col("stat_failed"), F.col("attributes")).alias("read_state"),
        )
        merged = checkpointed(merge.merge_files(self.table("file"), staged, scan_id))
        listed = old.where(F.col("root_id") == root.id).select(F.col("id").alias("dir_id")).union(here.select(F.col("id").alias("dir_id"))).distinct().join(blind.select(F.col("id").alias("dir_id")), "dir_id", "left_anti").join(failed, "dir_id", "left_anti")
        files = merge.tombstone(merged.drop("change"), scan_id, at, listed)
        n = {r.change: r["count"] for r in merged.where("change IS NOT NULL").groupBy("change").count().collect()}
        self.tables.write_all({"file": files, "dir": dirs.select(old.columns)})
        vanished = self.table("file").where(F.col("vanished_at") == at).count()
        return {"staged": sum(n.values()), "inserted": n.get("inserted", 0), "updated": n.get("updated", 0), "vanished": vanished}

    # identity

    def files_with_paths(self) -> DataFrame:
        dirs = self.table("dir")
        paths = tree.paths(dirs, tree.closure(dirs)).select(F.col("id").alias("dir_id"), F.col("path").alias("_dir"))
        drives = self.table("drive").select(F.col("id").alias("drive_id"), "media")
        volumes = self.table("volume").select(F.col("id").alias("volume_id"), "drive_id").join(drives, "drive_id", "left")
        rows = self.table("file").join(paths, "dir_id").join(volumes, "volume_id")
        device = F.coalesce(F.col("drive_id").cast("string"), F.concat(F.lit("volume "), F.col("volume_id").cast("string")))
        return rows.withColumn("path", F.concat_ws("/", "_dir", "name")).withColumn("device", device).withColumn("media", F.coalesce("media", F.lit("unknown")))

    def hash(self) -> int:
        """Give an identity to every file that could be a copy of another; returns how many have one."""
        hashed, contents = identity.hash_pass(self.files_with_paths())
        hashed, contents = checkpointed(hashed), checkpointed(contents)
        known = self.table("content")
        self.replace("content", known.unionByName(contents.join(known.select("id"), "id", "left_anti")))
        self.replace("file", hashed)
        n = self.table("file").where("content_id IS NOT NULL AND vanished_at IS NULL").count()
        self.record("hash", identified=n)
        return n

    def verify(self) -> dict[str, int]:
        """Read identified files again and record what was found."""
        found = checkpointed(identity.verify_pass(self.files_with_paths(), self.table("content")))
        base, at = self.next_id("fixity_check"), now()
        rows = found.select((F.monotonically_increasing_id() + base).alias("id"), "file_id", "content_id", F.lit(at).alias("checked_at"), "result", F.lit(None).cast("binary").alias("expected"), "observed")
        self.tables.append("fixity_check", rows)
        counts = {r.result: r["count"] for r in found.groupBy("result").count().collect()}
        self.record("verify", **counts)
        return counts

    # reports

    @cached_property
    def rates(self) -> list[risk.RateTable]:
        return [*risk.DEFAULT_TABLES, *(rate_table(r.text) for r in (self.tables.read("rates").collect() if self.tables.current("rates") else []))]

    def import_rates(self, text: str) -> None:
        """Add a rate table; one of the same source and version is replaced."""
        t = rate_table(text)
        old = self.tables.read("rates").collect() if self.tables.current("rates") else []
        rows = [(r.name, r.text) for r in old if r.name != f"{t.source}-{t.version}"] + [(f"{t.source}-{t.version}", text)]
        self.tables.write("rates", self.spark.createDataFrame(rows, "name string, text string"))
        self.__dict__.pop("rates", None)
        self.record("standards.import", name=f"{t.source}-{t.version}")

    def groups(self) -> DataFrame:
        return redundancy.content_groups(self.table("file"), self.table("volume"))

    def singles(self) -> DataFrame:
        return redundancy.single_copies(self.table("file"), self.table("volume"))

    def summary(self, min_copies: int = 2) -> DataFrame:
        return redundancy.summary(self.table("file"), checkpointed(self.groups()), checkpointed(self.singles()), min_copies)

    def duplicates(self, limit: int = 100) -> DataFrame:
        return redundancy.duplicate_groups(self.groups()).orderBy((F.col("size_bytes") * F.col("paths")).desc(), "content_id").limit(limit)

    def under_protected(self, min_copies: int = 2) -> DataFrame:
        return redundancy.under_protected(self.groups(), self.singles(), min_copies)

    def reclamation(self) -> DataFrame:
        return redundancy.reclamation(self.groups()).orderBy(F.desc("reclaimable_bytes"), "content_id")

    def incidents(self, limit: int = 200) -> DataFrame:
        return redundancy.incidents(self.table("fixity_check"), self.table("file"), self.groups()).orderBy(F.desc("id")).limit(limit)

    def drive_risks(self, today: str | None = None) -> DataFrame:
        d = self.table("drive")
        health = tree.latest(self.table("drive_health"), "drive_id", "id")
        return risk.drive_risk(d.withColumn("batch", risk.batch_key(d)), health, today or now()[:10], self.rates)

    def _placed_items(self) -> DataFrame:
        files, volumes = self.table("file"), self.table("volume")
        rows = redundancy.placed(files, volumes)
        alone = self.singles().select("id")
        rows = rows.where("content_id IS NOT NULL").unionByName(rows.join(alone, "id", "left_semi"))
        return rows.withColumn("item", F.coalesce("content_id", F.concat(F.lit("f"), F.col("id").cast("string"))))

    def drive_sets(self, today: str | None = None) -> DataFrame:
        rows = self._placed_items()
        return risk.set_risk(risk.drive_sets(rows.select(F.col("item").alias("content_id"), "size_bytes", "drive_id")), self.drive_risks(today), risk.PROVISIONAL["unknown"])

    def durability(self, today: str | None = None) -> DataFrame:
        return risk.expected_loss(self.drive_sets(today))

    def status(self) -> DataFrame:
        return redundancy.counts(self.table("file"), self.table("dir"), self.table("volume"), self.table("drive"))

    def volumes(self) -> DataFrame:
        return browse.inventory(self.table("volume"), self.table("drive"), self.table("file"), self.table("scan"))

    def drive_names(self) -> DataFrame:
        return browse.drive_names(self.table("drive"), self.table("volume"))

    def find(self, text: str, after: int | None = None, limit: int = 50) -> DataFrame:
        """By words; a query with ``%`` is a pattern."""
        if "%" in text:
            return browse.find_like(self.table("file"), text, after, limit)
        return browse.search(self.table("file"), self.table("dir"), text, after, limit)

    # curation

    def _closure(self) -> DataFrame:
        return checkpointed(tree.closure(schema.live(self.table("dir"))))

    def propose(self) -> DataFrame:
        files = self.table("file").withColumn("modified", F.timestamp_micros(F.floor(F.col("mtime_ns") / 1000)))
        closure = self._closure()
        signals = checkpointed(curate.folder_signals(self.table("dir"), files, closure))
        chosen = curate.infer_collections(signals, closure, self.table("collection_rule").select("dir_id"))
        queue = curate.propose(self.table("collection_candidate"), chosen).withColumn("evidence", F.lit(None).cast("string"))
        self.replace("collection_candidate", checkpointed(queue))
        self.record("collection.infer")
        return self.queue()

    def queue(self) -> DataFrame:
        return self.table("collection_candidate").where("status = 'open'").orderBy(F.desc("score"), "dir_id")

    def decide(self, dir_id: int, status: str) -> None:
        self.replace("collection_candidate", checkpointed(curate.decide(self.table("collection_candidate"), dir_id, status)))
        self.record(f"collection.{status}", dir=dir_id)

    def create_collection(self, title: str, dir_ids: list[int], **fields) -> int:
        """A collection over folders; a folder belongs to one."""
        taken = self.table("collection_rule").where(F.col("dir_id").isin(dir_ids)).first() if dir_ids else None
        if taken is not None:
            raise CatalogError(f"folder {taken.dir_id} belongs to collection {taken.collection_id}")
        i = self.next_id("collection")
        self.append("collection", [{"id": i, "local_pid": f"sr-{uuid.uuid4().hex[:16]}", "title": title, **fields}])
        first = self.next_id("collection_rule")
        self.append("collection_rule", [{"id": first + k, "collection_id": i, "dir_id": d} for k, d in enumerate(dir_ids)])
        self.record("collection.create", id=i, title=title)
        return i

    def accept(self, dir_id: int, title: str, **fields) -> int:
        i = self.create_collection(title, [dir_id], **fields)
        self.decide(dir_id, "accepted")
        return i

    def members(self, collection_id: int) -> DataFrame:
        """Live files under the collection's folders."""
        rules = self.table("collection_rule").where(F.col("collection_id") == collection_id).select("dir_id")
        return tree.subtree_files(self.table("file"), self._closure(), rules)

    def _members(self) -> DataFrame:
        """``item, collection`` of every collection."""
        c = self._closure().join(self.table("collection_rule").select(F.col("dir_id").alias("ancestor"), "collection_id"), "ancestor")
        filed = c.select(F.col("descendant").alias("dir_id"), F.col("collection_id").alias("collection")).distinct()
        return self._placed_items().join(filed, "dir_id").select("item", "collection").distinct()

    def coverage(self, min_copies: int = 2, today: str | None = None) -> DataFrame:
        rows = self._placed_items().groupBy("item").agg(F.max("size_bytes").alias("size_bytes"), F.array_sort(F.collect_set("drive_id")).alias("drive_ids"))
        items = rows.join(self.drive_sets(today).select("drive_ids", "p_loss"), "drive_ids").withColumn("drives", F.size("drive_ids"))
        return curate.coverage_buckets(items, self._members(), min_copies)

    def find_versions(self) -> DataFrame:
        """Find version sets anew and store them in place of the old ones."""
        members = checkpointed(curate.version_members(self.table("file")))
        sets = checkpointed(curate.version_sets(members).withColumn("id", F.xxhash64("dir_id", "stem", "ext")))
        self.replace("version_set", sets.select("id", "label", F.lit("name-stem").alias("method"), "confidence", F.lit("same folder and name but for version marks").alias("rationale")))
        self.replace("version_member", members.select(F.xxhash64("dir_id", "stem", "ext").alias("set_id"), F.col("id").alias("file_id"), "content_id", "is_preferred"))
        self.record("versions.find")
        return self.table("version_set").orderBy(F.desc("confidence"), "label")

    def score(self, today: str | None = None) -> tuple[DataFrame, DataFrame]:
        """FAIR results and preservation levels of every collection."""
        e = self._evidence(today)
        return scorecard.fair_card(e), scorecard.ndsa_levels(scorecard.ndsa_card(e))

    def _evidence(self, today: str | None = None) -> DataFrame:
        """What the scorecards of every collection go by."""
        today = today or now()[:10]
        rows = self._placed_items()
        check = scorecard.latest_check(self.table("fixity_check"), today)
        items = rows.groupBy("item").agg(F.max(F.col("drive_id").isNull()).alias("on_unverified"), F.max(F.col("content_id").isNotNull()).alias("hashed"))
        items = items.join(check.withColumnRenamed("content_id", "item"), "item", "left").fillna(False, ["verified", "ever_verified"])
        held = rows.where("drive_id IS NOT NULL").select("item", "drive_id").distinct()
        d = self.table("drive")
        e = scorecard.evidence(self._members().join(items, "item"), held, d.withColumn("batch", risk.batch_key(d)))
        facts = curate.completeness(self.table("collection")).select(F.col("id").alias("collection"), F.col("local_pid").isNotNull().alias("has_pid"), "missing", (F.length(F.coalesce("license", F.lit(""))) > 0).alias("has_license"))
        relations = self.table("collection_relation").groupBy(F.col("collection_id").alias("collection")).agg(F.count("*").alias("relations"))
        return checkpointed(e.join(facts, "collection").join(relations, "collection", "left").fillna(0, ["relations"]))

    def split(self, dir_id: int) -> DataFrame:
        """Replace a candidate by its child folders, each with its own score."""
        self.decide(dir_id, "split")
        children = schema.live(self.table("dir")).where(F.col("parent_id") == dir_id)
        files = self.table("file").withColumn("modified", F.timestamp_micros(F.floor(F.col("mtime_ns") / 1000)))
        signals = curate.folder_signals(self.table("dir"), files, self._closure())
        new = children.join(signals.select("id", "score"), "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
        queue = curate.propose(self.table("collection_candidate"), new).withColumn("evidence", F.lit(None).cast("string"))
        self.replace("collection_candidate", checkpointed(queue))
        return self.queue()

    def accept_all(self, min_score: float) -> int:
        """Accept every open candidate of at least this score, titled by its folder's name."""
        names = self.table("dir").select(F.col("id").alias("dir_id"), "name")
        rows = self.queue().where(F.col("score") >= min_score).join(names, "dir_id").collect()
        for r in rows:
            self.accept(r.dir_id, r.name)
        return len(rows)

    def edit_collection(self, collection_id: int, **fields) -> None:
        known = set(curate.DESCRIPTIVE) | {"ndsa_target"}
        if set(fields) - known:
            raise CatalogError(f"a collection has no field {sorted(set(fields) - known)[0]}")
        self.edit("collection", collection_id, **fields)
        self.record("collection.edit", id=collection_id, fields=sorted(fields))

    def collections(self, today: str | None = None) -> DataFrame:
        """Each collection with its members' files and bytes, filled fields and FAIR score."""
        tops = self.table("collection_rule").select(F.col("dir_id").alias("ancestor"), "collection_id")
        dirs = self._closure().join(tops, "ancestor").select(F.col("descendant").alias("dir_id"), "collection_id").distinct()
        held = schema.live(self.table("file")).join(dirs, "dir_id").groupBy(F.col("collection_id").alias("id")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
        scores = scorecard.fair_score(self.score(today)[0]).withColumnRenamed("collection", "id")
        return curate.completeness(self.table("collection")).select("id", "title", "filled").join(held, "id", "left").join(scores, "id", "left")

    def versions(self, vanished: bool = False) -> DataFrame:
        """Members of the stored version sets; live ones unless asked otherwise."""
        files = self.table("file") if vanished else schema.live(self.table("file"))
        rows = self.table("version_member").join(files.select(F.col("id").alias("file_id"), "name"), "file_id")
        return rows.join(self.table("version_set").select(F.col("id").alias("set_id"), "label", "confidence"), "set_id")

    def forget_rates(self, name: str) -> None:
        """Drop an imported rate table."""
        self.tables.write("rates", checkpointed(self.tables.read("rates").where(F.col("name") != name)))
        self.__dict__.pop("rates", None)
        self.record("standards.forget", name=name)

    def recent(self, table: str, n: int = 20) -> DataFrame:
        """The newest rows of scans, audit entries, plans or exports."""
        return self.table(table).orderBy(F.desc("id")).limit(n)

    def bound_roots(self, mounted: DataFrame) -> DataFrame:
        """Roots in scope with their volume, and whether it is the one that is mounted there: ``mount, volume_guid``."""
        places = [(r.id, m.mount) for r in self.roots().collect() for m in mounted.collect() if predicates.prefix_covers(m.mount, r.path) or m.mount == "/"]
        best = {i: max((m for j, m in places if j == i), key=len) for i, _ in places}
        at = self.spark.createDataFrame(sorted(best.items()), "id long, mount string")
        return predicates.bind_roots(self.roots().join(at, "id", "left"), self.table("volume"), mounted)

    def analyze(self, database: str = "default") -> list[str]:
        """Register the current snapshots as tables of the session and collect their statistics."""
        names = []
        for name in schema.TABLES:
            full = f"{database}.stackroom_{name}"
            self.spark.sql(f"DROP TABLE IF EXISTS {full}")
            if len(self.tables.current(name)) > 1:
                self.replace(name, self.table(name))
            self.spark.catalog.createTable(full, f"{self.tables.root}/{name}/{self.tables.current(name)[0]}", "parquet")
            self.spark.sql(f"ANALYZE TABLE {full} COMPUTE STATISTICS")
            names.append(full)
        return names

    # planning, exports

    def plan(self, min_copies: int = 2, today: str | None = None) -> int:
        """Make a draft plan of copies; an earlier draft is superseded."""
        dirs, closure = schema.live(self.table("dir")).select("id", "parent_id"), self._closure()
        direct = tree.direct_totals(self.table("file")).select("dir_id", "bytes")
        units = planner.cut_units(dirs, direct, closure, self.table("collection_rule").select("dir_id"))
        rows = self._placed_items()
        held = rows.groupBy("item").agg(F.array_sort(F.collect_set("drive_id")).alias("drive_ids"))
        measures = planner.unit_measures(rows.join(units, "dir_id").join(held, "item").select("unit", "item", "size_bytes", "drive_ids"))
        sets = rows.join(units, "dir_id").join(held, "item").groupBy("unit").agg(F.collect_set("drive_ids").alias("sets"))
        afr = {r.id: r for r in self.drive_risks(today).select("id", "afr", "batch", "disaster_zone").collect()}

        def p_of(drives: frozenset[int]) -> float:
            known = [afr[d] for d in drives if d in afr]
            if not known:
                return risk.PROVISIONAL["unknown"]
            p = 1.0
            for r in known:
                p *= r.afr
            batches, zones = [r.batch for r in known if r.batch], [r.disaster_zone for r in known]
            p *= risk.SAME_BATCH ** (len(batches) - len(set(batches))) * risk.SAME_ZONE ** (len(zones) - len(set(zones)))
            return min(p, *(r.afr for r in known))

        rules = {r.dir_id: r for r in self.table("collection_rule").join(self.table("collection").select(F.col("id").alias("collection_id"), "title", "ndsa_target"), "collection_id").collect()}
        of = lambda unit: rules.get(int(unit[1:])) if unit[0] == "c" else None
        found = [
            planner.Unit(
                r.unit, r.bytes, frozenset(r.holders), frozenset(frozenset(s) for s in r.sets), planner.target_copies(of(r.unit) and of(r.unit).ndsa_target, min_copies),
                p_of(frozenset(r.holders)), {4096: r.footprint_4096, 131_072: r.footprint_131072}, of(r.unit) and of(r.unit).collection_id,
            )
            for r in measures.join(sets, "unit").collect()
        ]
        to = [planner.Destination(r.id, r.room or 0, r.cluster_bytes or planner.DEFAULT_CLUSTER, afr[r.id].batch or "", r.disaster_zone or "", bool(r.excluded)) for r in planner.destinations(self.table("drive"), self.table("volume")).collect()]
        made = planner.refine(found, to, p_of, planner.greedy(found, to, p_of))
        i = self.next_id("plan")
        steps, summary = self._document(found, to, made, p_of, today)
        columns = [f.split()[0] for f in schema.TABLES["plan_step"].split(", ")]
        rows = [tuple(({"plan_id": i, "id": k} | step).get(c) for c in columns) for k, step in enumerate(steps, 1)]
        policy = {"min_copies": min_copies, "reserve_share": planner.RESERVE_SHARE, "reserve_floor": planner.RESERVE_FLOOR, "batch_and_zone_limit": "target - 1"}
        new_plan = self.spark.createDataFrame([(i, now(), "draft", json.dumps(policy), json.dumps(summary))], schema.TABLES["plan"])
        plans, all_steps = planner.store(self.table("plan"), self.table("plan_step"), new_plan, self.spark.createDataFrame(rows, schema.TABLES["plan_step"]))
        self.tables.write_all({"plan": checkpointed(plans), "plan_step": checkpointed(all_steps)})
        self.record("plan.make", id=i)
        return i

    def _document(self, units: list, drives: list, made, p_of, today: str | None) -> tuple[list[dict], dict]:
        """The steps of a plan, in the order a person takes them, and its figures."""
        by_key, names = {u.key: u for u in units}, {r.id: r.name for r in self.drive_names().collect()}
        deltas = planner.risk_deltas(units, made, p_of)
        source = {u.key: min(u.holders, default=None) for u in units}
        load: dict[int, int] = {}
        for c in made.copies:
            load[c.drive_id] = load.get(c.drive_id, 0) + c.footprint
        order = sorted(range(len(made.copies)), key=lambda k: (-load[made.copies[k].drive_id], made.copies[k].drive_id, deltas[k]))
        numbers = planner.rounds((source[made.copies[k].unit], made.copies[k].drive_id) for k in order)
        dirs = self.table("dir")
        wanted = self.spark.createDataFrame([(int(c.unit[1:]),) for c in made.copies], "id long").distinct()
        paths = {r.id: r.path for r in tree.paths(dirs, tree.closure(dirs)).join(wanted, "id", "left_semi").collect()} if made.copies else {}
        steps = []
        for number, k in sorted(zip(numbers, order), key=lambda x: x[0]):
            c, unit, held = made.copies[k], by_key[made.copies[k].unit], source[made.copies[k].unit]
            shared = f"; shares its {' and '.join(c.crowds[::2])} with another copy" if c.crowds else ""
            note = f"{unit.copies()} of {unit.target} copies now{shared}" + ("" if held else "; confirm the source drive first")
            target = "/".join(filter(None, ("copies", exports.safe_folder(names.get(held) or f"drive {held}") if held else "unconfirmed", paths.get(int(c.unit[1:]), "").strip("/"))))
            steps.append({"kind": "copy", "unit": c.unit, "drive_id": c.drive_id, "round": number, "bytes": unit.bytes, "note": note, "source_drive_id": held, "footprint_bytes": c.footprint, "risk_delta": deltas[k], "collection_id": unit.collection, "dst_path": target})
        for r in curate.completeness(self.table("collection")).where("missing > 0").orderBy("id").collect():
            steps.append({"kind": "describe", "collection_id": r.id, "note": f"{r.title}: {r.filled} of {r.filled + r.missing} descriptive fields are filled"})
        waiting = self.queue().count()
        if waiting:
            steps.append({"kind": "review-candidate", "note": f"{waiting} proposed collections wait for a decision"})
        summary = planner.simulate(units, made, p_of, numbers)
        if made.short:
            largest = max(by_key[k].bytes for k in made.short)
            steps.append({"kind": "acquire", "bytes": summary["short_bytes"], "note": f"{len(made.short)} units lack {summary['short_copies']} copies; the largest has {largest} bytes"})
        physical = F.concat_ws(":", F.col("volume_id").cast("string"), F.coalesce(F.col("frn").cast("string"), F.concat(F.lit("f"), F.col("id").cast("string"))))
        same = planner.same_drive_extra(redundancy.placed(self.table("file"), self.table("volume")).withColumn("physical", physical))
        summary["same_drive_duplicate_bytes"] = {str(r.drive_id): r.extra_bytes for r in same.collect()}
        if any(u.collection is not None for u in units):
            card = scorecard.ndsa_card(self._evidence(today)).where(F.col("criterion").isin(*planner.PROJECTED))
            summary["projection"] = planner.projection(units, made, drives, {(r.collection, r.criterion): r.result for r in card.collect()})
        return steps, summary

    def _export_root(self, folder: str) -> None:
        """Refuse a folder inside a root in scope, or on the drive of one unless it is the system's own."""
        place = os.path.realpath(folder)
        guids = {r.id: r.volume_guid for r in self.table("volume").collect()}
        own = discovery.volume_guid_of(place)
        for r in self.roots().collect():
            if os.path.commonpath([os.path.realpath(r.path), place]) == os.path.realpath(r.path):
                raise CatalogError(f"{folder} lies inside {r.path}, which is catalogued")
            if own is not None and guids.get(r.volume_id) == own != discovery.system_volume_guid():
                raise CatalogError(f"{folder} is on the same drive as {r.path}, which is catalogued")

    def mapping(self, collection_id: int) -> DataFrame:
        """``old, new``: each member's path, and a safe one below the collection's own folder."""
        title = self.table("collection").where(F.col("id") == collection_id).first().title
        rows = self.files_with_paths().select("id", "path").join(self.members(collection_id).select("id"), "id", "left_semi")
        parts = F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), curate.safe_name)
        rows = rows.select(F.col("path").alias("old"), F.concat_ws("/", F.lit(exports.safe_folder(title)), F.array_join(parts, "/")).alias("new"), F.col("path").alias("seq"))
        return curate.name_mapping(rows).select("old", "new")

    def preview_steps(self) -> DataFrame:
        """``src, dst, recursive, note`` of the newest plan's copies; drives stand by name, as where they are mounted isn't known."""
        newest = self.table("plan").agg(F.max("id")).first()[0] or 0
        dirs = self.table("dir")
        paths = tree.paths(dirs, tree.closure(dirs)).select(F.col("id").alias("dir_id"), "path")
        names = self.drive_names().select(F.col("id").alias("drive_id"), "name")
        steps = self.table("plan_step").where((F.col("plan_id") == newest) & (F.col("kind") == "copy"))
        steps = steps.withColumn("dir_id", F.expr("cast(substring(unit, 2) as bigint)")).join(paths, "dir_id").join(names, "drive_id").orderBy("id")
        note = F.concat(F.lit("round "), F.col("round").cast("string"), F.lit(": "), F.coalesce("note", F.lit("")))
        return steps.select(F.col("path").alias("src"), F.concat(F.lit("["), F.col("name"), F.lit("]/"), "dst_path").alias("dst"), (~F.col("unit").startswith("l")).alias("recursive"), note.alias("note"))

    def export(self, folder: str, kinds: tuple[str, ...] = ("manifests", "collections", "reports"), today: str | None = None) -> str:
        """Write a bundle of these kinds (also ``mappings`` and ``previews``) into a new folder and record it."""
        self._export_root(folder)
        with bundle(folder, "-".join(kinds)) as b:
            files = self.files_with_paths().drop("drive_id", "media", "device", "_dir")
            collections = self.table("collection").collect() if {"collections", "mappings", "manifests"} & set(kinds) else []
            if "manifests" in kinds:
                names = {("drive", r.id): r.name for r in self.drive_names().collect()}
                titles = self.table("collection").select(F.col("id").alias("collection_id"), F.col("title").alias("collection"))
                filed = self._closure().join(self.table("collection_rule").select(F.col("dir_id").alias("ancestor"), "collection_id"), "ancestor").select(F.col("descendant").alias("dir_id"), "collection_id").join(titles, "collection_id")
                exports.write_manifests(b, checkpointed(exports.manifest_files(files, self.table("volume"), self.table("content"))), names, filed if collections else None)
            if "collections" in kinds:
                held = self._placed_items().groupBy("content_id").agg(F.array_sort(F.collect_set("drive_id")).alias("drives"))
                related = self.table("collection_relation").collect()
                for c in collections:
                    rows = files.join(self.members(c.id).select("id"), "id", "left_semi").join(held, "content_id", "left")
                    about = c.asDict() | {"creators": [p.strip() for p in (c.creators or "").split(";") if p.strip()]}
                    exports.write_package(b, about, checkpointed(rows.select("path", F.col("size_bytes").alias("bytes"), F.col("content_id").alias("hash"), "drives")), [r.asDict() for r in related if r.collection_id == c.id], int((today or now())[:4]))
            if "mappings" in kinds:
                for c in collections:
                    exports.write_mapping(b, checkpointed(self.mapping(c.id)), f"mappings/{exports.safe_folder(c.title)}-{c.id}")
            if "reports" in kinds:
                cards, levels = self.score(today)
                newest = self.table("plan").agg(F.max("id")).first()[0] or 0
                exports.write_reports(b, {
                    "summary": self.summary(), "duplicates": self.duplicates(), "under_protected": self.under_protected(), "volumes": self.volumes(), "durability": self.durability(today),
                    "scorecards": cards, "preservation_levels": levels, "plan": self.table("plan_step").where(F.col("plan_id") == newest).orderBy("id"),
                })
            if "previews" in kinds:
                exports.write_previews(b, self.preview_steps())
            record = b.close()
        self.append("export", [{"id": self.next_id("export"), "path": str(b.path), "created_at": now(), "files": len(record["files"]), "bytes": sum(f["bytes"] for f in record["files"])}])
        self.record("export", path=str(b.path))
        return str(b.path)

    def backup(self, to: str) -> None:
        """Copy the current snapshot of every table to another root."""
        other = merge.Snapshots(self.spark, to)
        for name in ["meta", *schema.TABLES]:
            other.write(name, self.tables.read(name))

    def audit_problems(self) -> DataFrame:
        return audit.problems(self.table("audit"))
