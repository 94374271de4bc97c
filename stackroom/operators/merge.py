"""The catalog never forgets: merging a scan into it, and tombstones for what was not seen.

Tables are snapshots: a merge is one full outer join and a new folder; what only grows is appended to. It is idempotent for
a scan id, so at-least-once delivery of a micro-batch does no harm.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OVERWRITTEN = ["size_bytes", "alloc_bytes", "mtime_ns", "ctime_ns", "frn", "nlink", "attrs", "read_state"]
#: A delta that touches a larger share of all directories becomes a full scan.
FULL_SCAN_SHARE = 0.5


def kept_identity(old_size, old_mtime, old_content, new_size, new_mtime):
    """Same size and same time keep the identity; anything else, unknown times too, loses it."""
    return F.when((old_size == new_size) & (old_mtime == new_mtime), old_content)


def merge_files(files: DataFrame, staged: DataFrame, scan_id: int) -> DataFrame:
    """``files`` with the staged rows inserted or written over, by (dir_id, name).

    A match overwrites what a listing tells and clears the tombstone; ``ext``, ``volume_id``,
    ``id`` and ``first_seen_scan`` stay as they were. Staged rows repeat at most once a key.
    Adds ``change``: inserted, updated or null. Unseen rows stay as they are.
    """
    columns = files.columns
    old, new = files.alias("o"), staged.alias("n")
    both = old.join(new, (F.col("o.dir_id") == F.col("n.dir_id")) & (F.col("o.name") == F.col("n.name")), "full_outer")
    seen, had = F.col("n.dir_id").isNotNull(), F.col("o.dir_id").isNotNull()
    out = []
    for c in columns:
        o = F.col(f"o.{c}")
        if c in OVERWRITTEN and c in staged.columns:
            e = F.when(seen, F.col(f"n.{c}")).otherwise(o)
        elif c == "content_id":
            e = F.when(seen & had, kept_identity(F.col("o.size_bytes"), F.col("o.mtime_ns"), o, F.col("n.size_bytes"), F.col("n.mtime_ns"))).when(~seen, o)
        elif c == "vanished_at":
            e = F.when(~seen, o)
        elif c == "last_seen_scan":
            e = F.when(seen, F.lit(scan_id).cast("long")).otherwise(o)
        elif c == "first_seen_scan":
            e = F.when(had, o).otherwise(F.lit(scan_id).cast("long"))
        elif c == "id":
            e = F.when(had, o).otherwise(F.xxhash64(F.col("n.dir_id"), F.col("n.name")) if c not in staged.columns else F.col(f"n.{c}"))
        else:
            e = F.when(had, o).otherwise(F.col(f"n.{c}") if c in staged.columns else F.lit(None))
        out.append(e.cast(files.schema[c].dataType).alias(c))
    change = F.when(seen & ~had, "inserted").when(seen, "updated").alias("change")
    return both.select(*out, change)


def tombstone(files: DataFrame, scan_id: int, at: str, scope: DataFrame) -> DataFrame:
    """Files in the directories ``scope(dir_id)`` that this scan did not see are vanished from ``at`` on."""
    inside = scope.select("dir_id", F.lit(True).alias("_in")).distinct()
    unseen = F.col("_in") & (F.coalesce("last_seen_scan", F.lit(-1)) != scan_id) & F.col("vanished_at").isNull()
    return files.join(inside, "dir_id", "left").withColumn("vanished_at", F.when(unseen, at).otherwise(F.col("vanished_at"))).drop("_in").select(files.columns)


def missing_children(dirs: DataFrame, listed: DataFrame, seen: DataFrame) -> DataFrame:
    """Live children of listed directories that the listing did not show: ``dir_id``."""
    rows = dirs.where("vanished_at IS NULL").join(listed.select(F.col("dir_id").alias("parent_id")), "parent_id", "left_semi")
    return rows.join(seen.select(F.col("dir_id").alias("id")), "id", "left_anti").select(F.col("id").alias("dir_id"))


def tombstone_dirs(dirs: DataFrame, tree: DataFrame, gone: DataFrame, at: str) -> DataFrame:
    """Directories ``gone(dir_id)`` and all below them are vanished from ``at`` on."""
    below = tree.join(gone.select(F.col("dir_id").alias("ancestor")), "ancestor", "left_semi").select(F.col("descendant").alias("id"), F.lit(True).alias("_in")).distinct()
    vanished = F.when(F.col("_in") & F.col("vanished_at").isNull(), at).otherwise(F.col("vanished_at"))
    return dirs.join(below, "id", "left").withColumn("vanished_at", vanished).drop("_in").select(dirs.columns)


def intern_dirs(paths: DataFrame) -> DataFrame:
    """``id, volume_id, parent_id, name, depth`` for directory paths ``volume_id, path`` and all their ancestors.

    Ids are hashes of volume and full path, so interning needs no lookup and repeats harmlessly.
    """
    parts = F.split(F.trim(F.regexp_replace("path", "/+", "/")), "/")
    rows = paths.withColumn("p", F.filter(parts, lambda x: x != "")).select("volume_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("p")), lambda n: F.slice("p", 1, n))).alias("p")).distinct()
    ident = lambda p: F.xxhash64(F.col("volume_id"), F.array_join(p, "/"))
    n = F.size("p")
    return rows.select(
        ident(F.col("p")).alias("id"), "volume_id",
        F.when(n > 0, ident(F.slice("p", 1, F.greatest(n - 1, F.lit(0))))).alias("parent_id"),
        F.when(n > 0, F.element_at("p", F.greatest(n, F.lit(1)))).otherwise("").alias("name"), n.alias("depth"),
    )


def touched(records: DataFrame) -> DataFrame:
    """Directories that a batch of journal records makes stale: every parent, and a directory's own number."""
    own = records.where(F.col("attributes").bitwiseAND(0x10) != 0).select(F.col("frn").alias("frn"))
    return records.select(F.col("parent_frn").alias("frn")).union(own).distinct()


def delta_or_full(touched_dirs: int, all_dirs: int) -> str:
    return "full" if all_dirs and touched_dirs > FULL_SCAN_SHARE * all_dirs else "delta"


def upsert_drives(drives: DataFrame, seen: DataFrame) -> DataFrame:
    """Drives found by a discovery, merged by serial, else by layout id when the holder has no serial or the same one."""
    columns = drives.columns
    new = seen.select([F.col(c) if c in seen.columns else F.lit(None).cast(drives.schema[c].dataType).alias(c) for c in columns if c != "id"])
    by_serial = drives.where("serial IS NOT NULL").select("serial", F.col("id").alias("_s"))
    by_layout = drives.where("layout_id IS NOT NULL").select("layout_id", F.col("id").alias("_l"), F.col("serial").alias("_ls"))
    m = new.join(by_serial, "serial", "left").join(by_layout, "layout_id", "left")
    by_layout_ok = F.col("_ls").isNull() | F.col("serial").isNull() | (F.col("_ls") == F.col("serial"))
    m = m.withColumn("id", F.coalesce(F.col("_s"), F.when(by_layout_ok, F.col("_l")), F.xxhash64(F.coalesce("serial", "layout_id"))))
    update = m.groupBy("id").agg(*[F.first(c, True).alias(f"_{c}") for c in columns if c != "id"])
    out = drives.join(update, "id", "full_outer")
    return out.select("id", *[F.coalesce(c, f"_{c}").alias(c) for c in columns if c != "id"])


class ConcurrentWrite(RuntimeError):
    """Another writer has changed a table since it was read."""


class Snapshots:
    """Tables as immutable folders of Parquet, and a log of commits.

    A commit is a small file below ``_log``: for every table the folders that it consists of. Its
    number is claimed by creating the file exclusively, so all tables of a commit change at
    once, and of two writers one comes after the other: appends then add up, and a replacement of
    what the other has changed is refused. Readers go by the last whole commit.
    """

    #: Folders of a table, from which on an append writes the table anew as one.
    MOST_PARTS = 64
    #: Seconds that a commit may stay unfinished before its writer counts as dead.
    PATIENCE = 5.0

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.seen: dict[str, list[str] | None] = {}

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _numbers(self) -> list[int]:
        return sorted(int(str(f.getPath().getName())[:12]) for f in self.fs.globStatus(self._path("_log", "[0-9]*.json")) or [])

    def _load(self, number: int) -> dict[str, list[str]] | None:
        stream = self.fs.open(self._path("_log", f"{number:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except json.JSONDecodeError:
            return None
        finally:
            stream.close()

    def state(self) -> dict[str, list[str]]:
        """The folders of every table; an unfinished last commit is waited for, then passed over."""
        waited = 0.0
        while True:
            numbers = self._numbers()
            if not numbers:
                return {}
            found = self._load(numbers[-1])
            if found is not None:
                return found
            if waited >= self.PATIENCE:
                return next((s for n in reversed(numbers[:-1]) if (s := self._load(n)) is not None), {})
            time.sleep(0.1)
            waited += 0.1

    def current(self, table: str) -> list[str] | None:
        """The folders of a table; None if it isn't there."""
        return self.state().get(table)

    def read(self, table: str) -> DataFrame:
        parts = self.seen[table] = self.current(table)
        if parts is None:
            raise FileNotFoundError(f"no snapshot of {table}")
        return self.spark.read.parquet(*(f"{self.root}/{table}/{part}" for part in parts))

    def _folder(self, table: str, df: DataFrame, partition_by: list[str] | None = None) -> str:
        name = uuid.uuid4().hex
        (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(f"{self.root}/{table}/{name}")
        return name

    def _commit(self, replaced: dict[str, str], added: dict[str, str]) -> None:
        while True:
            number, now = (self._numbers() or [0])[-1] + 1, self.state()
            for table in replaced:
                if now.get(table) != self.seen.get(table, now.get(table)):
                    raise ConcurrentWrite(f"{table} was changed by another writer")
            new = now | {t: [name] for t, name in replaced.items()} | {t: [*now.get(t, []), name] for t, name in added.items()}
            path = self._path("_log", f"{number:012d}.json")
            try:
                out = self.fs.create(path, False)
            except Py4JJavaError:
                if self.fs.exists(path):
                    continue
                raise
            out.write(bytearray(json.dumps(new), "utf-8"))
            out.close()
            self.seen |= {t: new[t] for t in (*replaced, *added)}
            return

    def write(self, table: str, df: DataFrame, partition_by: list[str] | None = None) -> None:
        """Replace a table; readers of the old folders aren't disturbed."""
        self._commit({table: self._folder(table, df, partition_by)}, {})

    def write_all(self, tables: dict[str, DataFrame]) -> None:
        """Replace several tables in one commit: all or none."""
        self._commit({t: self._folder(t, df) for t, df in tables.items()}, {})

    def append(self, table: str, df: DataFrame) -> None:
        """Add rows without writing the table anew."""
        if len(self.current(table) or []) >= self.MOST_PARTS:
            self.write(table, self.read(table).unionByName(df))
        else:
            self._commit({}, {table: self._folder(table, df)})

    def purge(self, table: str) -> None:
        """Delete every folder that the table doesn't consist of any more."""
        parts = self.current(table) or []
        for p in self.fs.listStatus(self._path(table)):
            if parts and str(p.getPath().getName()) not in parts:
                self.fs.delete(p.getPath(), True)
