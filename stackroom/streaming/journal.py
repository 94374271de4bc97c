"""``change_journal``: a streaming source of journal records, and the delta that follows from them.

A page file ``<first usn>.bin`` holds an eight-byte cursor (the next USN) and records. The
offset is the next USN and the journal's id. Beside the pages, ``journal.state`` may hold the
buffer of the journal query: id, first, next and lowest valid USN. Every read checks that the
cursor still describes the journal: the same id, no record between the cursor and the first
unread page or between pages, and no cursor ahead of the journal; else it raises, and the
caller runs a full scan. Without ``journal.state`` there is no id, and a recreated journal shows
only by its USNs.

The driver reads the pages; with ``recordsPerBatch`` it holds no more records than that and one
page's, and a batch may end within a page. A query with the trigger ``availableNow`` is one such
batch; ``follow_all`` runs them until the journal is read.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from stackroom.operators import merge
from stackroom.operators.tree import closure
from stackroom.session import checkpointed
from stackroom.sources.binary import JOURNAL_FIELDS, journal_records


STATE = "journal.state"


class JournalGap(RuntimeError):
    """The stored cursor no longer describes the journal."""


def pages(path: str) -> list[tuple[int, str]]:
    return sorted((int(n[:-4]), os.path.join(path, n)) for n in os.listdir(path) if n.endswith(".bin"))


def state(path: str) -> tuple[int, int, int] | None:
    """``journal id, next USN, lowest valid USN`` of ``journal.state``; None where that is not there."""
    try:
        with open(os.path.join(path, STATE), "rb") as f:
            journal_id, _, following, lowest = struct.unpack_from("<Qqqq", f.read())
    except FileNotFoundError:
        return None
    return journal_id, following, lowest


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.path, self.first = options["path"], int(options.get("startingUsn", "-1"))
        self.most = int(options["recordsPerBatch"]) if "recordsPerBatch" in options else None
        if self.most is not None and self.most < 1:
            raise ValueError("recordsPerBatch is at least 1")

    def initialOffset(self):  # noqa: N802
        found, now = pages(self.path), state(self.path)
        if found and self.first >= 0 and self.first < found[0][0]:
            raise JournalGap(f"records from {self.first} to {found[0][0]} were purged")
        # Before any page, -1: the first page there will be.
        start = self.first if self.first >= 0 else (found[0][0] if found else -1)
        return {"usn": start, "journal": now[0] if now else None}

    def _from(self, start: dict, end: dict | None = None):
        """Records from one offset to another, or to the batch size or the last page, and the offset behind them."""
        # The pages are listed before the state is read: a journal recreated in between shows by its id.
        found, now = pages(self.path), state(self.path)
        at, known, stop = start["usn"], start.get("journal"), None if end is None else end["usn"]
        if now:
            if known is not None and known != now[0]:
                raise JournalGap(f"the journal {known} was recreated as {now[0]}")
            if 0 <= at < now[2]:
                raise JournalGap(f"records from {at} to {now[2]} were purged")
            if at > now[1]:
                raise JournalGap(f"the cursor {at} is ahead of the journal, which ends at {now[1]}")
        elif known is not None:
            raise JournalGap(f"the state of journal {known} is gone")
        rows, last = [], None
        full = lambda: stop is None and self.most is not None and len(rows) >= self.most
        for first, name in found:
            if full() or (stop is not None and at >= stop):
                break
            with open(name, "rb") as f:
                following = struct.unpack("<q", f.read(8))[0]
                last = following if last is None else max(last, following)
                if at < 0:
                    at = first
                if following <= at:
                    continue
                if first > at:
                    raise JournalGap(f"records from {at} to {first} are in no page")
                buffer = f.read()
            rows += [(Decimal(r[0]), Decimal(r[1]), *r[2:]) for r in journal_records(buffer, 0) if r[4] >= at and (stop is None or r[4] < stop)]
            at = following
        if full() and len(rows) > self.most:
            # The next batch begins at the first record left over: USNs grow, and none is given twice.
            at, rows = rows[self.most][4], rows[: self.most]
        if last is not None and at > last and (stop is None or at < stop):
            raise JournalGap(f"the cursor {at} is ahead of the journal, whose pages end at {last}")
        if stop is not None and at < stop:
            raise JournalGap(f"records from {at} to {stop} are in no page")
        return rows, {"usn": at, "journal": now[0] if now else known}

    def read(self, start):
        rows, end = self._from(start)
        return iter(rows), end

    def readBetweenOffsets(self, start, end):  # noqa: N802
        return iter(self._from(start, end)[0])

    def commit(self, end):
        pass


class ChangeJournal(DataSource):
    """``spark.readStream.format("change_journal").option("startingUsn", n).load(folder)``"""

    @classmethod
    def name(cls):
        return "change_journal"

    def schema(self):
        return JOURNAL_FIELDS

    def simpleStreamReader(self, schema):  # noqa: N802
        return _Stream(self.options)


def journal_stream(spark: SparkSession, path: str, starting_usn: int | None = None, records_per_batch: int | None = None) -> DataFrame:
    spark.dataSource.register(ChangeJournal)
    reader = spark.readStream.format("change_journal")
    for option, value in (("startingUsn", starting_usn), ("recordsPerBatch", records_per_batch)):
        reader = reader if value is None else reader.option(option, value)
    return reader.load(path)


class NeedsFullScan(RuntimeError):
    """So much has changed that a full scan is the better way, and nobody was there to run it."""


@dataclass
class Listing:
    """What listing directories found: staged file rows; their child directories (id, parent_id, frn, name and
    other columns of ``dir``); and which of them could not be listed (id)."""

    files: DataFrame
    dirs: DataFrame | None = None
    failed: DataFrame | None = None


def apply_delta(tables: merge.Snapshots, records: DataFrame, relist: Callable[[DataFrame], DataFrame | Listing], scan_id: int, at: str, counters: dict | None = None) -> str:
    """Merge one batch of records into the ``dir`` and ``file`` tables, in one commit.

    The touched directories are listed again by ``relist(dirs)``. Child directories that the
    catalog lacks, or that had vanished, are listed as well, level by level, so a new subtree comes in
    whole. Children that a listing no longer shows vanish with all below them. Below a directory
    that could not be listed nothing vanishes. Records of directories that the catalog
    doesn't know are counted only. Nothing is done twice by running a batch again with its scan id.
    Returns ``delta``, or ``full``, with nothing written, when a full scan is the better way.
    """
    dirs, counters = tables.read("dir"), {} if counters is None else counters
    alive = dirs.where("vanished_at IS NULL")
    touched = checkpointed(merge.touched(records).select(F.col("frn").cast("long").alias("frn")))
    hit = checkpointed(alive.join(touched, "frn", "left_semi"))
    n_touched, n_all = touched.count(), alive.count()
    counters |= {"touched": n_touched, "unknown_parents": touched.join(alive, "frn", "left_anti").count(), "new_subtrees": 0, "vanished_dirs": 0}
    if merge.delta_or_full(n_touched, n_all) == "full":
        return "full"
    if hit.isEmpty():
        return "delta"
    todo, staged, listed, seen = hit, None, None, None
    join = lambda a, b: b if a is None else a.unionByName(b)
    while True:
        found = relist(todo)
        found = found if isinstance(found, Listing) else Listing(found)
        staged = join(staged, checkpointed(found.files))
        ok = todo.select("id") if found.failed is None else todo.select("id").join(found.failed.select("id"), "id", "left_anti")
        listed = join(listed, ok)
        if found.dirs is None:
            break
        kids = checkpointed(found.dirs)
        seen = join(seen, kids)
        todo = checkpointed(kids.join(alive.select("id"), "id", "left_anti"))
        fresh = todo.count()
        if not fresh:
            break
        # What lies below a new directory is new as well, but one subtree.
        counters["new_subtrees"] += fresh if listed is ok else 0
    listed = checkpointed(listed.distinct())
    scope, changes = listed.select(F.col("id").alias("dir_id")), {}
    if seen is not None:
        gone = checkpointed(merge.missing_children(dirs, scope, seen.select(F.col("id").alias("dir_id"))))
        counters["vanished_dirs"] = gone.count()
        below = closure(alive.select("id", "parent_id")).join(gone.select(F.col("dir_id").alias("ancestor")), "ancestor", "left_semi").select(F.col("descendant").alias("dir_id")).distinct()
        below = checkpointed(below.join(seen.select(F.col("id").alias("dir_id")), "dir_id", "left_anti"))
        scope = scope.union(below)
        merged = _with_dirs(dirs, seen.dropDuplicates(["id"]), listed, scan_id)
        lost = below.select(F.col("dir_id").alias("id"), F.lit(True).alias("_lost"))
        vanished = F.when(F.col("_lost") & F.col("vanished_at").isNull(), at).otherwise(F.col("vanished_at"))
        changes["dir"] = merged.join(lost, "id", "left").withColumn("vanished_at", vanished).select(dirs.columns)
    files = merge.merge_files(tables.read("file"), staged, scan_id).drop("change")
    changes["file"] = merge.tombstone(files, scan_id, at, scope.distinct())
    tables.write_all(changes)
    return "delta"


def _with_dirs(dirs: DataFrame, seen: DataFrame, listed: DataFrame, scan_id: int) -> DataFrame:
    """``dirs`` with the directories that listings showed: new ones added, known ones alive again."""
    both = dirs.alias("o").join(seen.alias("n"), F.col("o.id") == F.col("n.id"), "full_outer")
    both = both.join(listed.select(F.col("id").alias("_listed")), F.col("_listed") == F.col("o.id"), "left")
    shown, known = F.col("n.id").isNotNull(), (F.col("n.id").isNotNull() | F.col("_listed").isNotNull())
    out = []
    for c in dirs.columns:
        e = F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in seen.columns else F.col(f"o.{c}")
        if c == "vanished_at":
            e = F.when(~shown, F.col("o.vanished_at"))
        elif c == "last_seen_scan":
            e = F.when(known, F.lit(scan_id).cast("long")).otherwise(F.col("o.last_seen_scan"))
        out.append(e.cast(dirs.schema[c].dataType).alias(c))
    return both.select(*out)


def follow(records: DataFrame, tables: merge.Snapshots, relist: Callable[[DataFrame], DataFrame | Listing], checkpoint: str, first_scan: int = 1, on_full: Callable[[], None] | None = None) -> StreamingQuery:
    """Run the delta on every micro-batch until the journal is read; the cursor moves only after a batch is merged.

    A batch that asks for a full scan gets it from ``on_full``. Without one the stream fails, and
    its cursor stays before that batch, so no record is lost.
    """

    def batch(df: DataFrame, n: int) -> None:
        if apply_delta(tables, df, relist, first_scan + n, f"scan {first_scan + n}") == "full":
            if on_full is None:
                raise NeedsFullScan(f"batch {n} changes most directories")
            on_full()

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Fixed value: records after which a scan's progress is stored.
RECORDS_PER_BATCH = 50_000


def follow_all(spark: SparkSession, path: str, tables: merge.Snapshots, relist: Callable[[DataFrame], DataFrame | Listing], checkpoint: str, starting_usn: int | None = None, records_per_batch: int = RECORDS_PER_BATCH, first_scan: int = 1, on_full: Callable[[], None] | None = None) -> int:
    """``follow`` in batches of at most ``records_per_batch`` until a query finds nothing more; how many it took."""
    batches = 0
    while True:
        query = follow(journal_stream(spark, path, starting_usn, records_per_batch), tables, relist, checkpoint, first_scan, on_full)
        query.awaitTermination()
        done = {p["batchId"] for p in query.recentProgress if p["sources"] and p["sources"][0]["startOffset"] != p["sources"][0]["endOffset"]}
        if not done:
            return batches
        batches += len(done)


def live_tree(records: DataFrame) -> DataFrame:
    """Streaming last record per file number, in update mode."""
    last = F.max_by(F.struct("parent_frn", "name", "attributes", "reason"), "usn").alias("r")
    return records.groupBy("frn").agg(last, F.max("usn").alias("usn")).select("frn", "usn", "r.*")
