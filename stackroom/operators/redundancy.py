"""Copies are counted over distinct physical drives, never over paths.

A volume with no known drive proves no drive, but is a possible drive of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackroom.schema import live


def placed(files: DataFrame, volumes: DataFrame) -> DataFrame:
    """Live files with the drive of their volume; the volume dimension is left to Spark to broadcast."""
    return live(files).join(volumes.select(F.col("id").alias("volume_id"), "drive_id"), "volume_id")


def content_groups(files: DataFrame, volumes: DataFrame) -> DataFrame:
    """One row per identified content: paths, proven and possible drives, physical copies, reclaimable bytes.

    Drives are gathered as sets, which the number of drives bounds; physical copies are the one
    distinct count, so that rows are not multiplied by distinct columns before the shuffle.
    """
    possible = F.coalesce(F.col("drive_id"), -F.col("volume_id"))
    physical = F.concat_ws(":", F.col("volume_id").cast("string"), F.coalesce(F.col("frn").cast("string"), F.concat(F.lit("f"), F.col("id").cast("string"))))
    groups = (
        placed(files, volumes)
        .where("content_id IS NOT NULL")
        .groupBy("content_id")
        .agg(
            F.max("size_bytes").alias("size_bytes"),
            F.count("*").alias("paths"),
            F.greatest(F.size(F.collect_set("drive_id")), F.lit(1)).cast("long").alias("drives"),
            F.size(F.collect_set(possible)).cast("long").alias("drives_possible"),
            F.count_distinct(physical).alias("physical_copies"),
        )
    )
    return groups.withColumn("reclaimable_bytes", reclaimable())


def reclaimable():
    """Bytes of copies beyond one on each possible drive."""
    return F.greatest(F.lit(0), F.col("physical_copies") - F.col("drives_possible")) * F.col("size_bytes")


def single_copies(files: DataFrame, volumes: DataFrame) -> DataFrame:
    """Live files without identity whose size no other live file has, whatever its read state; empty files aside."""
    alone = live(files).groupBy("size_bytes").agg(F.count("*").alias("n")).where("n = 1").select("size_bytes")
    return placed(files, volumes).where("content_id IS NULL AND size_bytes > 0").join(alone, "size_bytes", "left_semi")


def duplicate_groups(groups: DataFrame) -> DataFrame:
    return groups.where("paths > 1")


def reclamation(groups: DataFrame) -> DataFrame:
    return duplicate_groups(groups).where("reclaimable_bytes > 0")


def under_protected(groups: DataFrame, singles: DataFrame, min_copies: int = 2) -> DataFrame:
    """Items with fewer than ``min_copies`` proven drives; single copies count when more than one is asked for."""
    low = groups.where(F.col("drives") < min_copies).select(F.col("content_id"), F.lit(None).cast("long").alias("file_id"), "size_bytes", "paths", "drives")
    if min_copies <= 1:
        return low
    one = F.lit(1).cast("long")
    return low.unionByName(singles.select(F.lit(None).cast("string").alias("content_id"), F.col("id").alias("file_id"), "size_bytes", one.alias("paths"), one.alias("drives")))


def unhashed(files: DataFrame) -> DataFrame:
    """Live files that could be copies of something: no identity, and a size that others share."""
    rows = live(files)
    alone = rows.groupBy("size_bytes").agg(F.count("*").alias("n")).where("n = 1").select("size_bytes")
    return rows.where("content_id IS NULL").join(alone, "size_bytes", "left_anti")


def summary(files: DataFrame, groups: DataFrame, singles: DataFrame, min_copies: int = 2) -> DataFrame:
    """The headline numbers, one row. ``groups`` is read three times: cache it, or pass a written table."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    g = groups.agg(
        F.count("*").alias("identified"),
        F.count_if(F.col("paths") > 1).alias("duplicate_groups"),
        zero(F.sum(F.when(F.col("paths") > 1, F.col("paths") - 1))).alias("extra_paths"),
        zero(F.sum("size_bytes")).alias("identified_bytes"),
        F.count_if(F.col("reclaimable_bytes") > 0).alias("reclamation_groups"),
        zero(F.sum("reclaimable_bytes")).alias("reclaimable_bytes"),
        F.count_if(F.col("drives_possible") != F.col("drives")).alias("identity_uncertain"),
    )
    s = singles.agg(F.count("*").alias("single_copy_files"), zero(F.sum("size_bytes")).alias("single_copy_bytes"))
    u = under_protected(groups, singles, min_copies).agg(F.count("*").alias("under_protected"), zero(F.sum("size_bytes")).alias("under_protected_bytes"))
    n = unhashed(files).agg(F.count("*").alias("unhashed_files"))
    return g.crossJoin(s).crossJoin(u).crossJoin(n)  # one row each


def hash_candidates(files: DataFrame) -> DataFrame:
    """Live readable files without identity whose size another live readable file has; laid out for reading."""
    ok = live(files).where("read_state = 'ok' AND size_bytes > 0")
    shared = ok.groupBy("size_bytes").agg(F.count("*").alias("n")).where("n > 1").select("size_bytes")
    return ok.where("content_id IS NULL").join(shared, "size_bytes", "left_semi")


def reading_order(candidates: DataFrame) -> DataFrame:
    """Each volume's candidates in disk order, one range of volumes a partition."""
    return candidates.repartitionByRange("volume_id").sortWithinPartitions("volume_id", F.col("frn").isNull(), "frn", "dir_id", "name")


def identified(files: DataFrame, digest: str) -> DataFrame:
    """``files`` with ``content_id`` set to ``digest`` exactly where a hash pass would read the file."""
    ok = F.col("vanished_at").isNull() & (F.col("read_state") == "ok") & (F.col("size_bytes") > 0)
    shared = files.where(ok).groupBy("size_bytes").agg(F.count("*").alias("_n")).where("_n > 1")
    return files.join(shared, "size_bytes", "left").withColumn("content_id", F.when(ok & F.col("_n").isNotNull(), F.col(digest))).drop("_n")


def counts(files: DataFrame, dirs: DataFrame, volumes: DataFrame, drives: DataFrame) -> DataFrame:
    """Catalog totals in one row."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    f = files.agg(
        F.count_if(F.col("vanished_at").isNull()).alias("files"),
        zero(F.sum(F.when(F.col("vanished_at").isNull(), F.col("size_bytes")))).alias("bytes"),
        F.count_if(F.col("vanished_at").isNotNull()).alias("vanished_files"),
        F.count_if(F.col("vanished_at").isNull() & F.col("content_id").isNotNull()).alias("identified_files"),
        F.count_if(F.col("vanished_at").isNull() & (F.col("read_state") != "ok")).alias("unread_files"),
    )
    return f.crossJoin(dirs.agg(F.count_if(F.col("vanished_at").isNull()).alias("dirs"))).crossJoin(volumes.agg(F.count("*").alias("volumes"))).crossJoin(drives.agg(F.count("*").alias("drives")))


def identity_coverage(files: DataFrame, singles: DataFrame) -> DataFrame:
    """Share of live files whose copies are known: identified or alone of their size; at most 1."""
    f = live(files).agg(F.count("*").alias("files"), F.count_if(F.col("content_id").isNotNull()).alias("identified"))
    s = singles.agg(F.count("*").alias("single"))
    share = F.least(F.lit(1.0), (F.col("identified") + F.col("single")) / F.col("files"))
    return f.crossJoin(s).withColumn("coverage", F.when(F.col("files") > 0, F.bround(share, 6)))


def incidents(fixity: DataFrame, files: DataFrame, groups: DataFrame) -> DataFrame:
    """Checks that found damage, with how many other copies the content has."""
    bad = fixity.where("result NOT IN ('ok', 'modified')")
    rows = bad.join(files.select(F.col("id").alias("file_id"), "name"), "file_id")
    others = groups.select("content_id", (F.col("paths") - 1).alias("other_copies"))
    return rows.join(others, "content_id", "left").withColumn("other_copies", F.coalesce("other_copies", F.lit(0)))


def collisions(contents: DataFrame, files: DataFrame) -> DataFrame:
    """Contents known by quick hash alone that more than one live file, or another content of equal quick hash, shares."""
    alive = live(files).where("content_id IS NOT NULL").groupBy(F.col("content_id").alias("id")).agg(F.count("*").alias("live"))
    both = contents.join(alive, "id")
    share = Window.partitionBy("size_bytes", "quick_hash")
    return both.withColumn("sharing", F.sum("live").over(share)).where("full_hash IS NULL AND sharing > 1")


def copies_elsewhere(files: DataFrame, volumes: DataFrame) -> DataFrame:
    """For each live identified file the other drives (volumes, where the drive is unknown) with its content."""
    rows = placed(files, volumes).where("content_id IS NOT NULL").withColumn("place", F.coalesce(F.col("drive_id"), -F.col("volume_id") - 1))
    # Distinct places of a content are few; files of it may be many: collect the former, join once.
    places = rows.groupBy("content_id").agg(F.array_sort(F.collect_set("place")).alias("places"))
    return rows.join(places, "content_id").withColumn("elsewhere", F.size("places") - 1)
