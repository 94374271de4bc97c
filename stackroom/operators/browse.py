"""Listings, searches and small texts that a person looks at."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackroom.schema import live

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def like(column: Column, pattern: str) -> Column:
    """LIKE with ``%`` and ``_`` that folds ASCII case only and knows no escape."""
    parts = {"%": ".*", "_": "."}
    body = "".join(parts.get(c) or re.escape(c) for c in pattern.translate(str.maketrans(UPPER, LOWER)))
    return ascii_lower(column).rlike(f"(?s)^{body}$")


def find_like(files: DataFrame, pattern: str, after: int | None = None, limit: int = 50) -> DataFrame:
    """Live files whose name matches, by id, after a given id."""
    rows = live(files).where(like(F.col("name"), pattern))
    return (rows if after is None else rows.where(F.col("id") > after)).orderBy("id").limit(limit)


def _plain_letters() -> tuple[str, str]:
    """Composed Latin letters, lower-case, and what is left of each without its marks."""
    found = {}
    for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))):
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(bare) == 1 and bare != c and c == c.lower():
            found[c] = bare
    return "".join(found), "".join(found.values())


MARKED, BARE = _plain_letters()


def folded(column: Column) -> Column:
    """Lower case without diacritics, whether a letter is composed with them or followed by them."""
    return F.translate(F.regexp_replace(F.lower(column), r"\p{Mn}+", ""), MARKED, BARE)


def tokens(column: Column) -> Column:
    """Words of a name: letters and digits, cut at everything else, the underscore too."""
    return F.filter(F.split(folded(column), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def search(files: DataFrame, dirs: DataFrame, query: str, after: int | None = None, limit: int = 50) -> DataFrame:
    """Live files of which every query word begins some word of the name, or every one some word of its folder's name."""
    spark = files.sparkSession
    words = spark.createDataFrame([(query,)], "q string").select(tokens(F.col("q"))).first()[0]
    if not words:
        return files.limit(0)

    def hit(column: str) -> Column:
        # Names without the words anywhere go first; the others are cut into words once.
        anywhere = reduce(and_, [folded(F.col(column)).contains(w) for w in words])
        every = F.transform(F.array(tokens(F.col(column))), lambda ts: F.forall(F.array(*map(F.lit, words)), lambda w: F.exists(ts, lambda t: t.startswith(w))))
        return anywhere & F.get(every, F.lit(0))

    folders = live(dirs).where(hit("name")).select(F.col("id").alias("dir_id"), F.lit(True).alias("_folder"))
    rows = live(files).join(folders, "dir_id", "left").where(hit("name") | F.col("_folder")).drop("_folder")
    return (rows if after is None else rows.where(F.col("id") > after)).orderBy("id").limit(limit)


def inventory(volumes: DataFrame, drives: DataFrame, files: DataFrame, scans: DataFrame) -> DataFrame:
    """Each volume with its drive, live files and bytes, and last finished scan; facts are summed before the joins."""
    held = live(files).groupBy(F.col("volume_id").alias("id")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    done = last_scan(scans, "volume_id").withColumnRenamed("volume_id", "id")
    d = drives.select(F.col("id").alias("drive_id"), "serial", "model")
    rows = volumes.join(held, "id", "left").join(d, "drive_id", "left").join(done, "id", "left")
    return rows.withColumn("files", F.coalesce("files", F.lit(0))).withColumn("bytes", F.coalesce("bytes", F.lit(0)))


def last_scan(scans: DataFrame, key: str) -> DataFrame:
    """Last finished scan a volume or root."""
    return scans.where("status = 'done'").groupBy(key).agg(F.max("finished_at").alias("last_scan"))


def drive_names(drives: DataFrame, volumes: DataFrame) -> DataFrame:
    """``id, name``: nickname, else model, else the label of its freest volume; clashes get a drive letter, serial tail or id."""
    best = Window.partitionBy("drive_id").orderBy(F.coalesce("free_bytes", F.lit(-1)).desc(), "id")
    vols = volumes.where("drive_id IS NOT NULL")
    label = vols.where("label <> ''").withColumn("_n", F.row_number().over(best)).where("_n = 1").select(F.col("drive_id").alias("id"), F.col("label").alias("_label"))
    letter = vols.where("last_letter <> ''").withColumn("_n", F.row_number().over(best)).where("_n = 1").select(F.col("drive_id").alias("id"), F.concat(F.regexp_replace("last_letter", r"[:\\]+$", ""), F.lit(":")).alias("_letter"))
    base = F.coalesce(F.nullif(F.trim("nickname"), F.lit("")), F.col("_label"), F.nullif(F.trim("model"), F.lit("")), F.lit("drive"))
    rows = drives.join(label, "id", "left").join(letter, "id", "left").withColumn("_base", base).withColumn("_serial", F.trim(F.coalesce("serial", F.lit(""))))
    clash = Window.partitionBy(F.lower("_base"))
    tail = Window.partitionBy(F.lower("_base"), F.substring("_serial", -4, 4))
    rows = rows.withColumn("_n", F.count("*").over(clash)).withColumn("_letters", F.size(F.collect_set("_letter").over(clash))).withColumn("_tails", F.count("*").over(tail))
    tag = F.when(F.col("_letters") == F.col("_n"), F.col("_letter")).when((F.length("_serial") >= 4) & (F.col("_tails") == 1), F.concat(F.lit("…"), F.substring("_serial", -4, 4))).otherwise(F.concat(F.lit("#"), F.col("id").cast("string")))
    return rows.select("id", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat(F.col("_base"), F.lit(" ("), tag, F.lit(")"))).alias("name"))


def staleness(seconds: Column) -> Column:
    """How long ago, in words."""
    s = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} ago"))
    minutes, hours, days = F.floor(seconds / 60), F.floor(seconds / 3600), F.floor(seconds / 86400)
    return F.when(seconds.isNull(), "never").when(minutes < 1, "just now").when(minutes < 90, s(minutes, "minutes")).when(hours < 36, s(hours, "hours")).when(days < 60, s(days, "days")).otherwise(s(F.floor(days / 30), "months"))


def human_bytes(n: Column) -> Column:
    """Bytes with a binary unit."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), 1):
        out = F.when(n >= 1024**k, F.concat(F.format_number(n / float(1024**k), 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def enumeration_decision(v: DataFrame) -> DataFrame:
    """``method, reason`` for each volume: anything that can't prove the cursor valid is a full pass.

    Columns: supports_usn, elevated, journal_id, lowest_valid_usn, next_usn (null: no journal
    could be read), cursor_id, cursor_usn.
    """
    unread, unset = F.col("journal_id").isNull(), F.col("cursor_id").isNull() | F.col("cursor_usn").isNull()
    ladder = [
        (~F.col("supports_usn"), "walk", "no change journal"),
        (~F.col("elevated"), "walk", "journal needs administrator rights"),
        (unread, "usn-full", "journal could not be queried"),
        (unset, "usn-full", "first scan"),
        (F.col("cursor_id") != F.col("journal_id"), "usn-full", "journal was recreated"),
        (F.col("cursor_usn") < F.col("lowest_valid_usn"), "usn-full", "records were purged"),
        (F.col("cursor_usn") > F.col("next_usn"), "usn-full", "journal is older than the cursor"),
        (F.col("cursor_usn") == F.col("next_usn"), "usn-delta", "no activity"),
    ]
    method, reason = F.lit("usn-delta"), F.lit("changes since the last scan")
    for when, m, r in reversed(ladder):
        method, reason = F.when(when, m).otherwise(method), F.when(when, r).otherwise(reason)
    return v.withColumn("method", method).withColumn("reason", reason)
