"""Stewardship scorecards: evidence per collection, and the verdicts that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def evidence(items: DataFrame, held: DataFrame, drives: DataFrame) -> DataFrame:
    """One row per collection.

    ``items``: collection, item, hashed, verified, ever_verified, on_unverified (a copy lies on
    a volume of unknown drive). ``held``: item, drive_id, one row per proven drive. ``drives``:
    id, batch (null: counts as itself), disaster_zone, purchase_date.
    """
    facts = drives.select(F.col("id").alias("drive_id"), F.coalesce("batch", F.concat(F.lit("drive "), F.col("id").cast("string"))).alias("b"), F.nullif("disaster_zone", F.lit("")).alias("z"), F.col("purchase_date").isNotNull().alias("dated"))
    at = held.join(facts, "drive_id")
    per = at.groupBy("item").agg(F.count_distinct("drive_id").alias("copies"), F.count_distinct("z").alias("zones"), F.count_distinct("b").alias("batches"))
    rows = items.join(per, "item", "left")
    copies = F.greatest(F.coalesce("copies", F.lit(0)), F.lit(1))
    zones, batches = F.coalesce("zones", F.lit(0)), F.coalesce("batches", F.lit(0))
    sums = rows.groupBy("collection").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("on_unverified") & F.col("copies").isNull()).alias("unidentified"),
        F.count_if(copies >= 2).alias("two_copies"),
        F.count_if((copies >= 3) & (zones >= 2)).alias("three_copies"),
        F.count_if(zones >= 2).alias("two_zones"),
        F.count_if(zones >= 3).alias("three_zones"),
        F.count_if(batches >= 2).alias("two_batches"),
        F.count_if("verified").alias("verified"),
        F.count_if("hashed").alias("hashed"),
        F.max("ever_verified").alias("ever_verified"),
    )
    holding = items.select("collection", "item").join(at, "item").select("collection", "drive_id", "dated").distinct()
    holding = holding.groupBy("collection").agg(F.count_if("dated").alias("dated_drives"), F.count("*").alias("holding_drives"))
    zero = {"dated_drives": 0, "holding_drives": 0}
    return sums.join(holding, "collection", "left").fillna(zero)


def share(k: Column, n: Column) -> Column:
    """All, some or none of ``n``; nothing to look at fails."""
    return F.when(n == 0, "fail").when(k == n, "pass").when(k >= 1, "partial").otherwise("fail")


def _long(rows: DataFrame, results: dict[str, Column | str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(k).alias("criterion"), (F.lit(v) if isinstance(v, str) else v).alias("result")) for k, v in results.items()])
    return rows.select("collection", F.explode(pairs).alias("r")).select("collection", "r.criterion", "r.result")


def _meta(missing: Column) -> Column:
    return F.when(missing == 0, "pass").when(missing <= 3, "partial").otherwise("fail")


def fair_card(rows: DataFrame) -> DataFrame:
    """``collection, criterion, result``, 15 a collection.

    ``rows``: evidence with has_pid, missing (of 7 descriptive fields), has_license, relations.
    """
    n, yes = F.col("n"), lambda c: F.when(F.col(c), "pass").otherwise("fail")
    provenance = F.when((n > 0) & (F.col("hashed") == n) & (F.col("verified") == n), "pass").when(F.col("ever_verified") | (F.col("hashed") > 0), "partial").otherwise("fail")
    return _long(rows, {
        "F1": yes("has_pid"), "F2": _meta(F.col("missing")), "F3": "planned", "F4": "partial",
        "A1": share(n - F.col("unidentified"), n), "A1.1": "judgement", "A1.2": "judgement", "A2": "pass",
        "I1": "planned", "I2": "planned", "I3": F.when(F.col("relations") > 0, "pass").otherwise("fail"),
        "R1": _meta(F.col("missing")), "R1.1": yes("has_license"), "R1.2": provenance, "R1.3": "planned",
    })


def fair_score(card: DataFrame) -> DataFrame:
    """Mean over what was assessed; a partial counts half."""
    value = F.when(F.col("result") == "pass", 1.0).when(F.col("result") == "partial", 0.5).when(F.col("result") == "fail", 0.0)
    return card.groupBy("collection").agg(F.avg(value).alias("score"))


def ndsa_card(rows: DataFrame) -> DataFrame:
    """``collection, criterion, result``, 37 a collection."""
    n = F.col("n")
    part = lambda c: share(F.col(c), n)
    ever = F.when(F.col("ever_verified"), "pass").otherwise("fail")
    any_hash = F.when(F.col("hashed") > 0, "pass").otherwise("fail")
    meta = _meta(F.col("missing"))
    return _long(rows, {
        "storage-1a": part("two_copies"), "storage-1b": share(n - F.col("unidentified"), n), "storage-1c": "judgement",
        "storage-2a": part("three_copies"), "storage-2b": "judgement", "storage-3a": part("two_zones"),
        "storage-3b": share(F.col("dated_drives"), F.col("holding_drives")),
        "storage-4a": part("three_zones"), "storage-4b": part("two_batches"), "storage-4c": "planned",
        "integrity-1a": "judgement", "integrity-1b": part("hashed"), "integrity-1c": "judgement", "integrity-2a": "judgement",
        "integrity-2b": "pass", "integrity-2c": "pass", "integrity-3a": part("verified"), "integrity-3b": ever, "integrity-3c": any_hash,
        "integrity-4a": "judgement", "integrity-4b": "planned",
        "control-1a": "judgement", "control-2a": "judgement", "control-3a": "judgement", "control-4a": "judgement",
        "metadata-1a": "pass", "metadata-1b": "pass", "metadata-2a": meta, "metadata-3a": "judgement",
        "metadata-3b": F.when(F.col("missing") == 0, "pass").otherwise("fail"), "metadata-4a": "pass", "metadata-4b": "planned",
        "content-1a": "planned", "content-2a": "planned", "content-2b": "judgement", "content-3a": "planned", "content-4a": "judgement",
    })


def ndsa_levels(card: DataFrame) -> DataFrame:
    """``collection, area, level``: the highest level with no partial or fail at or below it; null where nothing was assessed.

    A level without any assessed statement passes through.
    """
    rows = card.select("collection", F.split_part("criterion", F.lit("-"), F.lit(1)).alias("area"), F.substring(F.split_part("criterion", F.lit("-"), F.lit(2)), 1, 1).cast("int").alias("level"), "result")
    bad = F.min(F.when(F.col("result").isin("partial", "fail"), F.col("level")))
    out = rows.groupBy("collection", "area").agg(bad.alias("bad"), F.count_if(F.col("result").isin("pass", "partial", "fail")).alias("assessed"))
    return out.select("collection", "area", F.when(F.col("assessed") > 0, F.coalesce(F.col("bad") - 1, F.lit(4))).alias("level"))


def latest_check(fixity: DataFrame, today: str, days: int = 365) -> DataFrame:
    """``content_id, verified, ever_verified``: whether a good check lies within so many days."""
    ok = fixity.where("result = 'ok'").groupBy("content_id").agg(F.max("checked_at").alias("t"))
    return ok.select("content_id", (F.date_diff(F.to_date(F.lit(today)), F.to_date("t")) <= days).alias("verified"), F.lit(True).alias("ever_verified"))
