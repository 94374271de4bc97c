"""How likely drives fail, and sets of drives together; what that costs in bytes a year.

Every factor is 1 where its input is unknown, so a missing fact never lowers a rate.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base rates, factors by half-open ranges [from, to), and correlation multipliers.
PROVISIONAL = {"hdd": 0.015, "ssd": 0.01, "unknown": 0.015}
MAX_AFR = 0.95
AGE_YEARS = {
    "hdd": [(0, 1, 1.3), (1, 3, 0.9), (3, 4, 1.0), (4, 5, 1.3), (5, 6, 1.7), (6, None, 2.2)],
    "ssd": [(0, 1, 1.2), (1, 5, 1.0), (5, None, 1.3)],
    "unknown": [(0, 1, 1.3), (1, 3, 0.9), (3, 4, 1.0), (4, 5, 1.3), (5, 6, 1.7), (6, None, 2.2)],
}
HDD_HOURS = [(0, 20_000, 1.0), (20_000, 35_000, 1.2), (35_000, None, 1.5)]
SSD_LIFE = [(0, 10, 3.0), (10, 50, 1.5), (50, None, 1.0)]
SMART = {"pending": 10.0, "uncorrectable": 5.0, "reallocated": 2.0, "reallocated_many": 4.0, "reallocated_many_from": 100, "crc": 1.2}
BUS = {"usb": 1.2}
SAME_BATCH, SAME_ZONE = 5.0, 10.0
CONFIDENCE = ("unknown", "estimated", "measured")
BASES = ("fleet", "rated", "provisional")
VENDORS = ("HGST", "HITACHI", "WDC", "WD", "TOSHIBA", "SEAGATE", "SAMSUNG", "CT")
MIN_MATCH = 6


@dataclass(frozen=True)
class RateTable:
    """Failure rates by model family and by media class, from one source."""

    source: str
    version: str
    basis: str = "provisional"
    classes: dict[str, float] = field(default_factory=dict)
    models: tuple[tuple[str, float], ...] = ()


DEFAULT_TABLES = (RateTable("provisional", "1", "provisional", PROVISIONAL),)


def ranked(tables) -> list[RateTable]:
    """Best basis first, then the newest version; a later table of one source and version replaces an earlier one."""
    named = {(t.source, t.version): t for t in tables}
    newest = sorted(named.values(), key=lambda t: t.version, reverse=True)
    return sorted(newest, key=lambda t: BASES.index(t.basis) if t.basis in BASES else len(BASES))


def in_ranges(value: Column, ranges) -> Column:
    """The factor of the range that holds ``value``; 1 where it is null or in none."""
    out = F.lit(1.0)
    for low, high, factor in reversed(ranges):
        inside = value >= low if high is None else (value >= low) & (value < high)
        out = F.when(inside, factor).otherwise(out)
    return out


def media_kind(media: Column) -> Column:
    return F.when(media.isin("hdd", "ssd"), media).otherwise("unknown")


def age_years(purchase_date: Column, today: Column) -> Column:
    """Years since purchase, never negative; a month alone counts as its 15th."""
    full = F.when(F.length(purchase_date) == 7, F.concat(purchase_date, F.lit("-15"))).otherwise(F.substring(purchase_date, 1, 10))
    return F.greatest(F.lit(0.0), F.date_diff(today, F.to_date(full)) / 365.25)


def age_factor(years: Column, media: Column) -> Column:
    out = in_ranges(years, AGE_YEARS["unknown"])
    for kind in ("hdd", "ssd"):
        out = F.when(media == kind, in_ranges(years, AGE_YEARS[kind])).otherwise(out)
    return F.when(years.isNull(), 1.0).otherwise(out)


def duty_factor(media: Column, hours: Column, life: Column) -> Column:
    return F.when((media == "hdd") & hours.isNotNull(), in_ranges(hours, HDD_HOURS)).when((media == "ssd") & life.isNotNull(), in_ranges(life, SSD_LIFE)).otherwise(1.0)


def smart_factor(reallocated: Column, pending: Column, uncorrectable: Column, crc: Column) -> Column:
    """The worst sector sign counts; cable errors add a little."""
    many = F.when(reallocated >= SMART["reallocated_many_from"], SMART["reallocated_many"]).when(reallocated > 0, SMART["reallocated"]).otherwise(1.0)
    worst = F.greatest(F.lit(1.0), F.when(pending > 0, SMART["pending"]), F.when(uncorrectable > 0, SMART["uncorrectable"]), many)
    return worst * F.when(crc > 0, SMART["crc"]).otherwise(1.0)


def bus_factor(bus: Column) -> Column:
    out = F.lit(1.0)
    for name, factor in BUS.items():
        out = F.when(bus == name, factor).otherwise(out)
    return out


def normal_model(model: Column) -> Column:
    """Letters and digits, upper case, without one vendor's name in front if enough is left."""
    value = F.regexp_replace(F.upper(F.coalesce(model, F.lit(""))), "[^A-Z0-9]", "")
    out = value
    for vendor in reversed(VENDORS):
        rest = F.length(value) - len(vendor) >= MIN_MATCH
        out = F.when(value.startswith(vendor) & rest, F.substring(value, len(vendor) + 1, 256)).otherwise(out)
    return out


def base_rates(drives: DataFrame, tables=DEFAULT_TABLES) -> DataFrame:
    """``drives`` with ``base_afr`` and ``matched`` (model, class or fallback): the best table's longest family, else the class."""
    spark, order = drives.sparkSession, ranked(tables)
    families = [(i, m, len(m), float(a)) for i, t in enumerate(order) for m, a in t.models if len(m) >= MIN_MATCH]
    classes: dict[str, float] = {}
    for t in reversed(order):
        classes |= t.classes
    kind = media_kind(F.col("media"))
    by_class = F.coalesce(*[F.when(kind == k, float(v)) for k, v in classes.items()]) if classes else F.lit(None).cast("double")
    rows = drives.withColumn("_model", normal_model(F.col("model")))
    # Families are the models of shipped or imported tables: some thousands of rows.
    fam = F.broadcast(spark.createDataFrame(families, "_rank int, _family string, _len int, _afr double"))
    models = rows.select("_model").distinct().where(F.length("_model") >= MIN_MATCH)
    best = models.join(fam, F.col("_model").startswith(F.col("_family"))).groupBy("_model").agg(F.min_by("_afr", F.struct("_rank", -F.col("_len"))).alias("_model_afr"))
    rows = rows.join(best, "_model", "left").withColumn("matched", F.when(F.col("_model_afr").isNotNull(), "model").when(kind != "unknown", "class").otherwise("fallback"))
    return rows.withColumn("base_afr", F.coalesce("_model_afr", by_class)).drop("_model", "_model_afr")


def drive_risk(drives: DataFrame, health: DataFrame, today: str, tables=DEFAULT_TABLES) -> DataFrame:
    """Annual failure rate of each drive with its factors, confidence and what was assumed.

    ``health`` has the latest reading a drive, keyed by ``drive_id``; only a measured one counts.
    """
    read = health.where("confidence = 'measured'").select(F.col("drive_id").alias("id"), "power_on_hours", "wear_leveling", "reallocated", "pending", "uncorrectable", "crc_errors", F.lit(True).alias("measured"))
    d = base_rates(drives, tables).join(read, "id", "left").withColumn("measured", F.coalesce("measured", F.lit(False)))
    d = d.withColumn("years", age_years(F.col("purchase_date"), F.to_date(F.lit(today))))
    d = d.withColumn("age_factor", age_factor(F.col("years"), F.col("media"))).withColumn("duty_factor", duty_factor(F.col("media"), F.col("power_on_hours"), F.col("wear_leveling")))
    d = d.withColumn("smart_factor", smart_factor(F.col("reallocated"), F.col("pending"), F.col("uncorrectable"), F.col("crc_errors"))).withColumn("bus_factor", bus_factor(F.col("bus")))
    afr = F.col("base_afr") * F.col("age_factor") * F.col("duty_factor") * F.col("smart_factor") * F.col("bus_factor")
    confidence = F.when(F.col("measured"), "measured").when((F.col("matched") == "fallback") & F.col("years").isNull(), "unknown").otherwise("estimated")
    notes = F.array_compact(F.array(F.when(F.col("matched") != "model", "no rate for this model"), F.when(F.col("years").isNull(), "purchase date unknown"), F.when(~F.col("measured"), "no health reading")))
    return d.withColumn("afr", F.least(afr, F.lit(MAX_AFR))).withColumn("confidence", confidence).withColumn("assumptions", notes)


def batch_key(drives: DataFrame) -> Column:
    """The user's key, else maker, model and month of purchase together, else unknown."""
    tidy = lambda c: F.lower(F.trim(F.regexp_replace(F.col(c), r"\s+", " ")))
    known = (F.length(tidy("manufacturer")) > 0) & (F.length(tidy("model")) > 0) & F.col("purchase_date").isNotNull()
    derived = F.when(known, F.concat_ws("|", tidy("manufacturer"), tidy("model"), F.substring("purchase_date", 1, 7)))
    return F.coalesce(F.nullif(F.trim("batch_key"), F.lit("")), derived)


def drive_sets(items: DataFrame) -> DataFrame:
    """``drive_ids, items, bytes``: contents grouped by the set of identified drives that hold them.

    ``items`` has one row per path: content_id, size_bytes, drive_id (null: unverified).
    """
    held = items.groupBy("content_id").agg(F.max("size_bytes").alias("size_bytes"), F.array_sort(F.collect_set("drive_id")).alias("drive_ids"))
    return held.groupBy("drive_ids").agg(F.count("*").alias("items"), F.sum("size_bytes").alias("bytes"))


def set_risk(sets: DataFrame, risks: DataFrame, unverified_afr: float, unverified_confidence: str = "unknown") -> DataFrame:
    """``sets`` with correlation, probability of losing all copies in a year, and the weakest confidence.

    ``risks`` has one row per drive: id, afr, confidence, batch, disaster_zone. Drives of one
    batch count together; so do drives whose zone isn't recorded. An empty set is one unknown drive.
    """
    ordinal = F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("confidence"))
    facts = risks.select(F.col("id").alias("_id"), "afr", "batch", "disaster_zone", ordinal.alias("_ord"))
    keys = sets.select("drive_ids").distinct()
    per = keys.select("drive_ids", F.explode("drive_ids").alias("_id")).join(facts, "_id")
    rows = per.groupBy("drive_ids").agg(F.sort_array(F.collect_list(F.struct("_id", "afr", "batch", "disaster_zone", "_ord"))).alias("ds"))

    def excess(values: Column) -> Column:
        """Members beyond the first of each group."""
        return F.size(values) - F.size(F.array_distinct(values))

    batches = F.filter(F.transform("ds", lambda d: d["batch"]), lambda b: b.isNotNull())
    zones = F.transform("ds", lambda d: F.coalesce(d["disaster_zone"], F.lit("")))
    rows = rows.withColumn("correlation", F.pow(F.lit(SAME_BATCH), excess(batches)) * F.pow(F.lit(SAME_ZONE), excess(zones)))
    product = F.aggregate("ds", F.lit(1.0), lambda a, d: a * d["afr"])
    rows = rows.select("drive_ids", "correlation", F.least(product * F.col("correlation"), F.array_min(F.transform("ds", lambda d: d["afr"]))).alias("p_loss"), F.array_min(F.transform("ds", lambda d: d["_ord"])).alias("_c"))
    out = sets.join(rows, "drive_ids", "left")
    empty = F.size("drive_ids") == 0
    name = F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("_c").cast("int"))
    return out.withColumn("p_loss", F.when(empty, unverified_afr).otherwise(F.col("p_loss"))).withColumn("correlation", F.when(empty, 1.0).otherwise(F.col("correlation"))).withColumn("confidence", F.when(empty, unverified_confidence).otherwise(name)).drop("_c")


def expected_loss(sets: DataFrame) -> DataFrame:
    """Bytes expected lost a year, and the weakest confidence of any set that holds bytes."""
    ordinal = F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("confidence"))
    return sets.agg(F.sum(F.col("bytes") * F.col("p_loss")).alias("expected_bytes"), F.min_by("confidence", F.when(F.col("bytes") > 0, ordinal)).alias("confidence"))


def fleet_rates(stats: DataFrame, min_days: int = 36_500) -> DataFrame:
    """``model, days, failures, afr`` from daily drive statistics; models with few drive-days are left out."""
    failed = F.trim(F.col("failure").cast("string")) == "1"
    rows = stats.groupBy(F.trim("model").alias("model")).agg(F.count("*").alias("days"), F.count_if(failed).alias("failures"))
    return rows.where(F.col("days") >= min_days).withColumn("afr", F.bround(F.col("failures") / (F.col("days") / 365.0), 6))


def health_verdict(latest: DataFrame) -> DataFrame:
    """A word for each drive's latest reading."""
    warning = (F.col("pending") > 0) | (F.col("uncorrectable") > 0) | (F.col("reallocated") > 0)
    return latest.withColumn("verdict", F.when(F.col("confidence").isNull(), "not read").when(F.col("confidence") != "measured", "unknown").when(~F.col("passed"), "FAILING").when(warning, "warning").otherwise("OK"))


def ranked_exposure(items: DataFrame, sets: DataFrame) -> DataFrame:
    """Items with their expected loss, the largest first by sorting on it. ``items``: content_id, size_bytes, drive_ids."""
    return items.join(sets.select("drive_ids", "p_loss"), "drive_ids").withColumn("expected", F.col("size_bytes") * F.col("p_loss"))
