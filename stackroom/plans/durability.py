"""Risk, fixity and health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackroom.operators import risk, tree
from stackroom.plans import mapping as m
from stackroom.plans.catalog import query

TODAY = "2026-10-30"

RATES = (
    risk.RateTable("fleet-report", "2026Q1", "fleet", {"hdd": 0.0137}, (("ST4000VN", 0.0172), ("ST4001", 0.0211))),
    risk.RateTable("datasheet", "3", "rated", {"ssd": 0.0073}, (("ST4000VN0", 0.009), ("ST4003VN2", 0.0112))),
    *risk.DEFAULT_TABLES,
)

HEALTH_SQL = """
health AS (
  SELECT user_id + 1 AS drive_id, max(event_id) AS id, CAST(arg_max(value, event_id) * 1000 AS BIGINT) AS power_on_hours,
         arg_max(event_id % 7, event_id) AS k FROM events GROUP BY 1)"""

RISK_SQL = """
rated AS (
  SELECT d.*, upper(replace(model, '-', '')) AS nm, date_diff('day', CAST(purchase_date || '-15' AS DATE), DATE '2026-10-30') / 365.25 AS years0 FROM drives d),
based AS (
  SELECT *, greatest(years0, 0) AS years,
         CASE WHEN starts_with(nm, 'ST4000VN') THEN 0.0172 WHEN starts_with(nm, 'ST4001') THEN 0.0211 WHEN starts_with(nm, 'ST4003VN2') THEN 0.0112 END AS by_model,
         CASE WHEN media = 'hdd' THEN 0.0137 WHEN media = 'ssd' THEN 0.0073 ELSE 0.015 END AS by_class FROM rated),
risks AS (
  SELECT b.id, coalesce(by_model, by_class) AS base_afr, CASE WHEN by_model IS NOT NULL THEN 'model' WHEN media IN ('hdd', 'ssd') THEN 'class' ELSE 'fallback' END AS matched,
         CASE WHEN years IS NULL THEN 1.0
              WHEN media = 'ssd' THEN CASE WHEN years < 1 THEN 1.2 WHEN years < 5 THEN 1.0 ELSE 1.3 END
              ELSE CASE WHEN years < 1 THEN 1.3 WHEN years < 3 THEN 0.9 WHEN years < 4 THEN 1.0 WHEN years < 5 THEN 1.3 WHEN years < 6 THEN 1.7 ELSE 2.2 END END AS age_factor,
         CASE WHEN h.k < 5 AND media = 'hdd' THEN CASE WHEN power_on_hours < 20000 THEN 1.0 WHEN power_on_hours < 35000 THEN 1.2 ELSE 1.5 END ELSE 1.0 END AS duty_factor,
         CASE WHEN h.k = 0 THEN 10.0 WHEN h.k = 1 THEN 4.0 WHEN h.k = 2 THEN 2.0 * 1.2 ELSE 1.0 END AS smart_factor,
         CASE WHEN bus = 'usb' THEN 1.2 ELSE 1.0 END AS bus_factor,
         CASE WHEN h.k < 5 THEN 'measured' WHEN by_model IS NULL AND media NOT IN ('hdd', 'ssd') AND years IS NULL THEN 'unknown' ELSE 'estimated' END AS confidence,
         coalesce(batch_key, CASE WHEN purchase_date IS NOT NULL THEN lower(manufacturer) || '|' || lower(model) || '|' || purchase_date END) AS batch, disaster_zone, media, years
  FROM based b LEFT JOIN health h ON h.drive_id = b.id)"""


def _health(spark, sf_dir):
    e = m.table(spark, sf_dir, "events").select((F.col("user_id") + 1).alias("drive_id"), "event_id", "value", (F.col("event_id") % 7).alias("k"))
    r = tree.latest(e, "drive_id", "event_id")
    k = F.col("k")
    return r.select(
        "drive_id", "event_id", F.when(k < 5, "measured").otherwise("unavailable").alias("confidence"),
        F.round(F.col("value") * 1000).cast("long").alias("power_on_hours"), F.lit(None).cast("long").alias("wear_leveling"),
        F.when(k == 1, 100).when(k == 2, 3).cast("long").alias("reallocated"), F.when(k == 0, 1).cast("long").alias("pending"),
        F.lit(0).cast("long").alias("uncorrectable"), F.when(k == 2, 9).cast("long").alias("crc_errors"), (k != 3).alias("passed"),
    )


def _risks(spark, sf_dir):
    d = m.drives(spark, sf_dir)
    return risk.drive_risk(d.withColumn("batch", risk.batch_key(d)), _health(spark, sf_dir), TODAY, RATES)


@query(
    """SELECT h.drive_id, h.id AS event_id, CASE WHEN k >= 5 THEN 'unknown' WHEN k = 3 THEN 'FAILING' WHEN k < 3 THEN 'warning' ELSE 'OK' END AS verdict FROM health h""",
    HEALTH_SQL,
)
def latest_health(spark, sf_dir):
    """A24, W2, D1."""
    return risk.health_verdict(_health(spark, sf_dir)).select("drive_id", "event_id", "verdict")


@query(
    """SELECT id, matched, CAST(round(base_afr * 1e6) AS BIGINT) AS base_ppm FROM risks""",
    m.DRIVE_SQL, HEALTH_SQL, RISK_SQL,
)
def base_rate_prefix_match(spark, sf_dir):
    """R1, R2, J16, T15."""
    return risk.base_rates(m.drives(spark, sf_dir), RATES).select("id", "matched", F.round(F.col("base_afr") * 1e6).cast("long").alias("base_ppm"))


@query(
    """SELECT id, CAST(round(age_factor * 100) AS INTEGER) AS age, CAST(round(duty_factor * 100) AS INTEGER) AS duty,
              CAST(round(smart_factor * 100) AS INTEGER) AS smart, CAST(round(bus_factor * 100) AS INTEGER) AS bus, confidence,
              CAST(round(least(base_afr * age_factor * duty_factor * smart_factor * bus_factor, 0.95) * 1e9) AS BIGINT) AS afr_ppb, batch FROM risks""",
    m.DRIVE_SQL, HEALTH_SQL, RISK_SQL,
)
def drive_afr_bands(spark, sf_dir):
    """R3, R4, R5, J17, T16."""
    pct = lambda c, n: F.round(F.col(c) * 100).cast("int").alias(n)
    return _risks(spark, sf_dir).select("id", pct("age_factor", "age"), pct("duty_factor", "duty"), pct("smart_factor", "smart"), pct("bus_factor", "bus"), "confidence", F.round(F.col("afr") * 1e9).cast("long").alias("afr_ppb"), "batch")


FLEET_SQL = """
fleet AS (
  SELECT l_partkey AS content_id, CAST(round(p_retailprice * 100) AS BIGINT) AS size_bytes, CASE WHEN l_suppkey % 8 + 1 < 8 THEN l_suppkey % 8 + 1 END AS drive_id
  FROM lineitem JOIN part ON p_partkey = l_partkey),
held AS (
  SELECT content_id, max(size_bytes) AS size_bytes, coalesce(list_sort(list(DISTINCT drive_id) FILTER (drive_id IS NOT NULL)), []) AS drive_ids FROM fleet GROUP BY 1),
sets AS (SELECT drive_ids, count(*) AS items, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM held GROUP BY 1),
member AS (
  SELECT s.drive_ids, least(base_afr * age_factor * duty_factor * smart_factor * bus_factor, 0.95) AS afr, batch, coalesce(disaster_zone, '') AS zone,
         list_position(['unknown', 'estimated', 'measured'], confidence) AS o
  FROM (SELECT drive_ids, unnest(drive_ids) AS d FROM sets) s JOIN risks r ON r.id = s.d),
lost AS (
  SELECT drive_ids, power(5.0, count(batch) - count(DISTINCT batch)) * power(10.0, count(*) - count(DISTINCT zone)) AS correlation,
         least(product(afr) * power(5.0, count(batch) - count(DISTINCT batch)) * power(10.0, count(*) - count(DISTINCT zone)), min(afr)) AS p_loss, min(o) AS o
  FROM member GROUP BY 1),
p AS (
  SELECT s.*, coalesce(correlation, 1.0) AS correlation, coalesce(p_loss, 0.015) AS p_loss, CASE coalesce(o, 1) WHEN 1 THEN 'unknown' WHEN 2 THEN 'estimated' ELSE 'measured' END AS confidence
  FROM sets s LEFT JOIN lost USING (drive_ids))"""


def _sets(spark, sf_dir):
    return risk.set_risk(risk.drive_sets(m.fleet_files(spark, sf_dir)), _risks(spark, sf_dir), risk.PROVISIONAL["unknown"])


def _name():
    return F.array_join(F.transform("drive_ids", lambda d: d.cast("string")), ",")


@query("SELECT array_to_string(drive_ids, ',') AS drives, items, bytes FROM sets", m.DRIVE_SQL, HEALTH_SQL, RISK_SQL, FLEET_SQL)
def drive_sets(spark, sf_dir):
    """A13, U2, T10."""
    return risk.drive_sets(m.fleet_files(spark, sf_dir)).select(_name().alias("drives"), "items", "bytes")


@query(
    """SELECT array_to_string(drive_ids, ',') AS drives, CAST(round(correlation) AS BIGINT) AS correlation, CAST(round(p_loss * 1e9) AS BIGINT) AS p_ppb, confidence FROM p""",
    m.DRIVE_SQL, HEALTH_SQL, RISK_SQL, FLEET_SQL,
)
def p_loss_by_set(spark, sf_dir):
    """R6, R7, A27, J14."""
    return _sets(spark, sf_dir).select(_name().alias("drives"), F.round("correlation").cast("long").alias("correlation"), F.round(F.col("p_loss") * 1e9).cast("long").alias("p_ppb"), "confidence")


@query(
    """SELECT CAST(round(sum(bytes * p_loss)) AS BIGINT) AS expected_bytes, arg_min(confidence, list_position(['unknown', 'estimated', 'measured'], confidence)) AS confidence FROM p""",
    m.DRIVE_SQL, HEALTH_SQL, RISK_SQL, FLEET_SQL,
)
def expected_loss(spark, sf_dir):
    """A14, R8."""
    return risk.expected_loss(_sets(spark, sf_dir)).select(F.round("expected_bytes").cast("long").alias("expected_bytes"), "confidence")


@query(
    """SELECT array_to_string(drive_ids, ',') AS drives, bytes FROM p WHERE bytes > 0 ORDER BY p_loss DESC, drives LIMIT 1""",
    m.DRIVE_SQL, HEALTH_SQL, RISK_SQL, FLEET_SQL,
)
def worst_drive_set(spark, sf_dir):
    """D3."""
    return _sets(spark, sf_dir).where("bytes > 0").select(_name().alias("drives"), "bytes", "p_loss").orderBy(F.desc("p_loss"), "drives").limit(1).drop("p_loss")


@query(
    """SELECT content_id, size_bytes, CAST(round(size_bytes * p_loss * 1000) AS BIGINT) AS expected_milli FROM held JOIN p USING (drive_ids)
       ORDER BY round(size_bytes * p_loss * 1000) DESC, content_id LIMIT 100""",
    m.DRIVE_SQL, HEALTH_SQL, RISK_SQL, FLEET_SQL,
)
def ranked_under_protected(spark, sf_dir):
    """R8's ranking, O4."""
    items = m.fleet_files(spark, sf_dir).groupBy("content_id").agg(F.max("size_bytes").alias("size_bytes"), F.array_sort(F.collect_set("drive_id")).alias("drive_ids"))
    rows = risk.ranked_exposure(items, _sets(spark, sf_dir)).select("content_id", "size_bytes", F.round(F.col("expected") * 1000).cast("long").alias("expected_milli"))
    return rows.orderBy(F.desc("expected_milli"), "content_id").limit(100)


@query(
    """SELECT 'M' || (user_id % 10) AS model, count(*) AS days, count(*) FILTER (event_type = 'error') AS failures,
              CAST(round(count(*) FILTER (event_type = 'error') / (count(*) / 365.0) * 1e4) AS BIGINT) AS afr_e4
       FROM events GROUP BY 1 HAVING count(*) >= 50"""
)
def afr_by_model(spark, sf_dir):
    """A16, S10's aggregation."""
    e = m.table(spark, sf_dir, "events").select(F.concat(F.lit(" M"), (F.col("user_id") % 10).cast("string"), F.lit(" ")).alias("model"), F.when(F.col("event_type") == "error", " 1").otherwise("0").alias("failure"))
    return risk.fleet_rates(e, 50).select("model", "days", "failures", F.round(F.col("failures") / (F.col("days") / 365.0) * 1e4).cast("long").alias("afr_e4"))
