"""Schemas of the catalog's tables, and the version they belong to.

Unknown is NULL, never zero. Nanosecond times stay ``long``: identity compares them for
equality, and Spark's timestamps hold microseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = 2

TABLES = {
    "drive": "id long, serial string, layout_id string, identity string, nickname string, manufacturer string, model string, bus string, media string, capacity_bytes long, purchase_date string, price_cents long, warranty_until string, batch_key string, role string, location string, disaster_zone string, retired_at string",
    "volume": "id long, volume_guid string, drive_id long, label string, last_letter string, fs_type string, capacity_bytes long, free_bytes long, cluster_bytes long, supports_usn boolean, usn_journal_id long, usn_next long",
    "scope_root": "id long, volume_id long, path string, excludes array<string>, enabled boolean, added_at string, removed_at string",
    "scan": "id long, root_id long, volume_id long, status string, method string, started_at string, finished_at string, files long, error string",
    "dir": "id long, root_id long, volume_id long, parent_id long, name string, depth int, frn long, last_seen_scan long, vanished_at string",
    "file": "id long, volume_id long, dir_id long, name string, ext string, size_bytes long, alloc_bytes long, mtime_ns long, ctime_ns long, frn long, nlink int, attrs long, read_state string, content_id string, first_seen_scan long, last_seen_scan long, vanished_at string",
    "content": "id string, size_bytes long, quick_hash binary, full_hash binary, hash_algo string",
    "fixity_check": "id long, file_id long, content_id string, checked_at string, result string, expected binary, observed binary",
    "drive_health": "id long, drive_id long, observed_at string, confidence string, power_on_hours long, reallocated long, pending long, uncorrectable long, crc_errors long, wear_leveling long, passed boolean, reason string",
    "audit": "id long, at string, actor string, action string, detail_json string, prev_hash string, entry_hash string",
    "collection": "id long, local_pid string, title string, description string, creators string, subject string, license string, coverage string, contact string, ndsa_target int",
    "collection_rule": "id long, collection_id long, dir_id long",
    "collection_relation": "collection_id long, relation string, target string",
    "collection_candidate": "dir_id long, score double, status string, evidence string",
    "version_set": "id long, label string, method string, confidence double, rationale string",
    "version_member": "set_id long, file_id long, content_id string, is_preferred boolean",
    "plan": "id long, created_at string, status string, policy string, summary string",
    "plan_step": "plan_id long, id long, kind string, unit string, drive_id long, round int, bytes long, note string, source_drive_id long, footprint_bytes long, risk_delta double, collection_id long, dst_path string",
    "export": "id long, path string, created_at string, files long, bytes long",
}


def live(df: DataFrame) -> DataFrame:
    """Rows that have not vanished; nothing is ever deleted."""
    return df.where(F.col("vanished_at").isNull())
