"""A hash-chained log of what was done: one writer appends, anybody can check."""

from __future__ import annotations

import datetime as dt
import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stackroom.schema import TABLES


def entry_hash(prev: str | None, entry_id: int, at: str, actor: str, action: str, detail_json: str) -> str:
    """SHA-256 over the previous hash and the entry as compact JSON."""
    body = json.dumps([entry_id, at, actor, action, detail_json], ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256((bytes.fromhex(prev) if prev else b"") + body.encode()).hexdigest()


def append(spark: SparkSession, log: DataFrame | None, actor: str, entries: list[tuple[str, dict]], at: str | None = None) -> DataFrame:
    """New rows that continue ``log`` (None: a new one). The last row is all that is read."""
    last = log.orderBy(F.desc("id")).limit(1).collect() if log is not None else []
    n, prev = (last[0].id, last[0].entry_hash) if last else (0, None)
    at = at or dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")
    rows = []
    for action, detail in entries:
        n += 1
        text = json.dumps(detail, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        h = entry_hash(prev, n, at, actor, action, text)
        rows.append((n, at, actor, action, text, prev, h))
        prev = h
    return spark.createDataFrame(rows, TABLES["audit"])


@F.pandas_udf(StringType())
def _recomputed(prev: pd.Series, entry_id: pd.Series, at: pd.Series, actor: pd.Series, action: pd.Series, detail: pd.Series) -> pd.Series:
    return pd.Series([entry_hash(p if isinstance(p, str) else None, int(i), t, w, a, d) for p, i, t, w, a, d in zip(prev, entry_id, at, actor, action, detail)])


def problems(log: DataFrame) -> DataFrame:
    """``id, problem``: a missing entry before it, a link that doesn't match, or a changed entry.

    Each entry is joined with the one before it by id: no task holds the whole log.
    """
    before = log.select((F.col("id") + 1).alias("id"), F.col("entry_hash").alias("_prev"))
    rows = log.join(before, "id", "left").withColumn("_now", _recomputed("prev_hash", "id", "at", "actor", "action", "detail_json"))
    missing = F.when((F.col("id") > 1) & F.col("_prev").isNull(), "missing entry before")
    link = F.when(F.col("_prev").isNotNull() & ~F.col("prev_hash").eqNullSafe(F.col("_prev")) | (F.col("id") == 1) & F.col("prev_hash").isNotNull(), "broken link")
    changed = F.when(F.col("_now") != F.col("entry_hash"), "changed entry")
    return rows.select("id", F.explode(F.array_compact(F.array(missing, link, changed))).alias("problem"))


def accepted(log: DataFrame, action: str, text_sha256: str) -> DataFrame:
    """Entries of an action whose detail carries a text's hash, newest first."""
    return log.where((F.col("action") == action) & (F.get_json_object("detail_json", "$.sha256") == text_sha256)).orderBy(F.desc("id"))
