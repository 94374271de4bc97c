"""Tiered identity of files by content, and later checks of it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackroom.functions import hashing
from stackroom.operators.redundancy import collisions, hash_candidates
from stackroom.session import checkpointed


def content_id(size, quick, full):
    """A content's id is a hash of what identifies it, so an upsert needs no lookup; an unknown full hash is its own value."""
    hexed = lambda c: F.coalesce(F.hex(c), F.lit("-"))
    return F.sha2(F.concat_ws("|", size.cast("string"), hexed(quick), hexed(full)), 256)


def contents_of(files: DataFrame) -> DataFrame:
    """Distinct contents ``id, size_bytes, quick_hash, full_hash, hash_algo`` of hashed files."""
    return files.where("quick_hash IS NOT NULL").select(F.col("content_id").alias("id"), F.col("content_size").alias("size_bytes"), "quick_hash", "full_hash", F.lit(hashing.ALGORITHM).alias("hash_algo")).dropDuplicates(["id"])


def hash_pass(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``files`` with identities, and the contents.

    ``files`` has path, device and media besides the catalog's columns. Candidates get a quick
    hash; where one is shared and does not cover the file, all that share it get a full hash.
    Bytes are read once a pass: each pass ends on shared storage before the next plans on it.
    """
    todo = hashing.by_device(hash_candidates(files), False)
    quick = checkpointed(hashing.quick_hashes(todo).where("error IS NULL").select("id", F.col("digest").alias("quick_hash")))
    rows = files.join(quick, "id", "left").withColumn("full_hash", F.lit(None).cast("binary")).withColumn("content_size", F.when(F.col("quick_hash").isNotNull(), F.col("size_bytes")))
    cid = F.when(F.col("quick_hash").isNotNull(), content_id(F.col("content_size"), F.col("quick_hash"), F.col("full_hash"))).otherwise(F.col("content_id"))
    rows = rows.withColumn("content_id", cid)
    shared = collisions(contents_of(rows), rows).where(F.col("size_bytes") > hashing.SMALL).select(F.col("id").alias("content_id"))
    again = hashing.by_device(rows.join(shared, "content_id", "left_semi"), True)
    full = checkpointed(hashing.full_hashes(again).where("error IS NULL").select("id", F.col("digest").alias("_full"), F.col("size_read").alias("_read")))
    rows = rows.join(full, "id", "left").withColumn("full_hash", F.coalesce("_full", "full_hash")).withColumn("content_size", F.coalesce("_read", "content_size"))
    rows = rows.withColumn("content_id", F.when(F.col("_full").isNotNull(), content_id(F.col("content_size"), F.col("quick_hash"), F.col("full_hash"))).otherwise(F.col("content_id"))).drop("_full", "_read")
    return rows.drop("quick_hash", "full_hash", "content_size"), contents_of(rows)


def verify_pass(files: DataFrame, contents: DataFrame) -> DataFrame:
    """``file_id, content_id, result, observed``: ok, mismatch, unreadable, or modified (newer time: not a failure, not read).

    A quick hash that covered the file is recomputed with the recorded size, so a file that
    has lost bytes without a new time is a mismatch.
    """
    c = contents.select(F.col("id").alias("content_id"), F.col("size_bytes").alias("content_size"), "quick_hash", "full_hash")
    rows = files.where("vanished_at IS NULL AND read_state = 'ok'").join(c, "content_id").where((F.col("full_hash").isNotNull()) | (F.col("content_size") <= hashing.SMALL))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                observed = None
                try:
                    _, mtime = hashing.stat(r.path)
                    if not pd.isna(r.mtime_ns) and mtime != int(r.mtime_ns):
                        result = "modified"
                    else:
                        whole = r.full_hash is not None
                        observed = hashing.full_hash(r.path)[0] if whole else hashing.quick_hash(r.path, int(r.content_size))
                        result = "ok" if observed == bytes(r.full_hash if whole else r.quick_hash) else "mismatch"
                except OSError:
                    result = "unreadable"
                out.append((r.id, r.content_id, result, observed))
            yield pd.DataFrame(out, columns=["file_id", "content_id", "result", "observed"])

    return hashing.by_device(rows, True).select("id", "path", "mtime_ns", "content_id", "content_size", "quick_hash", "full_hash").mapInPandas(run, "file_id long, content_id string, result string, observed binary")
