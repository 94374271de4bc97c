"""Digests of file contents, read on the executors."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A small file is read whole; of a larger one, samples at the head, the middle and the end.
SMALL, SAMPLE, CHUNK = 192 << 10, 64 << 10, 1 << 20
ALGORITHM = "blake2b-256"


def _digest():
    return hashlib.blake2b(digest_size=32)


def quick_hash(path: str, size: int) -> bytes:
    """Digest of the size (8 bytes, little-endian) and the file, or its three samples."""
    d = _digest()
    d.update(size.to_bytes(8, "little"))
    with open(path, "rb") as f:
        if size <= SMALL:
            for block in iter(lambda: f.read(CHUNK), b""):
                d.update(block)
        else:
            for at in (0, size // 2, max(0, size - SAMPLE)):
                f.seek(at)
                d.update(f.read(SAMPLE))
    return d.digest()


def quick_digest(content: bytes) -> bytes:
    """``quick_hash`` of bytes in memory."""
    d = _digest()
    n = len(content)
    d.update(n.to_bytes(8, "little"))
    for at, size in [(0, n)] if n <= SMALL else [(0, SAMPLE), (n // 2, SAMPLE), (max(0, n - SAMPLE), SAMPLE)]:
        d.update(content[at : at + size])
    return d.digest()


def full_hash(path: str) -> tuple[bytes, int]:
    """Digest of the whole file and the bytes that were read."""
    d, n = _digest(), 0
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(CHUNK), b""):
            d.update(block)
            n += len(block)
    return d.digest(), n


def _hashed(df: DataFrame, one) -> DataFrame:
    """``id, digest, size_read, error`` for rows ``id, path, size_bytes``; a file that can't be read has an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, path, size in zip(pdf["id"], pdf["path"], pdf["size_bytes"]):
                try:
                    rows.append((i, *one(path, int(size)), None))
                except OSError as e:
                    rows.append((i, None, None, e.strerror or str(e)))
            yield pd.DataFrame(rows, columns=["id", "digest", "size_read", "error"]).astype({"size_read": "Int64"})

    return df.select("id", "path", "size_bytes").mapInPandas(run, "id long, digest binary, size_read long, error string")


def quick_hashes(df: DataFrame) -> DataFrame:
    return _hashed(df, lambda path, size: (quick_hash(path, size), size))


def full_hashes(df: DataFrame) -> DataFrame:
    return _hashed(df, lambda path, size: full_hash(path))


#: Readers a device takes: quick samples, whole files.
READERS = {"hdd": (2, 1), "ssd": (6, 4), "unknown": (2, 2)}


def by_device(df: DataFrame, full: bool) -> DataFrame:
    """Deal rows ``device, media`` so that a device is read by as many tasks as it takes, in its own order."""
    n = F.lit(READERS["unknown"][full])
    for media, readers in READERS.items():
        n = F.when(F.col("media") == media, readers[full]).otherwise(n)
    lane = F.pmod(F.xxhash64("path"), n)
    # File numbers follow the places on a disk more closely than names do.
    order = [c for c in ("volume_id", "frn", "path") if c in df.columns]
    return df.withColumn("_lane", lane).repartition("device", "_lane").sortWithinPartitions("device", "_lane", *order).drop("_lane")


def stat(path: str) -> tuple[int, int]:
    s = os.stat(path)
    return s.st_size, s.st_mtime_ns
