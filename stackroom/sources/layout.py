"""Identity of a disk from its first sectors: the GPT disk GUID, else the MBR signature."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SECTOR = 512


def layout_id(head: bytes | None) -> str | None:
    """``gpt:<guid>`` or ``mbr:<signature>`` of at least the first two sectors; None where neither is there or set."""
    if not head or len(head) < SECTOR:
        return None
    gpt = head[SECTOR : 2 * SECTOR]
    if gpt[:8] == b"EFI PART" and any(gpt[56:72]):
        return f"gpt:{uuid.UUID(bytes_le=bytes(gpt[56:72]))}"
    if head[510:512] == b"\x55\xaa" and any(head[440:444]):
        return f"mbr:{int.from_bytes(head[440:444], 'little'):08x}"
    return None


@F.pandas_udf(StringType())
def _layout_ids(heads: pd.Series) -> pd.Series:
    return heads.map(layout_id)


def with_layout_id(disks: DataFrame, column: str = "head") -> DataFrame:
    return disks.withColumn("layout_id", _layout_ids(column))
