"""Parsers of change-journal and directory buffers. A malformed buffer raises: skipping would invent files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from stackroom.functions.predicates import FILETIME_EPOCH, REPARSE

JOURNAL_FIELDS = "frn decimal(38,0), parent_frn decimal(38,0), name string, attributes long, usn long, timestamp_ns long, reason long"
ENTRY_FIELDS = "name string, attributes long, size long, alloc_size long, mtime_ns long, ctime_ns long, file_id long, reparse_tag long"


def filetime_to_ns(filetime: int) -> int:
    return max(0, (filetime - FILETIME_EPOCH) * 100)


def _name(buffer: bytes, at: int, length: int, end: int) -> str:
    if length % 2 or at + length > end:
        raise ValueError(f"a name of {length} bytes at {at} leaves its record")
    return buffer[at : at + length].decode("utf-16-le", "replace")  # lone surrogates can't be UTF-8


# Where the fields of a record lie. Version 2 has 64-bit numbers, version 3 128-bit ones.
JOURNAL_LAYOUT = {2: (8, 8, 24, 60), 3: (16, 8, 40, 76)}


def journal_records(buffer: bytes, offset: int = 8) -> Iterator[tuple]:
    """Records of a journal buffer behind its leading cursor."""
    at = offset
    while len(buffer) - at >= 8:
        length, version = struct.unpack_from("<IH", buffer, at)
        if length == 0:
            return
        if version not in JOURNAL_LAYOUT:
            raise ValueError(f"journal record version {version} at {at}")
        width, ids, tail, header = JOURNAL_LAYOUT[version]
        if length < header or at + length > len(buffer):
            raise ValueError(f"a record of {length} bytes at {at} in a buffer of {len(buffer)}")
        number = lambda k: int.from_bytes(buffer[at + ids + k * width : at + ids + (k + 1) * width], "little")  # noqa: E731, B023
        usn, when, reason, _, _, attributes, size, name_at = struct.unpack_from("<qqIIIIHH", buffer, at + tail)
        if name_at < header:
            raise ValueError(f"the name of the record at {at} begins inside its header")
        yield number(0), number(1), _name(buffer, at + name_at, size, at + length), attributes, usn, filetime_to_ns(when), reason
        at += length


def directory_entries(buffer: bytes, with_id: bool) -> Iterator[tuple]:
    """Entries of a directory buffer; with ids the name lies behind an eight-byte file id."""
    at = 0
    while True:
        if at + 68 > len(buffer):
            raise ValueError(f"an entry at {at} leaves the buffer of {len(buffer)} bytes")
        step, _, created, _, written, _, size, allocated, attributes, length, tag = struct.unpack_from("<IIqqqqqqIII", buffer, at)
        file_id = struct.unpack_from("<q", buffer, at + 96)[0] if with_id else 0
        name = _name(buffer, at + (104 if with_id else 68), length, len(buffer))
        yield name, attributes, size, allocated, filetime_to_ns(written), filetime_to_ns(created), file_id if file_id > 0 else None, tag if attributes & REPARSE else 0
        if not step:
            return
        at += step


def _parsed(df: DataFrame, column: str, parse, fields: str) -> DataFrame:
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [r for buffer in pdf[column] if buffer is not None for r in parse(bytes(buffer))]
            out = pd.DataFrame(rows, columns=names).astype(object)
            yield out.where(out.notna(), None)

    return df.select(column).mapInPandas(run, fields)


def parse_journal(df: DataFrame, column: str = "content", offset: int = 8) -> DataFrame:
    """Journal records of a binary column."""
    from decimal import Decimal

    return _parsed(df, column, lambda b: ((Decimal(r[0]), Decimal(r[1]), *r[2:]) for r in journal_records(b, offset)), JOURNAL_FIELDS)


def parse_directory(df: DataFrame, column: str = "content", with_id: bool = True) -> DataFrame:
    """Directory entries of a binary column."""
    return _parsed(df, column, lambda b: directory_entries(b, with_id), ENTRY_FIELDS)
