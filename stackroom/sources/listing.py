"""``directory_listing``: a data source that walks a directory tree, in partitions of one subtree or one folder.

Links and reparse points are rows but are never entered; a directory that can't be listed is
one row with an error. Files are opened by nobody here.
"""

from __future__ import annotations

import os
import re
import stat as st
from collections import deque
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stackroom.functions.predicates import glob_regex

SCHEMA = "dir string, name string, is_dir boolean, attributes long, size long, alloc_size long, mtime_ns long, ctime_ns long, file_id long, nlink int, stat_failed boolean, error string"


#: Subtrees that the driver cuts a tree into, if it has so many folders. It opens so many folders at most.
SUBTREES = 128


def pruner(root: str, patterns: list[str]):
    """Whether an entry is left out: patterns with a separator match the path below the root, others the name."""
    names = [re.compile(glob_regex(p)) for p in patterns if "/" not in p and "\\" not in p]
    paths = [re.compile(glob_regex(p.replace("\\", "/"))) for p in patterns if "/" in p or "\\" in p]

    def left_out(folder: str, name: str) -> bool:
        low = name.lower()
        if any(p.match(low) for p in names):
            return True
        return bool(paths) and any(p.match(os.path.relpath(os.path.join(folder, name), root).lower()) for p in paths)

    return left_out


def nothing(folder: str, name: str) -> bool:
    return False


def list_directory(path: str, prune=nothing) -> Iterator[tuple]:
    """Rows of one directory."""
    try:
        with os.scandir(path) as found:
            entries = sorted(found, key=lambda e: e.name)
    except OSError as e:
        yield path, "", True, 0, 0, 0, 0, 0, None, 0, True, e.strerror or str(e)
        return
    for e in entries:
        if prune(path, e.name):
            continue
        name = e.name.encode("utf-8", "replace").decode()
        try:
            s = e.stat(follow_symlinks=False)
        except OSError:
            yield path, name, False, 0, None, None, None, None, None, 0, True, None
            continue
        link, folder = st.S_ISLNK(s.st_mode), st.S_ISDIR(s.st_mode)
        attributes = (0x400 if link else 0) | (0x10 if folder else 0)
        yield path, name, folder, attributes, s.st_size, s.st_blocks * 512, s.st_mtime_ns, s.st_ctime_ns, s.st_ino, s.st_nlink, False, None


def folders(path: str, prune=nothing) -> list[str]:
    """The folders of one directory, links left out; none of one that can't be listed, which its reader reports."""
    try:
        with os.scandir(path) as found:
            return sorted(e.path for e in found if e.is_dir(follow_symlinks=False) and not prune(path, e.name))
    except OSError:
        return []


def walk(root: str, prune=nothing, deep: bool = True) -> Iterator[tuple]:
    """Breadth-first rows below ``root``."""
    queue = deque([root])
    while queue:
        for row in list_directory(queue.popleft(), prune):
            yield row
            if deep and row[2] and not row[3] & 0x400 and row[1] and not row[11]:
                queue.append(os.path.join(row[0], row[1]))


class _Subtree(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.patterns = [p for p in options.get("prune", "").split("\n") if p]

    @property
    def prune(self):
        return pruner(self.root, self.patterns)

    def partitions(self):
        """Folders from the root down, each by itself, until ``SUBTREES`` below them are left to walk."""
        prune, opened, below = self.prune, [], deque([self.root])
        while below and len(opened) < SUBTREES and len(below) < SUBTREES:
            opened.append(below.popleft())
            below.extend(folders(opened[-1], prune))
        return [*(_Subtree(p, False) for p in opened), *(_Subtree(p, True) for p in below)]

    def read(self, partition):
        yield from walk(partition.path, self.prune, partition.deep)


class DirectoryListing(DataSource):
    """``spark.read.format("directory_listing").option("prune", "*.tmp\\nraw/old*").load(root)``"""

    @classmethod
    def name(cls):
        return "directory_listing"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def listing(spark: SparkSession, root: str, prune: list[str] | None = None):
    spark.dataSource.register(DirectoryListing)
    return spark.read.format("directory_listing").option("prune", "\n".join(prune or [])).load(root)
