"""The directory forest: closure by doubling, paths, rollups and subtrees.

A closure row says that ``ancestor`` lies ``distance`` levels above ``descendant`` (0: itself).
It turns every recursive walk into one join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackroom.schema import live
from stackroom.session import checkpointed

MAX_DEPTH = 512


def closure(dirs: DataFrame, max_depth: int = MAX_DEPTH, keep=checkpointed) -> DataFrame:
    """``ancestor, descendant, distance`` of a forest ``id, parent_id``; a parent that isn't there makes a root.

    Each round doubles the longest path known, so a tree of depth d takes log2(d) joins on
    the descendants' side. ``keep`` cuts the lineage of a round. A cycle, or a path longer
    than ``max_depth``, raises.
    """
    nodes = dirs.select("id", "parent_id")
    up = nodes.join(nodes.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    step = 1
    # All paths of length up to `step`, and among them those of exactly that length, as the next stride.
    paths = keep(up.select(F.col("parent_id").alias("ancestor"), F.col("id").alias("descendant"), F.lit(1).alias("distance")))
    while True:
        stride = paths.where(F.col("distance") == step)
        if stride.isEmpty():
            break
        if step > max_depth:
            raise ValueError(f"the directory tree has a cycle or is deeper than {max_depth}")
        far = stride.select(F.col("descendant").alias("mid"), F.col("ancestor").alias("top"))
        below = paths.select(F.col("ancestor").alias("mid"), "descendant", "distance")
        paths = keep(paths.unionByName(below.join(far, "mid").select(F.col("top").alias("ancestor"), "descendant", (F.col("distance") + step).alias("distance"))))
        step *= 2
    return paths.unionByName(nodes.select(F.col("id").alias("ancestor"), F.col("id").alias("descendant"), F.lit(0).alias("distance")))


def paths(dirs: DataFrame, tree: DataFrame, separator: str = "/") -> DataFrame:
    """``id, path``: names from the root down."""
    names = dirs.select(F.col("id").alias("ancestor"), "name")
    parts = tree.join(names, "ancestor").groupBy(F.col("descendant").alias("id")).agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "name"))).alias("parts"))
    return parts.select("id", F.array_join(F.transform("parts", lambda p: p["name"]), separator).alias("path"))


def direct_totals(files: DataFrame) -> DataFrame:
    """Files and bytes directly in each directory."""
    return live(files).groupBy("dir_id").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def rollup(dirs: DataFrame, files: DataFrame, tree: DataFrame) -> DataFrame:
    """Per live directory its own and its subtree's files and bytes: directories are summed before the closure join."""
    direct = direct_totals(files)
    sub = (
        tree.join(direct, tree["descendant"] == direct["dir_id"])
        .groupBy(F.col("ancestor").alias("id"))
        .agg(F.sum("files").alias("subtree_files"), F.sum("bytes").alias("subtree_bytes"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    rows = live(dirs).select("id").join(direct.withColumnRenamed("dir_id", "id"), "id", "left").join(sub, "id", "left")
    return rows.select("id", zero("files"), zero("bytes"), zero("subtree_files"), zero("subtree_bytes"))


def subtree_files(files: DataFrame, tree: DataFrame, roots: DataFrame) -> DataFrame:
    """Live files at or below the directories ``roots(dir_id)``."""
    below = tree.join(roots.select(F.col("dir_id").alias("ancestor")), "ancestor", "left_semi").select(F.col("descendant").alias("dir_id")).distinct()
    return live(files).join(below, "dir_id", "left_semi")


def child_dirs(dirs: DataFrame, rollups: DataFrame, parent_id: int | None) -> DataFrame:
    """Live children of a directory (None: the roots), with totals and whether they have children."""
    parents = live(dirs).select(F.col("parent_id").alias("id")).distinct().withColumn("has_children", F.lit(True))
    rows = live(dirs).where(F.col("parent_id").eqNullSafe(F.lit(parent_id).cast("long")))
    return rows.join(rollups, "id", "left").join(parents, "id", "left").withColumn("has_children", F.coalesce("has_children", F.lit(False)))


def in_roots(files: DataFrame, dirs: DataFrame, root_ids: list[int] | None) -> DataFrame:
    """Files whose directory belongs to one of the roots: None restricts nothing, an empty list leaves nothing."""
    if root_ids is None:
        return files
    return files.join(dirs.where(F.col("root_id").isin(root_ids)).select(F.col("id").alias("dir_id")), "dir_id", "left_semi")


def frn_tree(records: DataFrame) -> DataFrame:
    """Last record of each file reference number: ``frn, parent_frn, name, attributes``."""
    last = F.max_by(F.struct("parent_frn", "name", "attributes"), "usn").alias("r")
    return records.groupBy("frn").agg(last).select("frn", "r.parent_frn", "r.name", "r.attributes")


def orphans(tree: DataFrame, root_frn: int) -> DataFrame:
    """Nodes of ``frn, parent_frn`` that don't hang below the root. A cycle raises."""
    c = closure(tree.select(F.col("frn").alias("id"), F.when(F.col("frn") != root_frn, F.col("parent_frn")).alias("parent_id")))
    under = c.where(F.col("ancestor") == root_frn).select(F.col("descendant").alias("frn"))
    return tree.join(under, "frn", "left_anti")


def page(rows: DataFrame, key: str, after, limit: int = 200) -> DataFrame:
    """Keyset page: the next ``limit`` rows by ``key`` beyond ``after`` (None: from the start)."""
    return (rows if after is None else rows.where(F.col(key) > F.lit(after))).orderBy(key).limit(limit)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the largest ``order`` of each key, by one aggregation."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
