"""Exact dedup: a persistent digest index, bucketed and sorted by hash.

The index holds one row per distinct normalised text. A batch is reduced to its own
winners first, anti-joined with the index by sort-merge on the bucketed hash (the index
side is not shuffled), and what is new is appended. All of it is DataFrame operations.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.llm.common import Scratch

#: A hash that this share of the batch carries is joined by broadcast; there are at most its inverse of them.
HOT_SHARE = 1 / 256


def text_sha256(text_col: str):
    """Lower-case hex SHA-256 of a text without ASCII white space; null counts as empty."""
    bare = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", "")
    return F.sha2(bare.cast("binary"), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_sha256, n_cp``: hash of the text without ASCII white space, and code points of the original."""
    n_cp = F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), text_sha256(text_col).alias("text_sha256"), n_cp.alias("n_cp"))


class DigestIndex:
    """A bucketed, sorted table in the session's catalog: one row per text, with the ``batch`` that brought it.

    The number of buckets is a property of the table: it is read back when an index is opened,
    whatever the session's shuffle partitions are then. Each append adds a file to a bucket;
    ``compact`` makes them one sorted file again. One writer at a time.
    """

    SCHEMA = "text_sha256 string, keep_id long, n_cp long, batch string"

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        if not spark.catalog.tableExists(self.name):
            if spark.catalog.tableExists(self._spare):  # a compaction stopped before its last step
                spark.sql(f"ALTER TABLE {self._spare} RENAME TO {self.name}")
            else:
                self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
                self._write(spark.createDataFrame([], self.SCHEMA), "errorifexists", self.name)
                return
        self.buckets = int(spark.sql(f"DESCRIBE EXTENDED {self.name}").where("col_name = 'Num Buckets'").first().data_type)
        if buckets not in (None, self.buckets):
            raise ValueError(f"{self.name} has {self.buckets} buckets, not {buckets}")

    @property
    def _spare(self) -> str:
        return f"{self.name}__compacted"

    def _write(self, rows: DataFrame, mode: str, table: str) -> None:
        (
            rows.repartition(self.buckets, "text_sha256")
            .write.mode(mode)
            .format("parquet")
            .bucketBy(self.buckets, "text_sha256")
            .sortBy("text_sha256")
            .saveAsTable(table)
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append_new(self, winners: DataFrame, batch: str) -> None:
        """Append the winners whose hash the index lacks. ``winners`` has one row per hash.

        Run again after a failure, it appends what the first run did not.
        """
        new = winners.hint("merge").join(self.read().select("text_sha256").hint("merge"), "text_sha256", "left_anti")
        self._write(new.select("text_sha256", "keep_id", "n_cp", F.lit(batch).alias("batch")), "append", self.name)

    def compact(self) -> None:
        """One sorted file per bucket. Stopped anywhere, the index is whole when it is opened again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._spare}")
        self._write(self.read(), "errorifexists", self._spare)
        self.spark.sql(f"DROP TABLE {self.name}")
        self.spark.sql(f"ALTER TABLE {self._spare} RENAME TO {self.name}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def winners(rows: DataFrame) -> DataFrame:
    """One row per hash: the longest original, then the smallest id (null last), then the first row; and the group's size."""
    best = F.min(F.struct((-F.col("n_cp")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("b")
    return rows.groupBy("text_sha256").agg(best, F.count("*").alias("group_size")).select(
        "text_sha256", F.col("b.doc_id").alias("keep_id"), F.col("b.uid").alias("keep_uid"), (-F.col("b.neg")).alias("n_cp"), "group_size"
    )


def _join_hot(rows: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """Rows with their class; classes of at least ``HOT_SHARE`` of all rows (so at most 256) go by broadcast."""
    floor = max(1000, int(total * HOT_SHARE))
    hot = classes.where(F.col("group_size") >= floor)
    rest = classes.where(F.col("group_size") < floor)
    hot_keys = F.broadcast(hot.select("text_sha256"))
    return rows.join(F.broadcast(hot), "text_sha256").unionByName(rows.join(hot_keys, "text_sha256", "left_anti").join(rest, "text_sha256"))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row.

    Null text counts as empty; empty texts are equal to one another; of texts of any length all
    is read. Of repeated rows (same id, same text) exactly one is kept. A null id comes last
    among rows of equal length. Given an ``index`` with other batches, a text that it holds
    keeps the earlier row's id and no row of this batch is kept. ``batch`` names this table: run
    again under its name, whether the first run failed before, during or after its append, it
    gives what the first run gives, as rows that the index has of this batch are its own.
    Without a name the run can't be repeated against a kept index. ``group_size`` counts this
    batch. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.keep(digests(docs, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()))
    classes = scratch.keep(winners(rows))
    own = index is None
    index = index or DigestIndex(spark)
    batch = batch or uuid.uuid4().hex
    index.append_new(classes, batch)
    held = index.read().select("text_sha256", "batch", F.col("keep_id").alias("held_id"))
    # The row that stays is named by this run's numbers: a second run numbers its rows anew.
    settled = classes.select("text_sha256", "group_size", F.col("keep_uid").alias("best")).hint("merge").join(held, "text_sha256")
    settled = scratch.keep(settled.withColumn("best", F.when(F.col("batch") == batch, F.col("best"))).drop("batch"))
    out = _join_hot(rows, settled, rows.count()).select(
        "doc_id",
        F.col("held_id").alias("keep_id"),
        "group_size",
        F.coalesce(F.col("uid") == F.col("best"), F.lit(False)).alias("kept"),
        "text_sha256",
    )
    out = scratch.finish(out)
    if own:
        index.drop()
    return out
