"""Shared plumbing: a scratch area in the shared checkpoint folder, and connected components.

Intermediate tables are Parquet files below ``spark.checkpoint.dir``, which every
executor and the driver see, so a lost executor costs a re-read and never data.
"""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.session import shared_dir


#: Edges that the driver may join by itself (4 MB); more go through rounds of joins.
FEW_EDGES = 1 << 18
#: Rows of an Arrow batch: texts are long, and a batch lies in memory on both sides.
ARROW_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have at most ``BATCH_ROWS`` rows."""
    rows = int(spark.conf.get(ARROW_ROWS))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, BATCH_ROWS)


class Scratch:
    """Named intermediate tables, deleted together by ``finish`` or ``close``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        bounded_batches(spark)
        self.root = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return what was written: lineage ends here."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        schema = df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            for f in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
                if self.root.split("://")[-1].lstrip("/") in f:
                    self._delete(f)

    def release(self) -> None:
        """Let Spark drop the broadcasts and shuffle files of what has ended: it does so only after a collection on the driver."""
        gc.collect()
        self.spark._jvm.System.gc()

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        self._delete(self.root)

    def finish(self, df: DataFrame) -> DataFrame:
        """Checkpoint the narrow result on shared storage and drop every intermediate table."""
        out = df.checkpoint(eager=True)
        self.close()
        return out


def joined_on_driver(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of edges ``a``-``b``, and for each the smallest that it is joined with."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(a):
        # Every root with a smaller neighbour hangs on its least one; at least half of them go.
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return ids, ids[root]


def components(scratch: Scratch, edges: DataFrame, max_rounds: int = 64, few: int = FEW_EDGES) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(id, component)`` per vertex, component its smallest id.

    Up to ``few`` edges are joined on the driver: rounds of joins make thousands of tasks of
    them, and the driver remembers every task. More take alternating large-star and small-star
    steps; each round is two aggregations over the
    edges alone, and rounds grow with the logarithm of the longest path. The edge count
    never grows, so a star of a third of all vertices stays linear. The least neighbours are
    written before they are joined: then adaptive execution can split the centre of a star,
    which it can't in a stage that aggregates by the same key.
    """
    edges = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    if edges.count() <= few:
        found = edges.toArrow()
        ids, component = joined_on_driver(found["u"].to_numpy(), found["v"].to_numpy())
        scratch.drop(edges)
        return scratch.keep(scratch.spark.createDataFrame(pa.table({"id": ids, "component": component}), "id long, component long"))
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = scratch.keep(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        new = scratch.keep(small)
        # Two numbers decide: when a round leaves the edge set as it was, every vertex points at its root.
        sign = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(edges, low, large, least)
        edges = new
        if tuple(sign) == before:
            break
        before = tuple(sign)
    else:
        raise RuntimeError("components did not converge")
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))
