"""Near-duplicate vectors by an exact metric range join.

On unit vectors, cosine >= t is Euclidean distance <= r = sqrt(2 - 2t). A bounded sample of
vectors are pivots; a vector's home cell is its nearest pivot of its label. By the triangle
inequality a partner within r of a vector with home distance d lives in a cell whose pivot
is within d + 2r of the vector, and on the near side of the bisector moved by r; into those
cells the vector is copied. Cells then join independently, in blocks of bounded size, so a
cell that holds a third of all vectors is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackroom.llm.common import Scratch, components

THRESHOLD = 0.98
#: Pivots are sampled and broadcast: at most so many numbers in all of them, 32 MB. Up to there
#: their number grows with the vectors, so that a cell keeps its size.
MAX_PIVOT_NUMBERS = 4_000_000
#: Distances held at once while vectors are dealt to cells.
DISTANCES = 2_000_000
#: Vectors that a cell should have, and vectors of a side of a block.
CELL, BLOCK = 512, 1024


def unit_rows(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, unit``; ``unit`` is null for vectors that link with nothing."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    ok = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & (F.size(v) > 0) & F.col(label_col).isNotNull()
    df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.when(ok, v).alias("v"))
    df = df.withColumn("top", F.array_max(F.transform("v", lambda x: F.abs(x))))
    df = df.withColumn("v", F.when(F.col("top") > 0, F.transform("v", lambda x: x / F.col("top"))))
    df = df.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    return df.select("vec_id", "label", F.transform("v", lambda x: x / F.col("norm")).alias("unit"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def cells_of(x: np.ndarray, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, cell, home``: the nearest pivot of each row of ``x``, and the other cells where a partner may live."""
    out = []
    for lo in range(0, len(x), max(1, DISTANCES // len(p))):
        part = x[lo : lo + max(1, DISTANCES // len(p))]
        d = np.sqrt(np.maximum(2 - 2 * part @ p.T, 0))
        own = d.argmin(1)
        d0 = d[np.arange(len(part)), own][:, None]
        apart = np.sqrt(np.maximum(2 - 2 * p[own] @ p.T, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            over = np.where(apart > 0, (d * d - d0 * d0) / (2 * apart), 0)
        into = (d <= d0 + 2 * radius + 1e-9) & (over <= radius + 1e-9)
        into[np.arange(len(part)), own] = True
        row, cell = np.nonzero(into)
        out.append((lo + row, cell, own[row] == cell))
    return tuple(map(np.concatenate, zip(*out)))


def to_cells(reps: DataFrame, pivots: dict[tuple, np.ndarray], radius: float) -> DataFrame:
    """``grp, cell, home, id, weight, unit``: every vector in its home cell, and copies where a partner may live."""
    held = reps.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups = b.column(0).to_pylist()
            for grp in dict.fromkeys(groups):
                part = b.filter(pa.array([g == grp for g in groups]))
                p, n = held.value.get(grp), part.num_rows
                if p is None:
                    row, cell, home = np.arange(n), np.zeros(n, int), np.ones(n, bool)
                else:
                    row, cell, home = cells_of(_matrix(part.column(3), p.shape[1]), p, radius)
                take = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([take.column(0), pa.array(cell, pa.int32()), pa.array(home), take.column(1), take.column(2), take.column(3)], names=["grp", "cell", "home", "id", "weight", "unit"])

    return reps.select("grp", "id", "weight", "unit").mapInArrow(run, "grp string, cell int, home boolean, id long, weight long, unit array<double>")


def join_block(threshold: float):
    """For one block of a cell: links of its home vectors, and for each linked vector the smallest id it reaches."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        home, other = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(home) or not len(other):
            return pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")
        hi, oi = home["id"].to_numpy(), other["id"].to_numpy()
        linked = (np.vstack(home["unit"].to_numpy()) @ np.vstack(other["unit"].to_numpy()).T >= threshold) & (hi[:, None] != oi[None, :])
        links = (linked * other["weight"].to_numpy()[None, :]).sum(1)
        top = np.iinfo(np.int64).max
        root_h, root_o = hi.copy(), oi.copy()
        while True:
            nh = np.minimum(root_h, np.where(linked, root_o[None, :], top).min(1))
            no = np.minimum(root_o, np.where(linked, nh[:, None], top).min(0))
            if (nh == root_h).all() and (no == root_o).all():
                break
            root_h, root_o = nh, no
        touched_h, touched_o = linked.any(1), linked.any(0)
        return pd.DataFrame({"id": np.r_[hi[touched_h], oi[touched_o]], "links": np.r_[links[touched_h], np.zeros(touched_o.sum(), np.int64)], "root": np.r_[root_h[touched_h], root_o[touched_o]]}).astype("int64")

    return run


def link_vectors(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Vectors link only when their labels are equal and not null, their lengths are equal, and
    their cosine in double precision is at least ``threshold``. Null, empty and zero vectors
    and those with a null or non-finite component link with nothing. Equal vectors are one
    class and count each other as links; repeated rows are vectors each; a null id is never
    the smallest of a component that has another; an empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = scratch.keep(unit_rows(df, id_col, vec_col, label_col).withColumn("uid", F.monotonically_increasing_id()))
    valid = rows.where("unit IS NOT NULL").withColumn("grp", F.concat_ws(":", F.size("unit").cast("string"), F.col("label").cast("string")))
    first = F.min(F.struct(F.col("vec_id").isNull().alias("no_id"), "vec_id", "uid")).alias("f")
    classes = valid.groupBy("grp", "unit").agg(first, F.count("*").alias("weight"))
    reps = scratch.keep(classes.select("grp", F.col("f.uid").alias("id"), F.col("f.vec_id").alias("vec_id"), "weight", "unit"))

    n, dim = reps.agg(F.count("*"), F.max(F.size("unit"))).first()
    wanted = min(n // cell, MAX_PIVOT_NUMBERS // max(dim or 1, 1))
    pivots: dict[str, list] = {}
    if wanted > 1:
        for r in reps.select("grp", "unit").orderBy(F.xxhash64("id"), "id").limit(wanted).collect():
            pivots.setdefault(r.grp, []).append(r.unit)
    radius = (2 - 2 * threshold) ** 0.5
    cells = scratch.keep(to_cells(reps, {g: np.array(p) for g, p in pivots.items()}, radius))

    size = cells.groupBy("grp", "cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("all"))
    size = size.select("grp", "cell", F.ceil(F.col("homes") / block).cast("int").alias("nh"), F.ceil(F.col("all") / block).cast("int").alias("no")).where("nh > 0")
    cells = cells.join(size, ["grp", "cell"]).withColumn("k", F.xxhash64("id"))
    mine, theirs = F.pmod("k", F.col("nh")).cast("int"), F.pmod("k", F.col("no")).cast("int")
    home = cells.where("home").select("grp", "cell", mine.alias("i"), F.explode(F.sequence(F.lit(0), F.col("no") - 1)).alias("j"), F.lit(0).alias("side"), "id", "weight", "unit")
    other = cells.select("grp", "cell", F.explode(F.sequence(F.lit(0), F.col("nh") - 1)).alias("i"), theirs.alias("j"), F.lit(1).alias("side"), "id", "weight", "unit")
    found = home.unionByName(other).groupBy("grp", "cell", "i", "j").applyInPandas(join_block(threshold), "id long, links long, root long")
    found = scratch.keep(found)

    degree = found.groupBy("id").agg(F.sum("links").alias("links"))
    member = components(scratch, found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    roots = member.join(reps.select("id", "vec_id"), "id").groupBy("component").agg(F.min("vec_id").alias("component_id"))
    per_class = (
        reps.select("id", "grp", "unit", "vec_id", "weight").join(degree, "id", "left").join(member.join(roots, "component").select("id", "component_id"), "id", "left")
        .select("grp", "unit", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "vec_id").alias("class_component"))
    )
    out = valid.select("uid", "vec_id", "grp", "unit").join(per_class, ["grp", "unit"]).select("vec_id", "n_links", F.col("class_component").alias("component_id"))
    alone = rows.where("unit IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.unionByName(alone)
    return scratch.finish(out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
