"""Line dedup: a suffix array over line-id sequences, by distributed prefix doubling.

Every line is a position of one long sequence of line ids; a document's end is a break that
equals nothing. Doubling sorts positions by their first 1, 2, 4, ... lines: the rank of a
window of 2h lines is the place, in sorted order, of the pair of its halves' ranks, so ranks
keep the order of the lines' ids and a rank is where its interval of the suffix array begins.
Ranks come from one sort of the *distinct* pairs, each with how many positions have it, so a
blank line that a third of all documents hold is one row there. A position whose window
occurs once drops out: no longer window of it can repeat.

Positions of equal rank are the intervals of the suffix array whose longest common prefix has
at least that many lines. A run of a given length is the overlap of two windows of the largest
power of two in it. In each such interval the first position, in order of document id, stays,
and later copies are deleted; deleted runs that touch or overlap are one span.

A maximal repeated run is the union of its shortest windows of ``min_words`` words: those that
begin at each of its lines and those that end at each. Any line of a repeated run lies in a
window that can't lose its first or last line without losing that line or falling below
``min_words``, and a part of a repeated run is repeated as far back. So the intervals of those
windows are all that is looked at, and what they delete is every maximal run whole.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackroom.llm.common import Scratch

#: A run counts from so many words on; a single line can be a run.
MIN_WORDS = 50

DOC = ["doc_id", "t1", "t2"]


def _rank(*parts) -> list:
    """128 bits that stand for ``parts``."""
    return [F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(104_729), *parts).alias("b")]


def line_table(docs: DataFrame, min_words: int, maximal: bool = False) -> DataFrame:
    """``doc_id, t1, t2, i, a, b, run, most``: line ids, and how many lines from here reach ``min_words`` (null: none do).

    The windows from here have ``run`` to ``most`` lines: one length, or, for maximal runs, also
    those of windows that are the shortest by their last line: they end before the next line's
    shortest window does, or at the document's end.
    """
    word = r"[^\x20\x09-\x0D]+"
    lines = docs.where("text IS NOT NULL").select(*DOC, F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    lines = lines.select(*DOC, "i", *_rank("line"), F.regexp_count("line", F.lit(word)).alias("w")).dropDuplicates([*DOC, "i"])
    doc = Window.partitionBy(*DOC)
    before = F.sum("w").over(doc.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")
    lines = lines.withColumn("before", before).withColumn("total", F.sum("w").over(doc))
    # The lines of the shortest run from here are those that begin less than min_words after it.
    last = F.max("i").over(doc.orderBy("before").rangeBetween(0, min_words - 1))
    lines = lines.withColumn("run", F.when(F.col("before") + min_words <= F.col("total"), last - F.col("i") + 1))
    most = F.col("run")
    if maximal:
        lines = lines.withColumn("n", F.count("*").over(doc))
        following = doc.orderBy("i").rowsBetween(1, 1)
        most = F.when(F.col("run").isNotNull(), F.greatest("run", F.coalesce(F.max("run").over(following), F.col("n") - F.col("i"))).cast("int"))
    return lines.withColumn("most", most).select(*DOC, "i", "a", "b", "run", "most")


def ranked(scratch: Scratch, positions: DataFrame, rank: str, *keys: str) -> DataFrame:
    """``positions`` whose ``keys`` occur more than once, with ``rank``: how many such positions sort before theirs.

    Distinct keys are sorted over all tasks by ranges, numbered within a range, and moved by
    what the ranges before hold. The intervals are written before the join, and joined by
    sort-merge at every size, so that adaptive execution can split a very common one.
    """
    often = positions.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1")
    often = scratch.keep(often.repartitionByRange(*keys).withColumn("range", F.spark_partition_id()))
    # One row for each range.
    sizes = often.groupBy("range").agg(F.sum("size").alias("of_range"))
    before = sizes.select("range", (F.sum("of_range").over(Window.orderBy("range")) - F.col("of_range")).alias("before"))
    place = F.sum("size").over(Window.partitionBy("range").orderBy(*keys)) - F.col("size")
    intervals = scratch.keep(often.withColumn("place", place).join(F.broadcast(before), "range").select(*keys, (F.col("place") + F.col("before")).alias(rank)))
    return positions.join(intervals.hint("merge"), list(keys))


def later_copies(scratch: Scratch, lines: DataFrame) -> DataFrame:
    """``doc_id, t1, t2, i, run``: positions whose run occurs at an earlier position."""
    at, h, runs = scratch.keep(ranked(scratch, lines, "r", "a", "b").drop("a", "b")), 1, None
    while True:
        second = at.select(*[F.col(c).alias(f"{c}_") for c in DOC], F.col("i").alias("j"), F.col("r").alias("r2"))
        here = at.where((F.col("most") >= h) & (F.col("run") < 2 * h))
        lengths = F.sequence(F.greatest("run", F.lit(h)), F.least("most", F.lit(2 * h - 1)))
        here = here.select(*DOC, "i", "r", F.explode(lengths).alias("run"))
        here = here.join(second, here["doc_id"].eqNullSafe(second["doc_id_"]) & (here["t1"] == second["t1_"]) & (here["t2"] == second["t2_"]) & (second["j"] == here["i"] + here["run"] - h))
        here = scratch.keep(here.select(*DOC, "i", "run", "r", "r2"))
        runs = here if runs is None else runs.unionByName(here)
        if at.where(F.col("most") >= 2 * h).isEmpty():
            break
        half = Window.partitionBy(*DOC).orderBy("i").rangeBetween(h, h)
        pairs = scratch.keep(at.withColumn("r2", F.first("r").over(half)).where("r2 IS NOT NULL"))
        new = scratch.keep(ranked(scratch, pairs, "rank", "r", "r2").select(*DOC, "i", "run", "most", F.col("rank").alias("r")))
        scratch.drop(at, pairs)
        at, h = new, 2 * h
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), *DOC, "i")
    # Written before the join, like the intervals.
    first = scratch.keep(runs.groupBy("run", "r", "r2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return runs.join(first.hint("merge"), ["run", "r", "r2"]).where(place != F.col("first")).select(*DOC, "i", "run")


def merged(copies: DataFrame) -> DataFrame:
    """``doc_id, t1, t2, spans``: a document's deleted runs as sorted, disjoint ``[lo, hi)`` of line numbers."""
    doc = Window.partitionBy(*DOC).orderBy("lo", "hi")
    spans = copies.select(*DOC, F.col("i").alias("lo"), (F.col("i") + F.col("run")).alias("hi"))
    reach = F.max("hi").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce((F.col("lo") > reach).cast("int"), F.lit(1))).withColumn("k", F.sum("new").over(doc))
    spans = spans.groupBy(*DOC, "k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return spans.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", maximal: bool = False) -> DataFrame:
    """``doc_id, text, n_lines, n_deleted, spans`` for every row, without later copies of runs of lines.

    A run is the shortest sequence of whole lines from some line on that has ``min_words``
    words; it is deleted where the same lines occur earlier, by document id, then by line,
    in the same document too, which leaves the last lines of a longer repeated run when no run
    from some line on ends there; with ``maximal`` every repeated sequence of at least
    ``min_words`` words goes whole. Null text stays null with no lines; of texts of any length
    all lines count; an empty text is one empty line; rows of equal id and text are one document
    and get one result each; a null id comes last; an empty table gives an empty result; other
    columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.col(text_col)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(15_485_863), text).alias("t2"))
    lines = scratch.keep(line_table(docs, min_words, maximal))
    spans = scratch.keep(merged(later_copies(scratch, lines)))
    # The spans grow with the corpus: they meet the texts by sort-merge at every size.
    out = docs.join(spans.select(F.col("doc_id").alias("d"), F.col("t1").alias("u1"), F.col("t2").alias("u2"), "spans").hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")), "left")
    out = out.withColumn("lines", F.split("text", "\n", -1)).withColumn("n_lines", F.coalesce(F.size("lines"), F.lit(0)))
    ends = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["hi"]))
    starts = F.concat(F.transform("spans", lambda s: s["lo"]), F.array(F.col("n_lines")))
    kept = F.flatten(F.zip_with(ends, starts, lambda lo, hi: F.slice(F.col("lines"), lo + 1, hi - lo)))
    deleted = F.aggregate("spans", F.lit(0), lambda n, s: n + s["hi"] - s["lo"])
    return out.select(
        "doc_id",
        F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"),
        F.coalesce(deleted, F.lit(0)).cast("long").alias("n_deleted"),
        "spans",
    )
