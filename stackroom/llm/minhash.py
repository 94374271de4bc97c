"""Near-duplicate documents by bottom-k sketches of one hash function.

1.  A document's set is the 63-bit hashes of its distinct five-word shingles; its sketch is
    the ``K`` smallest. Equal sets collapse to one class, so exact copies cost one row each.
2.  Inverted lists: each retained value lists the classes that hold it. Two linked classes
    share at least ``C`` retained values (all but surely: six standard deviations), so in
    the common order "rarest first" they meet in a list among their first
    ``held - C + 1`` values, and only those lists are kept. A passage that many documents
    share is frequent, comes last, and so makes no list unless it is most of a document.
3.  The classes in a list of two or more are few. Their overlaps are taken from lists of all
    their values, so that the share of a pair's own sizes takes the place of the six deviations:
    128 values can't tell a pair of 0.79 from one of 0.85 without loss, and documents of one form
    would all be candidates of one another. An entry of such a list pairs only with sets up to a
    size, and one of each pair has an entry that allows its own size; lists without such entries
    go. In each list everybody is compared with one leader, twice with different leaders; only
    pairs of one list that are still in different components are then compared in full. A list
    of n copies of one text costs a few times n comparisons; no pair that could join two
    components is left out.
4.  A pair passes the union sketch's estimate, then exact Jaccard on the full sets.

Shingles are compared by 63-bit hashes; two different shingles of a pair collide with
probability below 1e-12 for documents of a thousand words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackroom.llm.bpe import release_encoders, text_slices
from stackroom.llm.common import Scratch, components

WORDS = 5
K = 128
#: Linked: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Rounds with a leader for each list, before the full comparison of what they left apart.
LEADER_ROUNDS = 2

_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the shingles of ``text``, A-Z lower-cased and cut at ASCII white space."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    width = min(words, len(tokens))
    n = len(tokens) - width + 1
    r = np.full(n, np.uint64(width), np.uint64)
    for i in range(width):
        r = r * _P + h[i : i + n]
    r ^= r >> np.uint64(31)
    r *= np.uint64(0xBF58476D1CE4E5B9)
    r ^= r >> np.uint64(29)
    r *= np.uint64(0x94D049BB133111EB)
    r ^= r >> np.uint64(32)
    return np.unique((r >> np.uint64(1)).astype(np.int64))


def least_shared(k: int = K, percent: int = PERCENT) -> int:
    """Retained values that a linked pair of large sets shares, but for six standard deviations."""
    p = percent / 100
    return max(1, int(p * k - 6 * (p * (1 - p) * k) ** 0.5))


def sketches(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """``doc_id, n, set_id, sketch`` from ``doc_id, text``; ``set_id`` is a 128-bit hash of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        for b in batches:
            for s, texts in text_slices(b.column(1)):
                sets = [shingle_hashes(t, words) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[s], pa.array([len(x) for x in sets], pa.int64()), pa.array([xxhash.xxh128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([x[:k] for x in sets], pa.list_(pa.int64()))],
                    names=["doc_id", "n", "set_id", "sketch"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, set_id binary, sketch array<long>")


def full_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``set_id, shingles`` from ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        for b in batches:
            for _, texts in text_slices(b.column(0)):
                sets = [shingle_hashes(t, words) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["set_id", "shingles"])

    return docs.select("text").mapInArrow(run, "set_id binary, shingles array<long>")


def prefix_lists(scratch: Scratch, entries: DataFrame, held_at_most, need) -> DataFrame:
    """``v, id, n, rank, gap``: each class with the values through which it can meet a linked class.

    ``entries`` has a class's retained values, ``held_at_most`` of them, of which a linked
    class shares ``need``. ``rank`` counts them from the rarest on; ``gap`` of them no other class has.
    """
    # Written before the join, and joined by sort-merge at every size: only then can adaptive
    # execution split a value that very many hold.
    shared = scratch.keep(entries.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"))
    own = Window.partitionBy("id")
    held = entries.join(shared.hint("merge"), "v").withColumn("gap", held_at_most - F.count("*").over(own))
    return held.withColumn("rank", F.col("gap") + F.row_number().over(own.orderBy("df", "v"))).where(F.col("rank") <= held_at_most - need + 1).select("v", "id", "n", "rank", "gap")


def linkable(scratch: Scratch, lists: DataFrame, percent: int) -> DataFrame:
    """The entries of ``lists`` that any pair can need, with ``most``, the largest set that an entry can link with.

    Full sets of a linked pair share at least percent / (100 + percent) of the sum of their
    sizes. So a value can be the rarest that a pair shares only if the other set's size is at
    most ``most``, on both sides. Of such a pair, the entry with the larger set has n <= most: call
    it strong. Lists without a strong entry make no pair, and others' entries only with strong
    ones: a template that documents mostly copy, but for more of their own than a link
    allows, leaves no entry, however many they are.
    """
    most = F.expr(f"((n - rank + 1) * {100 + percent}) div {percent} - n")
    lists = scratch.keep(lists.select("v", "id", "n", "gap", most.alias("most")).where(F.col("most") * 100 >= F.col("n") * percent))
    strong = F.when(F.col("n") <= F.col("most"), F.col("n"))
    some = scratch.keep(lists.groupBy("v").agg(F.min(strong).alias("least"), F.count("*").alias("c")).where("least IS NOT NULL AND c > 1").drop("c"))
    return lists.join(some.hint("merge"), "v").where("most >= least").drop("least")


def _can_link(a: str, b: str):
    return (F.col(f"n_{b}") <= F.col(f"most_{a}")) & (F.col(f"n_{a}") <= F.col(f"most_{b}"))


def _side(lists: DataFrame, x: str) -> DataFrame:
    return lists.select("v", F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("most").alias(f"most_{x}"), F.col("component").alias(f"c_{x}"))


class _Links:
    """Confirms candidate pairs and holds what was found and tried so far."""

    def __init__(self, scratch: Scratch, sketch: DataFrame, sets: DataFrame, k: int, percent: int):
        self.scratch, self.sketch, self.sets, self.k, self.percent = scratch, sketch, sets, k, percent
        self.tried: DataFrame | None = None
        self.found: DataFrame | None = None

    def confirm(self, pairs: DataFrame) -> None:
        """Add the linked ones of ``pairs(a, b)``."""
        k, percent = self.k, self.percent
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = self.scratch.keep(pairs)
        side = lambda t, x, c: t.select(F.col("id").alias(x), F.col(c).alias(f"{c}_{x}"))
        est = pairs.join(side(self.sketch, "b", "sketch"), "b").join(side(self.sketch, "a", "sketch"), "a")
        est = est.withColumn("u", F.slice(F.sort_array(F.array_union("sketch_a", "sketch_b")), 1, k))
        est = est.withColumn("hits", F.size(F.array_intersect("u", F.array_intersect("sketch_a", "sketch_b")))).withColumn("m", F.size("u"))
        p = percent / 100
        close = est.where(F.col("hits") >= F.floor(p * F.col("m") - 6 * F.sqrt(p * (1 - p) * F.col("m")))).select("a", "b")
        exact = close.join(side(self.sets, "b", "shingles"), "b").join(side(self.sets, "a", "shingles"), "a")
        both = F.size(F.array_intersect("shingles_a", "shingles_b"))
        links = exact.withColumn("both", both).where(F.col("both") * 100 >= (F.size("shingles_a") + F.size("shingles_b") - F.col("both")) * percent)
        links = self.scratch.keep(links.select("a", "b"))
        self.tried = pairs if self.tried is None else self.tried.union(pairs)
        self.found = links if self.found is None else self.found.union(links)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, k: int = K, percent: int = PERCENT, leader_rounds: int = LEADER_ROUNDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Null and empty texts and texts without words have an empty set and link with nothing;
    a text of fewer words than a shingle is one shingle; a text of any length is read whole; equal
    texts link. A null id is never the smallest of
    a component that has another; rows of one id repeat as they come; an empty table gives
    an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = scratch.keep(sketches(docs, k, words).withColumn("uid", F.monotonically_increasing_id()))
    some = rows.where("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("f")
    classes = scratch.keep(some.groupBy("set_id").agg(first, F.min("n").alias("n")).select("set_id", "n", F.col("f.uid").alias("id"), F.col("f.doc_id").alias("doc_id")))

    reps = some.select(F.col("uid").alias("id"), "sketch").join(classes.select("id", "n").hint("merge"), "id")
    # A class whose linked classes all fit in a sketch shares its share of its own set.
    exact = F.expr(f"(n * {percent} + 99) div 100")
    need = F.when(F.col("n") * 100 <= k * percent, exact).otherwise(F.lit(least_shared(k, percent)))
    lists = scratch.keep(prefix_lists(scratch, reps.select("id", "n", F.explode("sketch").alias("v")), F.least("n", F.lit(k)), need).select("v", "id"))
    often = scratch.keep(lists.groupBy("v").agg(F.count("*").alias("c")).where("c > 1").select("v"))
    near = lists.join(often.hint("merge"), "v")
    near = scratch.keep(near.select("id").distinct().hint("merge").join(classes, "id"))
    scratch.drop(lists)
    sketch = scratch.keep(rows.select(F.col("uid").alias("id"), "sketch").join(near.select("id").hint("merge"), "id"))
    # The texts of those classes alone are shingled again, for their full sets.
    wanted = docs.join(near.select("doc_id").distinct(), "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
    sets = full_sets(wanted, words).join(near.select("set_id", "id", "n"), "set_id").select("id", "n", "shingles")
    sets = scratch.keep(sets.dropDuplicates(["id"]))
    # Among them the same lists once more, now of all values: no slack for chance is needed.
    every = scratch.keep(sets.select("id", "n", F.explode("shingles").alias("v")))
    prefixes = prefix_lists(scratch, every, F.col("n"), exact)
    lists = scratch.keep(linkable(scratch, prefixes, percent))
    scratch.drop(every)
    scratch.release()

    links = _Links(scratch, sketch, sets, k, percent)
    member = near.select("id", F.col("id").alias("component"))
    for turn in range(leader_rounds):
        # First the class with the least of its own, which a group's copies resemble most; then any.
        order = F.col("gap") / F.col("n") if turn == 0 else F.xxhash64("id", F.lit(turn))
        at = scratch.keep(lists.join(member, "id"))
        lead = at.groupBy("v").agg(F.min(F.struct((F.col("n") > F.col("most")).alias("weak"), order.alias("order"), "id", "n", "most", "component")).alias("l"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        lead = scratch.keep(lead.where("lo <> hi").select("v", "l.id", "l.n", "l.most", "l.component"))
        pairs = _side(at, "b").join(_side(lead, "a").hint("merge"), "v").where((F.col("c_a") != F.col("c_b")) & _can_link("a", "b"))
        links.confirm(pairs.select("a", "b").distinct())
        member = scratch.keep(_membership(near, components(scratch, links.found)))
        scratch.release()
    at = scratch.keep(lists.join(member, "id"))
    apart = scratch.keep(at.groupBy("v").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("v"))
    at = scratch.keep(at.join(apart.hint("merge"), "v"))
    # One of each pair is strong. Of two strong ones the smaller id stands first.
    left, right = _side(at.where("n <= most"), "a"), _side(at, "b")
    once = (F.col("n_b") > F.col("most_b")) | (F.col("a") < F.col("b"))
    rest = left.join(right, (left["v"] == right["v"]) & once & (F.col("c_a") != F.col("c_b")) & _can_link("a", "b"))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links.confirm(rest.join(links.tried.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti"))

    found = components(scratch, links.found)
    roots = found.join(classes.select("id", "doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_class = classes.join(found.join(roots, "component").select("id", "component_id"), "id", "left").select("set_id", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("set_id")).alias("set_id")).join(by_class, "set_id", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
    return scratch.finish(out)


def _membership(near: DataFrame, found: DataFrame) -> DataFrame:
    return near.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
