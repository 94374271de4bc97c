"""Best-fit packing by linear grouping.

Documents become pieces of at most ``CAPACITY`` tokens. Everything the plan needs is the
number of pieces of each length, so at most ``CAPACITY`` counts reach the driver however
large the corpus. There, the large lengths are rounded up within groups of equal
cardinality, a few-size cutting-stock program over the group sizes is solved by column
generation, the groups' actual pieces take the places of the rounded ones, and the small
pieces then go best-fit into what is left. The plan is a table of runs: "the pieces of
this length with these ranks lie in these sequences", and the executors place each piece
by its length and rank.
"""

from __future__ import annotations

import json
import logging
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackroom.llm.bpe import CACHE_CHARS, RUN, TreeEncoder, WholeEncoder, encoder, text_slices
from stackroom.llm.common import Scratch

CAPACITY = 4096
#: Id 1 ends a document.
END_ID = 1
#: Lengths above such a share of the capacity are large; the share that needs the fewest sequences is taken.
LARGE = (1 / 2, 1 / 3, 1 / 5, 1 / 8)
GROUPS = 256

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"


#: Any character outside this range sends a text to the slower way. Within it every letter is
#: composed, lower-cases by itself, and white space is the same to every library.
PLAIN = re.compile("[^\t\n\r -~\u00a1-\u024f]")


def _word_pattern() -> re.Pattern:
    """How the vocabulary cuts lower-cased text: runs of letters, single digits, English endings, runs of other signs."""
    kinds = {k: "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    letter, number = kinds["L"], kinds["N"]
    return re.compile(f"[{letter}]+|[{number}]|'(?:s|t|re|ve|m|ll|d)|[^\\s{letter}{number}]+")


WORD = _word_pattern()


def words(text: str) -> list[str]:
    """Runs between spaces and line feeds: white space ends a word in the vocabulary and has no ids."""
    return text.replace("\n", " ").split(" ")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where printable, else the next from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) if b in printable else chr(256 + rest.index(b)) for b in range(256)}


class WordEncoder(TreeEncoder):
    """For the vocabulary that lower-cases, drops white space and marks the ends of words.

    The ids of a word don't depend on its neighbours, so each distinct word is encoded once.
    """

    pieces = staticmethod(words)

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        super().__init__(path, leaf=1 << 16)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        size = self.tok.get_vocab_size()
        self.ends = np.array([(self.tok.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.letters = byte_letters()

    def _long(self, piece: str) -> list[int]:
        return self.tok.encode(piece, add_special_tokens=False).ids

    def _learn_words(self, wanted: set[str]) -> None:
        todo = list(wanted)
        for i in range(0, len(todo), RUN):
            some = todo[i : i + RUN]
            mapped = " ".join(w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in some)
            ids = np.array(self.bare.encode(mapped, add_special_tokens=False).ids, "<u4")
            at = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            raw, lo = ids.tobytes(), 0
            for w, hi in zip(some, at, strict=True):
                self.known[w] = raw[lo:hi]
                lo = hi
        self.chars += sum(map(len, todo))

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [not PLAIN.search(t) and "<|" not in t for t in texts]
        if not all(plain):
            other = iter(super().encode([t for t, ok in zip(texts, plain) if not ok]))
        elif self.chars > CACHE_CHARS:
            self.known, self.chars = {}, 0
        cut = [WORD.findall(t.lower()) for t, ok in zip(texts, plain) if ok]
        if new := set().union(*cut).difference(self.known):
            self._learn_words(new)
        cut = iter(cut)
        return [b"".join(map(self.known.__getitem__, next(cut))) if ok else next(other) for ok in plain]


#: Fixed value: the pre-tokenizer's expression that ``WORD`` stands for.
WORD_EXPRESSION = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def encoder_kind(path: str) -> type[TreeEncoder]:
    """The way to encode with a vocabulary file: one of the two that know its cuts, else the library's own."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    steps = cut.get("pretokenizers") or [cut]
    names = [step.get("type") for step in steps]
    plain = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    if names == ["ByteLevel"] and cut.get("use_regex") and not cut.get("add_prefix_space") and spec.get("normalizer") is None and not model.get("end_of_word_suffix"):
        return TreeEncoder
    if names == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": WORD_EXPRESSION} and plain == ["NFC", "Replace", "Lowercase"] and model.get("end_of_word_suffix") == "</w>":
        return WordEncoder
    return WholeEncoder


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their place in the document, checksum, and rank among this task's pieces of their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, kind=encoder_kind(path))
        part = TaskContext.get().partitionId()
        ranks: dict[int, int] = defaultdict(int)
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            rows = []
            for s, texts in text_slices(b.column(1)):
                for doc_id, ids in zip(doc_ids[s], enc.encode(texts)):
                    ids += END_ID.to_bytes(4, "little")
                    n = len(ids) // 4
                    for k, at in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - at)
                        rows.append((doc_id, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), part, ranks[length]))
                        ranks[length] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def _knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The largest value of a pattern (how many of each size) that fits, and patterns: first the one
    of that value, then for each size the best that holds it. One round for each piece more.
    """
    best, took = np.zeros(capacity + 1), []
    order = np.argsort(sizes, kind="stable")
    # A size that no smaller one equals in value; the others are in no better pattern.
    useful = order[values[order] > np.maximum.accumulate(np.append(0, values[order]))[:-1]].tolist()
    while True:
        more, choice = best.copy(), np.full(capacity + 1, -1)
        for k in useful:
            s = sizes[k]
            value = best[: capacity + 1 - s] + values[k]
            better = value > more[s:] + 1e-12
            more[s:][better] = value[better]
            choice[s:][better] = k
        if (choice < 0).all():
            break
        took.append(choice)
        best = more
    m = len(sizes)
    patterns, room = np.vstack([np.zeros((1, m)), np.eye(m)]), np.append(capacity, capacity - sizes)
    for choice in reversed(took):
        rows = np.flatnonzero(choice[room] >= 0)
        k = choice[room[rows]]
        patterns[rows, k] += 1
        room[rows] -= sizes[k]
    return best[capacity], patterns


def configurations(sizes: list[int], demand: list[int], capacity: int, max_rounds: int = 5000) -> list[tuple[list[int], int]]:
    """Patterns and whole multiplicities covering at most the demand: the linear program's solution rounded down.

    Columns are added until what they cost is within half a sequence of a lower bound, the
    value of the duals scaled down to what any pattern allows. A round of pricing gives a pattern
    for each size, and those that still pay enter the basis one after another before the next.
    ``max_rounds`` only guards against a program that circles; reaching it is logged with the gap
    that is left.
    """
    m, size, ask = len(sizes), np.array(sizes), np.array(demand, float)
    basis, pool, least = np.diag(capacity // size).astype(float), np.empty((0, m)), 0.0
    # Kept by updates, and computed anew where they have drifted: the library's threads for it spin on long after.
    inverse = np.diag(1 / np.diag(basis))
    for turn in range(max_rounds):
        amount, duals = np.maximum(np.linalg.solve(basis, ask), 0), np.linalg.solve(basis.T, np.ones(m))
        if np.abs(inverse.sum(axis=0) - duals).max() > 1e-7:
            inverse = np.linalg.inv(basis)
        value, found = _knapsack(np.maximum(duals, 0), size, capacity)
        least = max(least, float(np.maximum(duals, 0) @ ask) / max(value, 1.0))
        if value <= 1 + 1e-9 or amount.sum() - least < 0.5:
            break
        if turn == max_rounds - 1:
            logging.getLogger(__name__).warning("packing: stopped with %.1f sequences over the lower bound of %.1f", amount.sum() - least, least)
        pool = np.vstack([found, pool[: 3 * m]])  # patterns of earlier rounds can pay again
        for step in range(2 * m):
            worth = np.einsum("ij,j->i", pool, duals)  # such small products aren't worth threads either
            column = pool[int(np.argmax(worth))]
            move = np.einsum("ij,j->i", inverse, column)
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(move > 1e-9, amount / move, np.inf)
            k = int(np.argmin(ratio))
            if worth.max() <= 1 + 1e-9 or not np.isfinite(ratio[k]):
                break
            amount = np.maximum(amount - ratio[k] * move, 0)
            amount[k] = ratio[k]
            basis[:, k] = column
            row = inverse[k] / move[k]
            inverse -= np.outer(move, row)
            inverse[k] = row
            duals = inverse.sum(axis=0)
        if step == 0:
            break
    out, left = [], list(demand)
    for p, a in sorted(zip(basis.T.astype(int).tolist(), amount.tolist()), key=lambda x: -x[1]):
        n = min([int(a + 1e-6), *(left[k] // p[k] for k in range(m) if p[k])])
        if n > 0:
            out.append((p, n))
            left = [x - n * y for x, y in zip(left, p)]
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, shares: tuple[float, ...] = LARGE) -> tuple[list[tuple], int]:
    """Runs ``(length, rank_lo, rank_hi, first_sequence, per_sequence, offset)`` and the number of sequences.

    A piece of that length and rank r in [lo, hi) lies in sequence ``first + (r - lo) // per``
    at ``offset + ((r - lo) % per) * length``.
    """
    volume = -(-sum(k * n for k, n in counts.items()) // capacity)
    best: tuple[list[tuple], int] | None = None
    for large in shares:
        if best is None or best[1] > volume:
            found = grouped_plan(counts, capacity, groups, large)
            best = found if best is None or found[1] < best[1] else best
    return best


def grouped_plan(counts: dict[int, int], capacity: int, groups: int, large: float) -> tuple[list[tuple], int]:
    """``plan`` with one share of large lengths."""
    runs: list[tuple] = []
    used = dict.fromkeys(counts, 0)
    bins = 0
    #: Open sequences as runs [residual, first, how many], sorted; residuals have at most ``capacity`` values.
    open_: list[tuple[int, int, int]] = []

    big = sorted((ln for ln in counts if ln > large * capacity), reverse=True)
    total = sum(counts[ln] for ln in big)
    if total:
        size, queue, each = [], [], -(-total // groups)
        have = 0
        for ln in big:  # equal cardinality: a length's pieces may lie in several groups
            n = counts[ln]
            while n:
                if have == 0:
                    size.append(ln)
                    queue.append([])
                take = min(n, each - have)
                queue[-1].append([ln, take])
                n, have = n - take, (have + take) % each
        merged: dict[int, int] = {}
        for k, s in enumerate(size):  # groups that round to one length are one size
            if s in merged:
                queue[merged[s]] += queue[k]
            else:
                merged[s] = k
        keys = list(merged.values())
        sizes, asks = [size[k] for k in keys], [sum(t for _, t in queue[k]) for k in keys]
        for pattern, n in configurations(sizes, asks, capacity):
            first, slots = bins, [keys[k] for k, c in enumerate(pattern) for _ in range(c)]
            bins += n
            fill = [(first, n, 0)]  # sequences [first, first + n) hold so many tokens
            for g in slots:
                nxt = []
                for at, many, tokens in fill:
                    while many:
                        ln, there = queue[g][0]
                        take = min(many, there)
                        runs.append((ln, used[ln], used[ln] + take, at, 1, tokens))
                        used[ln] += take
                        nxt.append((at, take, tokens + ln))
                        at, many = at + take, many - take
                        if take == there:
                            queue[g].pop(0)
                        else:
                            queue[g][0][1] -= take
                fill = nxt
            for at, many, tokens in fill:
                insort(open_, (capacity - tokens, at, many))
    for ln in sorted(counts, reverse=True):  # what the rounding left, then the small ones
        left = counts[ln] - used[ln]
        while left:
            lo = bisect_left(open_, (ln,))
            if lo == len(open_):
                per = capacity // ln
                many = -(-left // per)
                room, at = capacity, bins
                bins += many
            else:
                room, at, many = open_.pop(lo)
                per = room // ln
            full, part = divmod(min(left, per * many), per)
            if full:
                runs.append((ln, used[ln], used[ln] + full * per, at, per, capacity - room))
                used[ln] += full * per
                if room > per * ln:
                    insort(open_, (room - per * ln, at, full))
            if part:
                runs.append((ln, used[ln], used[ln] + part, at + full, per, capacity - room))
                used[ln] += part
                if room - part * ln:
                    insort(open_, (room - part * ln, at + full, 1))
            rest = many - full - bool(part)
            if rest and room:
                insort(open_, (room, at + full + bool(part), rest))
            left = counts[ln] - used[ln]
    return runs, bins


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece.

    Null text counts as empty and packs as its end mark alone; repeated rows and rows without an
    id are packed each; a text of any length is cut into as many pieces as it takes; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.keep(tokenized_pieces(docs, path, capacity, id_col, text_col))
    per_part = scratch.keep(rows.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = {r.length: r.total for r in per_part.groupBy("length").agg(F.sum("n").alias("total")).collect()}  # at most `capacity` rows
    runs, _ = plan(counts, capacity)
    table = spark.createDataFrame(runs, "length long, lo long, hi long, first long, per long, at long")
    # Rank over all tasks: a task's rank plus what earlier tasks hold of that length.
    before = per_part.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = rows.join(before, ["part", "length"]).withColumn("r", F.col("local_rank") + F.col("before"))
    # The runs are bounded by the number of lengths, not by the data: broadcast.
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi"))).select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        (F.col("first") + F.expr("(r - lo) div per")).alias("sequence_id"),
        (F.col("at") + (F.col("r") - F.col("lo")) % F.col("per") * ranked["length"]).cast("long").alias("offset"),
    )
    return scratch.finish(placed)
