"""Toxicity by weak supervision.

1.  Voters. From a bounded sample of labelled documents, words and word beginnings that mark
    toxic documents are found by their likelihood ratio. Strong ones become lexicon voters
    (whole words) and pattern voters (beginnings), dealt to ``VOTERS`` voters by kind and
    purity.
2.  Label model. All documents are voted on, and the number of documents with each vote
    vector (at most 2 ** VOTERS) is what a generative model is fitted to by expectation
    maximisation: a class prior, each voter's accuracy in each class, and, as a tree of the
    strongest conditional dependencies, the correlations between voters. Labelled documents
    enter with their known class.
3.  Classifier. Documents get the model's posterior as a soft label; a logistic regression on
    counts of all marks found, strong and weak, and on the number of voters is trained on a bounded sample of them and
    scores every document.

Labels are learned only from rows that ``held_out`` leaves; language, source, id and label are
never inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackroom.llm.bpe import release_encoders, text_slices
from stackroom.llm.common import Scratch

#: Labelled documents of each class from which marks are found, the first by a hash of their id.
MAX_LABELLED = 4000
#: Documents of each side of the posterior on which the classifier is trained.
MAX_TRAINED = 4000
VOTERS = 12
#: Marks: kept at most, least likelihood ratio of a kept one and of one that votes.
MARKS, WEAK, STRONG = 512, 15.0, 40.0
#: A strong mark is in toxic documents this many times as often as in others.
LIFT = 20.0
BEGINNINGS = (3, 4, 5)

WORD = re.compile(r"[^\W\d_]+")


def marks_of(text: str) -> set[str]:
    """Distinct lower-cased words, and as ``^abc`` the beginnings of longer ones."""
    words = set(WORD.findall(text.lower()))
    return words.union(*({f"^{w[:n]}" for w in words if len(w) > n} for n in BEGINNINGS))


def held_out(id_col):
    """True where crc32 of the id as text is 0 modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass
class Model:
    """What the executors need: ``marks`` to columns, which voter a column votes for (-1: none), and the classifier."""

    marks: dict[str, int]
    voter: np.ndarray
    weights: np.ndarray
    bias: float


def find_marks(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[tuple[str, float, float, bool]]:
    """``(mark, likelihood ratio, lift, in no clean one)`` of the marks of toxic documents, the best first, at most ``MARKS``."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = None
    for toxic in (0, 1):
        part = known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        some = part if some is None else some.union(part)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        for b in batches:
            for s, texts in text_slices(b.column(0)):
                tally: list[Counter] = [Counter(), Counter()]
                for t, y in zip(texts, b.column(1)[s].to_pylist()):
                    tally[y].update(marks_of(t))
                names = list(tally[0] | tally[1])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([tally[0][n] for n in names], pa.int64()), pa.array([tally[1][n] for n in names], pa.int64())], names=["mark", "n0", "n1"])

    sample = docs.join(F.broadcast(some), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))
    n = {r.toxic: r.n for r in some.join(docs.select("doc_id"), "doc_id").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return []
    found = sample.mapInArrow(count, "mark string, n0 long, n1 long").groupBy("mark").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n1 > 3")
    r0, r1 = (F.col("n0") + 0.5) / (n[0] + 1), (F.col("n1") + 0.5) / (n[1] + 1)
    rate = (F.col("n0") + F.col("n1") + 1) / (n[0] + n[1] + 2)
    ratio = 2 * (F.col("n1") * F.log(r1 / rate) + F.col("n0") * F.log(r0 / rate) + (n[1] - F.col("n1")) * F.log((1 - r1) / (1 - rate)) + (n[0] - F.col("n0")) * F.log((1 - r0) / (1 - rate)))
    found = found.select("mark", ratio.alias("ratio"), (r1 / r0).alias("lift"), (F.col("n0") == 0).alias("pure")).where((F.col("ratio") >= WEAK) & (F.col("lift") > 1.5))
    return [tuple(r) for r in found.orderBy(F.desc("ratio"), "mark").limit(MARKS).collect()]


def deal_voters(marks: list[tuple[str, float, float, bool]], n_voters: int = VOTERS) -> np.ndarray:
    """The voter of each mark, -1 for weak ones.

    Words go to the first half of the voters and beginnings to the second; in each, marks that
    no clean sample document has go to the first half in turn, the others to the second, so
    that the marks of a voter are about equally reliable.
    """
    voter, turn = np.full(len(marks), -1), Counter()
    quarter = n_voters // 4
    for i, (mark, ratio, lift, pure) in enumerate(marks):
        if ratio >= STRONG and lift >= LIFT:
            block = 2 * mark.startswith("^") + (not pure)
            voter[i] = block * quarter + turn[block] % quarter
            turn[block] += 1
    return voter


def vote(docs: DataFrame, marks: list[tuple[str, float, float, bool]], voter: np.ndarray) -> DataFrame:
    """``doc_id, votes, cols, counts``: the vote vector as bits, and how many distinct words carry each mark."""
    names = {m: i for i, (m, *_) in enumerate(marks)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        whole = {m: i for m, i in names.items() if m[0] != "^"}
        begin = {m[1:]: i for m, i in names.items() if m[0] == "^"}
        heads = {w[:3] for w in begin}
        for b in batches:
            ids = b.column(0)
            for s, texts in text_slices(b.column(1)):
                votes, cols, counts = [], [], []
                for t in texts:
                    seen: Counter = Counter()
                    for w in set(WORD.findall(t.lower())):
                        if w in whole:
                            seen[whole[w]] += 1
                        if w[:3] in heads:
                            for n in BEGINNINGS:
                                if len(w) > n and w[:n] in begin:
                                    seen[begin[w[:n]]] += 1
                    bits = 0
                    for i in seen:
                        if voter[i] >= 0:
                            bits |= 1 << int(voter[i])
                    votes.append(bits)
                    cols.append(list(seen))
                    counts.append(list(seen.values()))
                yield pa.RecordBatch.from_arrays([ids[s], pa.array(votes, pa.int32()), pa.array(cols, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "votes", "cols", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, votes int, cols array<int>, counts array<int>")


def _tree(v: np.ndarray, weight: np.ndarray) -> list[int]:
    """Parent of each voter (-1: root) in the tree of largest pairwise mutual information under ``weight``."""
    m, total = v.shape[1], weight.sum() + 1e-9
    info = np.zeros((m, m))
    for x in (0, 1):
        for y in (0, 1):
            a, b = (v == x).astype(float), (v == y).astype(float)
            joint = (a.T @ (b * weight[:, None]) + 1e-3) / total
            pa_, pb = (a.T @ weight + 1e-3) / total, (b.T @ weight + 1e-3) / total
            info += joint * np.log(joint / np.outer(pa_, pb))
    parent, best, inside = [-1] * m, info[0].copy(), {0}
    link = [0] * m
    while len(inside) < m:
        j = max((k for k in range(m) if k not in inside), key=lambda k: best[k])
        parent[j] = link[j]
        inside.add(j)
        for k in range(m):
            if k not in inside and info[j, k] > best[k]:
                best[k], link[k] = info[j, k], j
    return parent


def label_model(votes: np.ndarray, n: np.ndarray, n_known: np.ndarray, n_voters: int = VOTERS, rounds: int = 500) -> np.ndarray:
    """Posterior of the toxic class for each distinct vote vector.

    ``n`` documents have the vector; of them ``n_known[:, y]`` are labelled y. The model is a
    prior and, in each class, a tree of voters with P(vote | parent's vote, class).
    """
    v = (votes[:, None] >> np.arange(n_voters)) & 1
    free = np.maximum(n - n_known.sum(1), 0)
    post = np.where(votes > 0, 0.9, 0.02)
    for _ in range(rounds):
        weight = np.stack([free * (1 - post) + n_known[:, 0], free * post + n_known[:, 1]])
        prior = (weight.sum(1) + 1) / (weight.sum() + 2)
        logs = np.repeat(np.log(prior)[:, None], len(votes), 1)
        for y in (0, 1):
            parent = _tree(v, weight[y])
            rates = (v.T @ weight[y] + 0.5 * (1 + y)) / (weight[y].sum() + 1 + y)
            for j in range(n_voters):
                p = np.full(len(votes), rates[j])
                if parent[j] >= 0:
                    up = v[:, parent[j]]
                    for x in (0, 1):
                        w = weight[y] * (up == x)
                        p[up == x] = ((w * v[:, j]).sum() + 2 * rates[j]) / (w.sum() + 2)
                logs[y] += np.log(np.where(v[:, j] == 1, p, 1 - p))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))
        if np.abs(new - post).max(initial=0) < 1e-6:
            break
        post = new
    return post


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 25, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Soft-label logistic regression by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = np.r_[np.full(x.shape[1] - 1, penalty), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, max_trained: int = MAX_TRAINED) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    Marks are found in ``max_labelled`` documents of each class, the classifier is trained on
    ``max_trained`` of each side. Null text counts as empty; a text of any length is read whole; one without marks gets the classifier's base rate; repeated
    rows get equal scores; a document labelled twice counts as toxic if either label says so;
    without labels of both classes outside the held-out fold every score is 0; an empty table
    gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    fold = held_out(F.col("doc_id")).alias("held_out")
    marks = find_marks(docs, labels, max_labelled)
    if not marks:
        return docs.select("doc_id", fold, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    voter = deal_voters(marks)
    scratch = Scratch(spark)
    voted = scratch.keep(vote(docs, marks, voter))

    known = labels.where("toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    tally = voted.select("doc_id", "votes").join(known, "doc_id", "left").groupBy("votes").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 0).alias("n0"), F.count_if(F.col("toxic") == 1).alias("n1"))
    rows = sorted(tuple(r) for r in tally.collect())  # at most 2 ** VOTERS
    votes, n, n_known = np.array([r[0] for r in rows], int), np.array([r[1] for r in rows], float), np.array([r[2:] for r in rows], float).reshape(-1, 2)
    post = dict(zip(votes.tolist(), label_model(votes, n, n_known).tolist()))

    table = spark.createDataFrame([(k, p) for k, p in post.items()], "votes int, p double")
    soft = voted.join(F.broadcast(table), "votes").where("doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    sides, size = [], {}
    for side, part in (("toxic", F.col("p") >= 0.5), ("clean", F.col("p") < 0.5)):
        got = soft.where(part).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(max_trained).select("cols", "counts", "p", "votes").collect()
        size[side] = sum(m for v, m in zip(votes.tolist(), n) if (post[v] >= 0.5) == (side == "toxic"))
        sides += [(r.cols, r.counts, r.p, size[side] / max(len(got), 1), r.votes.bit_count()) for r in got]
    x = np.zeros((len(sides), len(marks) + 3))
    for i, (cols, counts, _, _, n_votes) in enumerate(sides):
        x[i, cols] = np.log1p(counts)
        x[i, -3:] = n_votes >= 1, n_votes >= 2, np.log1p(n_votes)
    weight = np.array([s[3] for s in sides])
    w, bias = logistic(x, np.array([s[2] for s in sides]), weight / max(weight.mean(), 1e-9)) if sides else (np.zeros(len(marks) + 3), -30.0)

    # The sum over a document's few marks stays in the JVM: a table of at most MARKS numbers, as a literal.
    coef, n_votes = F.array(*[F.lit(float(c)) for c in w[:-3]]), F.bit_count("votes")
    by_votes = (n_votes >= 1).cast("double") * float(w[-3]) + (n_votes >= 2).cast("double") * float(w[-2]) + F.log1p(n_votes.cast("double")) * float(w[-1])
    terms = F.zip_with("cols", "counts", lambda c, k: F.element_at(coef, c + 1) * F.log1p(k.cast("double")))
    score = 1 / (1 + F.exp(-(by_votes + F.aggregate(terms, F.lit(float(bias)), lambda a, t: a + t))))
    out = voted.select("doc_id", fold, score.alias("score"))
    return scratch.finish(out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
