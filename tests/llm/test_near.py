"""MinHash and embedding near-dedup against brute force."""

import random
import re

import numpy as np
import pytest

from stackroom.llm import embedding_dedup, minhash

SF = "/root/testdata/sf0.001"


def roots(ids, links):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {i: top(i) for i in ids}


def brute_documents(rows, percent=80):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    component = roots(ids, links)
    return {i: (len(sets[i]), component[i], component[i] == i) for i in ids}


def check_documents(spark, rows, percent=85, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, percent=percent, **options).collect()}
    assert got == brute_documents(rows, percent)


def corpus(seed, n_bases, copies, length, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for _ in range(n_bases):
        base = [rng.choice(vocabulary) for _ in range(length)]
        if rng.random() < 0.7:
            base[10:10] = passage
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 100_003, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed, n_bases, copies, length, edits", [(1, 4, 60, 120, 6), (2, 60, 4, 40, 3), (3, 2, 80, 700, 30), (4, 150, 2, 12, 1)])
def test_minhash_equals_brute_force(spark, seed, n_bases, copies, length, edits):
    check_documents(spark, corpus(seed, n_bases, copies, length, edits))


def test_minhash_small_sketch_loses_no_link(spark):
    check_documents(spark, corpus(5, 3, 40, 300, 12), k=96, leader_rounds=1)


def test_minhash_at_another_similarity(spark):
    check_documents(spark, corpus(6, 40, 6, 60, 4), percent=80)


def test_minhash_on_the_documents_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_documents(spark, rows)


def test_minhash_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE "), (6, "a b c d"), (7, "A b c d"), (8, "a b c d"), (9, "É é"), (10, "é é")]
    check_documents(spark, rows)
    odd = spark.createDataFrame([(None, "x y"), (3, "x y"), (3, "x y"), (None, None)], "doc_id long, text string").selectExpr("*", "1 AS kept", "2 AS component_id", "3 AS uid")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.near_duplicates(odd).collect())
    assert got == [("3", 1, "3", True), ("3", 1, "3", True), ("None", 0, "None", True), ("None", 1, "3", False)]
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def brute_vectors(rows, threshold=0.98):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float)
        return v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max())

    units = [(i, label, unit(v)) for i, v, label in rows]
    links = [(a, b) for x, (a, la, va) in enumerate(units) for b, lb, vb in units[x + 1 :] if la is not None and la == lb and va is not None and vb is not None and len(va) == len(vb) and va @ vb >= threshold]
    component = roots([i for i, _, _ in units], links)
    return {i: (sum(i in pair for pair in links), component[i], component[i] == i) for i in component}


def check_vectors(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.link_vectors(df, **options).collect()}
    assert got == brute_vectors(rows)


def test_vectors_equal_brute_force_over_many_cells(spark):
    rng = np.random.default_rng(7)
    rows = []
    for c in range(60):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 14)):
            v = centre + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.16, 0.2, 0.4])
            rows.append((len(rows), [float(x) for x in v * rng.uniform(0.1, 9)], int(c % 3)))
    check_vectors(spark, rows, cell=8, block=16)
    check_vectors(spark, rows)


def test_vectors_on_the_embeddings_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    check_vectors(spark, rows, cell=16, block=32)


def test_vectors_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [1.0, 0.0], None), (7, [1.0, 0.0], 1), (8, [2.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1), (10, [None, 1.0], 1), (11, [1.0, 0.0], 2)]
    check_vectors(spark, rows)
    assert embedding_dedup.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
