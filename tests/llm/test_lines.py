"""Line dedup against brute force."""

import random
import re

import pytest

from stackroom.llm.line_dedup import line_dedup


def brute(rows, min_words):
    """rows: (doc_id, text), distinct ids. Deletes every shortest run that occurs at an earlier place."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        if text is None:
            out[doc_id] = (None, 0, 0)
            continue
        lines = text.split("\n")
        words = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
        gone = set()
        for i in range(len(lines)):
            n = k = 0
            while i + k < len(lines) and n < min_words:
                n += words[i + k]
                k += 1
            if n >= min_words:
                run = tuple(lines[i : i + k])
                if run in seen:
                    gone.update(range(i, i + k))
                seen.add(run)
        out[doc_id] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out


def check(spark, rows, min_words):
    got = {r.doc_id: (r.text, r.n_lines, r.n_deleted) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_words).collect()}
    assert got == brute(rows, min_words)


@pytest.mark.parametrize("seed, min_words, alphabet", [(1, 3, 2), (2, 9, 3), (3, 6, 12), (4, 40, 2)])
def test_equals_brute_force(spark, seed, min_words, alphabet):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 4))) for _ in range(alphabet)]
    rows = [(k * 37 % 1009, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 40)))) for k in range(60)]
    check(spark, rows, min_words)


def test_documents_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, 50)


def test_edge_cases(spark):
    long_ = " ".join(["w"] * 60)
    rows = [(1, None), (2, ""), (3, long_), (4, f"a\n{long_}\n\nb"), (5, f"{long_}\n{long_}"), (6, "\n\n"), (7, "x y")]
    check(spark, rows, 50)
    twice = spark.createDataFrame([(None, long_), (9, long_), (9, long_), (None, None)], "doc_id long, text string").selectExpr("*", "1 AS spans", "2 AS i")
    got = sorted((str(r.doc_id), str(r.text), r.n_deleted) for r in line_dedup(twice).collect())
    assert got == [("9", long_, 0), ("9", long_, 0), ("None", "", 1), ("None", "None", 0)]
    assert line_dedup(twice.limit(0)).count() == 0


def brute_maximal(rows, min_words):
    """Deletes every sequence of lines with ``min_words`` words, of any length, that occurs at an earlier place."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        lines = text.split("\n")
        words = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
        gone = set()
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(words[i:j]) >= min_words:
                    if (run := tuple(lines[i:j])) in seen:
                        gone.update(range(i, j))
                    seen.add(run)
        out[doc_id] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out


def whole(spark, rows, min_words):
    return {r.doc_id: (r.text, r.n_lines, r.n_deleted) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_words, maximal=True).collect()}


@pytest.mark.parametrize("seed, min_words, alphabet", [(5, 3, 2), (6, 9, 3), (7, 6, 12), (8, 40, 2)])
def test_maximal_runs_equal_brute_force(spark, seed, min_words, alphabet):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 4))) for _ in range(alphabet)]
    rows = [(k * 37 % 1009, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 25)))) for k in range(40)]
    assert whole(spark, rows, min_words) == brute_maximal(rows, min_words)


def test_maximal_runs_go_to_their_last_line(spark):
    line = lambda c, n: " ".join([c] * n)
    rows = [(1, "\n".join(["p", line("a", 30), line("b", 30), line("c", 10)])), (2, "\n".join(["q", line("a", 30), line("b", 30), line("c", 10), "r"]))]
    rows += [(3, "\n".join([line("d", 60), line("e", 10), "", "x"])), (4, "\n".join([line("d", 60), line("f", 10)])), (5, "\n".join([line("d", 60), line("f", 10)]))]
    got = whole(spark, rows, 50)
    assert got == brute_maximal(rows, 50)
    # The longer copy counts, not the first: document 4 shares one line with 3, and 5 shares two with 4.
    assert [got[k][2] for k in (1, 2, 3, 4, 5)] == [0, 3, 0, 1, 2]
