"""Catalog queries against their SQL where figures leave the ranges of the small tables."""

import duckdb
import pandas as pd

import __spark_entry__ as driver


def both(spark, folder, name, docs):
    """A query's rows over ``docs`` and those of its SQL, sorted."""
    docs.to_parquet(f"{folder}/documents.parquet", index=False)
    frame = driver.queries()[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    want = con.execute(driver.oracle_sql()[name])
    assert frame.columns == [c[0] for c in want.description]
    return sorted(map(tuple, frame.collect())), sorted(want.fetchall())


def test_summary_computes_no_times_that_it_does_not_report(spark, tmp_path):
    rows = [(k, f"text {k // 3}", ("de", "en")[k % 2], f"src{k % 20}", 5 + k // 3) for k in range(60_000, 60_240)]
    rows += [(k, f"alone {k}", "en", f"src{k % 20}", k) for k in range(90_000, 90_020)]
    got, want = both(spark, tmp_path, "redundancy_summary", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    assert got == want and got[0][0] > 0 and got[0][7] > 0


def test_expected_bytes_that_end_in_a_half_round_as_in_sql(spark, tmp_path):
    rows = [(1, "a", "en", "src1", 2856), (2, "b", "en", "src2", 1044), (3, "c", "fr", "src3", 2120), (4, "d", "fr", "src4", 1032), (9, "e", "fr", "src5", 3110), (6, "f", "fr", "src6", 4638)]
    got, want = both(spark, tmp_path, "coverage_buckets", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    assert got == want and {r[0]: r[3] for r in got} == {"total": 666, "filed": 176, "unfiled": 491, "collection en": 176}
