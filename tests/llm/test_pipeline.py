"""Each pipeline stage against a brute-force version on its own input."""

import re

import corpus_pipeline
from stackroom.llm import pii, toxicity
from tests.llm.test_near import brute_documents

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "minhash_near_dedup", "pii", "best_fit_packing"]
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}

    scores = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == columns
    assert rows(clean) == {i: t for i, t in rows(docs).items() if not scores[i]}

    once = stages["exact_dedup"](spark, clean, SF)
    best = {}
    for i, t in sorted(rows(clean).items()):
        bare = re.sub("[\x20\x09-\x0d]", "", t or "")
        if bare not in best or len(t or "") > len(best[bare][1] or ""):
            best[bare] = (i, t)
    assert once.columns == columns and rows(once) == dict(best.values())

    apart = stages["minhash_near_dedup"](spark, once, SF)
    kept = {i for i, (_, _, k) in brute_documents(list(rows(once).items())).items() if k}
    assert apart.columns == columns and rows(apart) == {i: t for i, t in rows(once).items() if i in kept}

    masked = stages["pii"](spark, apart, SF)
    assert masked.columns == columns and set(rows(masked)) == kept
    assert all(not pii.base_spans(t) for t in rows(masked).values())
    assert all(r.n_chars == len(r.text) for r in masked.collect())

    packed = stages["best_fit_packing"](spark, masked, SF).collect()
    assert {r.doc_id for r in packed} == kept
    filled = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 4096
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


def test_repeated_rows_and_nulls(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "other"), (2, "ab "), (None, "a  b"), (3, None), (3, None)], "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "3L AS n_chars")
    got = sorted((str(r.doc_id), str(r.text)) for r in corpus_pipeline.drop_exact_copies(spark, docs, SF).collect())
    assert got == [("1", "other"), ("3", "None"), ("None", "a  b")]
    assert corpus_pipeline.mask_personal_data(spark, docs, SF).count() == 7
    assert corpus_pipeline.drop_near_copies(spark, docs, SF).columns == docs.columns


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
