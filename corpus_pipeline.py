"""The corpus pipeline: five stages over ``documents``, each one operator, each over all its predecessor kept.

``STAGES`` are ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame. All but the last return the columns of ``documents``, fewer rows or changed text;
the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.llm import bpe, exact_dedup, minhash, packing, pii, toxicity
from stackroom.llm.common import Scratch

#: Fitting, label models, shared voters and loopy messages have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is in ``dropped``; rows with a null id stay."""
    return docs.join(dropped.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts as toxic go.

    Null and empty texts carry no mark and stay, as do rows with a null id; texts of any length
    are read whole; rows that repeat go or stay together; an id with several texts goes if one
    of them is toxic; an empty table stays empty; other columns, whatever their names, pass.
    """
    scores = toxicity.score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scores.where("predicted = 1"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, also where rows repeat; an id that stands for several texts keeps the others.

    Null counts as an empty text, and empty texts are equal; of equal texts the longest original,
    then the smallest id, null last, stays; texts of any length are read whole; an empty table
    stays empty; other columns pass, also ones with names that are used here.
    """
    found = exact_dedup.exact_dedup(docs)
    taken = {c.lower() for c in docs.columns}
    own, sha = (next(n for n in (f"{'_' * k}{name}" for k in range(1, 99)) if n.lower() not in taken) for name in ("id", "sha"))
    key = lambda rows: rows.select(F.col("doc_id").alias(own), F.col("text_sha256").alias(sha)).distinct()
    stays, lost = key(found.where("kept")), key(found.where("NOT kept"))
    gone = lost.join(stays, lost[own].eqNullSafe(stays[own]) & (lost[sha] == stays[sha]), "left_anti")
    again = lost.join(stays, lost[own].eqNullSafe(stays[own]) & (lost[sha] == stays[sha]), "left_semi")
    # The hash goes through the joins under a name that no column has.
    hashed = "_" + sha
    rows = docs.withColumn(hashed, exact_dedup.text_sha256("text"))

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        return left.join(right, left["doc_id"].eqNullSafe(right[own]) & (left[hashed] == right[sha]), how)

    once = joined(rows, gone, "left_anti")
    if not again.isEmpty():
        once = joined(once, again, "left_anti").unionByName(joined(once, again, "left_semi").dropDuplicates(["doc_id", hashed]))
    return once.select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the document with the smallest id stays; an id goes if none of its rows is to stay.

    Near means a similarity of 0.8 or more of five-word shingles, the rule of every stage that
    has no contract of its own. Null, empty and wordless texts are like nothing and stay, as do
    rows with a null id; texts of any length are read whole; equal rows stay or go together; an
    empty table stays empty; other columns, whatever their names, pass.
    """
    found = minhash.near_duplicates(docs).where("doc_id IS NOT NULL")
    return _without(docs, found.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; ``n_chars`` follows the text.

    Null texts stay null, with null ``n_chars``, and empty ones empty; texts of any length are
    read whole; every row stays, repeated ones and those with a null id too; an empty table
    stays empty; other columns, whatever their names, pass.
    """
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids: one row a piece, as the packing operator gives it.

    Null and empty texts are their end mark alone; rows that repeat and rows with a null id are
    packed each; longer texts are cut; an empty table gives no pieces; other columns go.
    """
    return packing.pack(docs, bpe.public_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return scratch.finish(STAGES[-1][1](spark, docs, sf_dir))
