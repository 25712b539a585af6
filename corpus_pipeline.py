"""A training corpus from ``documents``: language ID, near-dedup, decontamination, secrets, packing.

Rows go by their place in the files that a stage reads, not by doc_id, so null and repeated ids lose no clean row and keep no copy.
All stages but the last return the columns of ``documents``, extra ones too, and pass empty tables on. A null text is no document to the first
stage; later stages keep it, and packing makes one piece of it, its end token. Texts are handled whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import decontaminate, langid, near_dedup, packing, secrets
from pagemill.llm.common import cut, row_ids

#: A document is rejected if it has no letters or if no language gets this probability.
LEAST_SCORE = 0.35
ROW = ("_file", "_row")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` (with row ids) but those named in ``gone``, without their ids."""
    return docs.join(gone.select(*ROW), list(ROW), "left_anti").drop(*ROW)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; null and empty texts have none."""
    found = langid.identify(docs, langid.learn(docs))
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the least doc_id (null comes last, of equal ones the first written); rows
    without words stay."""
    rows = row_ids(docs)
    return _without(rows, cut(near_dedup.repeated_rows(rows), "gone"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has no passage of the benchmark, whatever other rows have the same doc_id."""
    rows = row_ids(docs)
    found = decontaminate.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=ROW)
    return _without(rows, cut(found.filter(F.size("spans") > 0).select(*ROW), "gone"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    return secrets.drop_secrets(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, each with its place."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", benchmark), ("secrets", redact), ("pack", pack)]

#: Near-duplicate sketches, a trained model and a tokenizer can't be put in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
