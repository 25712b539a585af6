"""Lifecycle: logs of states, allowed moves, invariants, failure codes, the status view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schemas import FAILURE_MESSAGE, SEED_KNOWLEDGE_BASE

# Allowed moves; None is the start.
MOVES = {
    "addition": ((None, "ACCEPTED"), ("ACCEPTED", "PROCESSING"), ("PROCESSING", "COMPLETED"), ("ACCEPTED", "FAILED"), ("PROCESSING", "FAILED")),
    "version": ((None, "PROCESSING"), ("PROCESSING", "SEARCHABLE"), ("PROCESSING", "FAILED")),
    "knowledge_base": ((None, "ACTIVE"), ("ACTIVE", "ARCHIVED")),
}
# Failure codes and the errors that they stand for, kinds of these errors included; anything else is PROCESSING_FAILED.
FAILURES = (
    ("OBJECT_STORAGE_UNAVAILABLE", ("ObjectStorageError", "ObjectAlreadyExistsError")),
    ("PDF_ENCRYPTED", ("PdfEncryptedError",)),
    ("NO_EXTRACTABLE_TEXT", ("PdfNoExtractableTextError", "NoTextContentError")),
    ("CONTENT_BLOCK_TOO_LARGE", ("ContentBlockTooLargeError",)),
    ("EMBEDDING_PROVIDER_UNAVAILABLE", ("EmbeddingProviderUnavailableError",)),
    ("EMBEDDING_RESPONSE_INVALID", ("EmbeddingResponseInvalidError",)),
    ("VECTOR_INDEX_UNAVAILABLE", ("VectorIndexError", "VectorIndexUnavailableError", "VectorIndexConfigurationError", "VectorPointInvalidError")),
    ("PARSING_FAILED", ("PdfParsingError", "InvalidTextEncodingError", "UnsupportedMediaTypeError", "TextPipelineError")),
)


def failure_code(error: Column) -> Column:
    out = F.when(error.isNull(), None)
    for code, names in FAILURES:
        out = out.when(error.isin(*names), code)
    return out.otherwise("PROCESSING_FAILED")


def transitions(log: DataFrame) -> DataFrame:
    """Adds previous and allowed to a log (entity, entity_id, seq, status): whether the state may follow the one before. If the log has
    them, a move must also bring what it needs: source_ref that isn't blank to process an addition, both ids to complete it, a
    failure_code to fail anything."""
    w = Window.partitionBy("entity", "entity_id").orderBy("seq")
    out = log.withColumn("previous", F.lag("status").over(w))
    ok = F.lit(False)
    for entity, moves in MOVES.items():
        for a, b in moves:
            ok = ok | (F.col("entity") == entity) & (F.col("previous").isNull() if a is None else F.col("previous") == a) & (F.col("status") == b)
    state, addition = F.col("status"), F.col("entity") == "addition"
    if "source_ref" in log.columns:
        ok = ok & (~(addition & (state == "PROCESSING")) | (strip(F.coalesce("source_ref", F.lit(""))) != ""))
    if {"document_id", "document_version_id"} <= set(log.columns):
        ok = ok & (~(addition & (state == "COMPLETED")) | F.col("document_id").isNotNull() & F.col("document_version_id").isNotNull())
    if "failure_code" in log.columns:
        ok = ok & ((state != "FAILED") | F.col("failure_code").isNotNull())
    return out.withColumn("allowed", F.coalesce(ok, F.lit(False)))


#: What a run commits, in order, with the states of the addition and its version from then on.
CHECKPOINTS = (("accept", "ACCEPTED", None), ("start", "PROCESSING", None), ("register", "PROCESSING", "PROCESSING"), ("complete", "COMPLETED", "SEARCHABLE"))
#: How many of them a run has made when it fails in a step.
STEPS = {"store": 1, "parse": 2, "embed": 3, "index": 3}


def checkpoints(runs: DataFrame) -> DataFrame:
    """addition_id, seq, checkpoint, status, version_status, failure_code: a row for each commit of each run (addition_id, failed_step,
    error). A run fails in one of STEPS, with a last commit of both failed states, or, with a null step, not at all."""
    kind = "array<struct<checkpoint: string, status: string, version_status: string, failure_code: string>>"
    text = lambda x: F.lit(x).cast("string")
    row = lambda a, b, c, d=None: F.struct(text(a).alias("checkpoint"), text(b).alias("status"), text(c).alias("version_status"), (text(None) if d is None else d).alias("failure_code"))
    made = F.array(*(row(*c) for c in CHECKPOINTS))
    code = failure_code(F.coalesce("error", F.lit("")))
    commits = F.when(F.col("failed_step").isNull(), made.cast(kind))
    for step, n in STEPS.items():
        last = row("fail", "FAILED", "FAILED" if n > 2 else None, code)
        commits = commits.when(F.col("failed_step") == step, F.concat(F.slice(made, 1, n), F.array(last)).cast(kind))
    return runs.select("addition_id", F.posexplode(commits).alias("seq", "_c")).select("addition_id", "seq", "_c.*")


def latest(log: DataFrame, key: str = "entity_id") -> DataFrame:
    """Each entity's last row: what a saved row would be."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col("seq")).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def addition_violations(additions: DataFrame) -> DataFrame:
    """Rows whose columns don't go with their status."""
    has = lambda c: F.col(c).isNotNull()
    source = F.coalesce(F.col("source_ref"), F.lit("")) != ""
    ids = has("document_id") & has("document_version_id")
    no_ids = ~has("document_id") & ~has("document_version_id")
    fine = (
        F.when(F.col("status") == "ACCEPTED", ~has("source_ref") & no_ids & ~has("failure_code"))
        .when(F.col("status") == "PROCESSING", source & no_ids & ~has("failure_code"))
        .when(F.col("status") == "COMPLETED", source & ids & ~has("failure_code"))
        .when(F.col("status") == "FAILED", no_ids & has("failure_code"))
        .otherwise(False)
    )
    return additions.filter(~F.coalesce(fine & (F.col("size_bytes") > 0), F.lit(False)))


def version_violations(versions: DataFrame) -> DataFrame:
    projected = strip(F.coalesce("projection_ref", F.lit(""))) != ""
    none = F.col("projection_ref").isNull() & F.col("indexed_chunk_count").isNull()
    fine = (
        F.when(F.col("status") == "PROCESSING", none & F.col("failure_code").isNull())
        .when(F.col("status") == "SEARCHABLE", projected & (F.coalesce("indexed_chunk_count", F.lit(0)) > 0) & F.col("failure_code").isNull())
        .when(F.col("status") == "FAILED", none & F.col("failure_code").isNotNull())
        .otherwise(False)
    )
    return versions.filter(~fine)


def status_view(additions: DataFrame, versions: DataFrame) -> DataFrame:
    """Additions with their version's state and count, which show only once the addition names it; else both are null."""
    v = versions.select(F.col("version_id").alias("document_version_id"), F.col("status").alias("version_status"), "indexed_chunk_count")
    return additions.join(v, "document_version_id", "left").select("addition_id", "status", "document_id", "document_version_id", "version_status", "indexed_chunk_count", "failure_code", F.when(F.col("failure_code").isNotNull(), FAILURE_MESSAGE).alias("failure_message"))


def fail(additions: DataFrame, versions: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after errors (addition_id, error and, to order several of one addition, seq): unfinished additions fail with
    their first error, and with them their registered versions."""
    order = F.struct(*(c for c in ("seq", "error") if c in errors.columns))
    e = errors.filter("error IS NOT NULL").groupBy("addition_id").agg(F.min_by("error", order).alias("_error")).select("addition_id", failure_code(F.col("_error")).alias("_code"))
    open_ = F.col("_code").isNotNull() & F.col("status").isin("ACCEPTED", "PROCESSING")
    a = additions.join(e, "addition_id", "left").withColumn("failure_code", F.when(open_, F.col("_code")).otherwise(F.col("failure_code"))).withColumn("status", F.when(open_, "FAILED").otherwise(F.col("status"))).drop("_code")
    running = F.col("_code").isNotNull() & (F.col("status") == "PROCESSING")
    v = versions.join(e, "addition_id", "left").withColumn("failure_code", F.when(running, F.col("_code")).otherwise(F.col("failure_code"))).withColumn("status", F.when(running, "FAILED").otherwise(F.col("status"))).drop("_code")
    return a, v


def seed_knowledge_bases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([SEED_KNOWLEDGE_BASE], "kb_id string, kb_status string")


def put_objects(existing: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects to append, and those refused because their key is taken, also by another of ``fresh``: of these the least row wins."""
    keys, rest = existing.select("object_key").distinct(), [c for c in fresh.columns if c != "object_key"]
    new = fresh.join(keys, "object_key", "left_anti").groupBy(*fresh.columns).agg(F.count("*").alias("_n"))
    first = new.groupBy("object_key").agg(F.min(F.struct(*rest)).alias("_first"))
    put = first.select("object_key", *(F.col(f"_first.{c}").alias(c) for c in rest)).select(*fresh.columns)
    again = new.join(first, "object_key").withColumn("_n", F.col("_n") - F.when(F.struct(*rest).eqNullSafe(F.col("_first")), 1).otherwise(0)).filter("_n > 0")
    twice = again.withColumn("_n", F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int")))).select(*fresh.columns)
    return put, fresh.join(keys, "object_key", "left_semi").select(*fresh.columns).union(twice)
