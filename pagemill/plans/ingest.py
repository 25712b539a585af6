"""The whole way: uploads to validated, parsed, normalized, structured and chunked documents, and their points.

Failures are data: each document carries the first error_code it meets, and goes no further; ``outcomes`` has a row for each upload.
Plain texts stay native all the way but for NFC and sections too long for one chunk; Python gets null for the others' rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import composed, normalize_nodes, one_line
from ..operators import chunking, lifecycle, structure, vectors
from ..schemas import NODES
from ..sources import parsers, uploads

PLAIN = "text/plain"
RESULT = f"struct<nodes: {NODES}, error_code: string>"


def _simple(nodes: Column) -> Column:
    """Nodes without pages or code, their texts in NFC already: only white space is left to do, a node at a time."""
    return F.filter(F.transform(nodes, lambda n: n.withField("text", one_line(n.text))), lambda n: n.text != "")


def normalized(docs: DataFrame) -> DataFrame:
    """Nodes in normal form; documents without text get an error. One fold a document, as hyphens are judged by all its words."""

    def run(nodes: pd.Series, errors: pd.Series) -> pd.DataFrame:
        out = [([], e) if e else normalize_nodes([n if isinstance(n, dict) else n.asDict() for n in (ns if ns is not None else [])]) for ns, e in zip(nodes, errors)]
        return pd.DataFrame({"nodes": [o[0] for o in out], "error_code": [o[1] for o in out]})

    # else a filter on error_code is pushed below, and all documents are normalized twice
    f = F.pandas_udf(run, RESULT).asNondeterministic()
    return docs.withColumn("_n", f("nodes", "error_code")).withColumn("nodes", F.col("_n.nodes")).withColumn("error_code", F.col("_n.error_code")).drop("_n")


def parsed(checked: DataFrame) -> DataFrame:
    """doc_key, nodes, error_code of validated text uploads. Markdown is parsed and normalized by one Python function, which gets null for other
    rows; plain texts have no pages and no code, so only NFC and white space are left to do for them."""

    def markdown(texts: pd.Series) -> pd.DataFrame:
        out = [(None, None) if t is None else normalize_nodes(parsers.markdown_nodes(t)) for t in texts]
        return pd.DataFrame({"nodes": [o[0] for o in out], "error_code": [o[1] for o in out]})

    plain, marked = F.col("route") == PLAIN, F.col("route") == "text/markdown"
    docs = checked.filter(F.col("reject_code").isNull()).withColumnRenamed("upload_id", "doc_key").withColumn("text", uploads.decoded(F.col("content")))
    docs = docs.withColumn("_m", F.pandas_udf(markdown, RESULT).asNondeterministic()(F.when(marked, F.col("text"))))
    # line ends and white space are the same before and after NFC, so a plain text is composed whole
    docs = docs.withColumn("_p", composed(F.when(plain, F.col("text"))))
    docs = docs.withColumn("_p", _simple(parsers.paragraph_nodes(F.col("_p"))))
    error = (
        F.when(~F.coalesce(plain | marked, F.lit(False)), "UNSUPPORTED_MEDIA_TYPE")
        .when(F.col("text").isNull(), "PARSING_FAILED")
        .when(marked, F.col("_m.error_code"))
        .when(F.size("_p") == 0, "NO_EXTRACTABLE_TEXT")
    )
    nodes = F.coalesce(F.when(marked, F.col("_m.nodes")).otherwise(F.col("_p")), F.array().cast(NODES))
    return docs.select("doc_key", nodes.alias("nodes"), error.alias("error_code"))


def structured(docs: DataFrame) -> DataFrame:
    """Node rows with roles, paths and sections, of the roles that are indexed."""
    nodes = structure.explode_nodes(docs.filter(F.col("error_code").isNull()))
    kept = structure.select_indexed(structure.classify_roles(structure.compose_headings(nodes)))
    return structure.sections(structure.heading_paths(kept))


def _chunked(docs: DataFrame, profile: chunking.Profile, count: chunking.TokenCounter) -> DataFrame:
    return chunking.chunk_sections(structure.section_units(structured(docs)), profile, count)


def chunks(docs: DataFrame, profile: chunking.Profile = chunking.Profile(), count: chunking.TokenCounter = chunking.words) -> DataFrame:
    """doc_key, chunk_index and the chunks' columns."""
    return chunking.number_chunks(_chunked(docs, profile, count))


def outcomes(checked: DataFrame, docs: DataFrame, profile: chunking.Profile = chunking.Profile(), count: chunking.TokenCounter = chunking.words) -> DataFrame:
    """doc_key, n_chunks, error_code of every upload: the check that turned it away, the error of its parsing or of its chunks, or
    NO_EXTRACTABLE_TEXT if the role policy left it nothing."""
    made = _chunked(docs, profile, count).groupBy("doc_key").agg(F.sum(F.size("chunks")).alias("_n"), F.min("error_code").alias("_late"))
    early = docs.select("doc_key", F.col("error_code").alias("_early"))
    rows = checked.select(F.col("upload_id").alias("doc_key"), "reject_code").join(early, "doc_key", "left").join(made, "doc_key", "left")
    nothing = F.when(F.coalesce("_n", F.lit(0)) == 0, "NO_EXTRACTABLE_TEXT")
    error = F.coalesce("reject_code", "_early", "_late", nothing)
    return rows.select("doc_key", F.when(error.isNull(), F.col("_n")).otherwise(0).alias("n_chunks"), error.alias("error_code"))


def points(chunked: DataFrame, version: str = "doc_key") -> DataFrame:
    """Chunks with the ids under which they are stored."""
    return chunked.withColumn("id", vectors.point_id(F.col(version), F.col("chunk_index")))


def embedded(chunked: DataFrame, provider: Callable[[], Callable[[list[str]], list[list[float]]]], dimension: int, batch: int = 16, model: vectors.Model | None = None) -> DataFrame:
    """Chunks with their vectors or error codes. Write them before they are indexed, else the provider is asked again at each reading."""
    return vectors.embed(chunked, provider, dimension, batch, model).drop("input")


def indexed(stored: DataFrame | None, made: DataFrame, dimension: int, collection: str, seq: int = 0, version: str = "doc_key") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The points after the embedded chunks are put in, projections (doc_key, collection, indexed_chunk_count) and errors (doc_key,
    error_code). A document is indexed whole or, if a chunk has an error or a point has a fault, not at all.

    ``version`` is the column of version ids (UUIDs), one for each doc_key; ``seq`` orders puts of one version."""
    failed = made.groupBy("doc_key").agg(F.min("error_code").alias("error_code")).filter("error_code IS NOT NULL")
    whole = made.join(failed.select("doc_key"), "doc_key", "left_anti").drop("error_code").withColumns({"document_version_id": F.col(version), "seq": F.lit(seq)})
    points, done = vectors.index(stored, whole, dimension, collection)
    keys = whole.select("doc_key", "document_version_id").distinct()
    faulty = keys.join(done, "document_version_id", "left_anti").select("doc_key", F.lit("VECTOR_INDEX_UNAVAILABLE").alias("error_code"))
    return points, keys.join(done, "document_version_id").drop("document_version_id"), failed.unionByName(faulty)


def statuses(checked: DataFrame, early: DataFrame, done: DataFrame, late: DataFrame) -> DataFrame:
    """doc_key, status, version_status, indexed_chunk_count, failure_code of each accepted upload at the end of its run. early: ``outcomes``;
    done and late: the projections and errors of ``indexed``. A document that fails before it is embedded has no version; with
    neither projection nor error, one is PROCESSING still."""
    accepted = checked.filter(F.col("reject_code").isNull()).select(F.col("upload_id").alias("doc_key"))
    # a code of parsing that the lifecycle doesn't know is that of the error behind it
    code = F.when(F.col("error_code") == "UNSUPPORTED_MEDIA_TYPE", lifecycle.failure_code(F.lit("UnsupportedMediaTypeError"))).otherwise(F.col("error_code"))
    rows = accepted.join(early.select("doc_key", code.alias("_early")), "doc_key", "left")
    rows = rows.join(late.groupBy("doc_key").agg(F.min("error_code").alias("_late")), "doc_key", "left").join(done.select("doc_key", "indexed_chunk_count"), "doc_key", "left")
    failure, found = F.coalesce("_early", "_late"), F.col("indexed_chunk_count").isNotNull()
    status = F.when(failure.isNotNull(), "FAILED").when(found, "COMPLETED").otherwise("PROCESSING")
    version = F.when(F.col("_early").isNotNull(), None).when(F.col("_late").isNotNull(), "FAILED").when(found, "SEARCHABLE").otherwise("PROCESSING")
    return rows.select("doc_key", status.alias("status"), version.alias("version_status"), F.when(failure.isNull(), F.col("indexed_chunk_count")).alias("indexed_chunk_count"), failure.alias("failure_code"))
