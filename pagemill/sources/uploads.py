"""Uploads: the files source, checks in their fixed order, media-type routing, object keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schemas import MEDIA_EXTENSIONS

MAX_BYTES = 20 * 1024 * 1024
STATUS = {"KB_NOT_FOUND": 404, "KB_NOT_ACTIVE": 409, "TOO_LARGE": 413, "UNSUPPORTED_MEDIA_TYPE": 415, "INVALID_CONTENT": 422, "EMPTY": 422}


def read_files(spark: SparkSession, path: str, kb_id: str, media_types: dict[str, str] | None = None) -> DataFrame:
    """Files below a path as uploads (upload_id, kb_id, filename, media_type, content)."""
    by_suffix = media_types or {e: m for m, es in MEDIA_EXTENSIONS.items() for e in es}
    name = F.element_at(F.split("path", "/"), -1)
    kinds = F.create_map(*[F.lit(x) for pair in by_suffix.items() for x in pair])
    return spark.read.format("binaryFile").load(path).select(F.sha2("path", 256).alias("upload_id"), F.lit(kb_id).alias("kb_id"), name.alias("filename"), kinds[F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))].alias("media_type"), "content")


def media_type(raw: Column) -> Column:
    return F.lower(strip(F.split(raw, ";")[0]))


def parameters_ok(raw: Column) -> Column:
    """No parameters, or, of text types, only charset=utf-8."""
    parts = F.split(raw, ";")
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    plain = F.forall(rest, lambda p: F.lower(strip(p)).isin("charset=utf-8", 'charset="utf-8"'))
    return (F.size(parts) == 1) | media_type(raw).startswith("text/") & plain


def base_name(filename: Column) -> Column:
    return strip(F.element_at(F.split(F.regexp_replace(filename, r"[\\/]+$", ""), r"[\\/]"), -1))


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^.].*?(\.[^.]+)$", 1))


def validate(uploads: DataFrame, bases: DataFrame | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Adds name, route (the media type) and reject_code, the first check that fails, with its http_status.

    ``bases`` (kb_id, kb_status): uploads to missing or inactive knowledge bases are turned away after the content checks."""
    name, kind = base_name(F.col("filename")), media_type(F.col("media_type"))
    content = F.col("content").cast("binary")
    fits = F.lit(False)
    for m, es in MEDIA_EXTENSIONS.items():
        fits = fits | (kind == m) & suffix(name).isin(*es)
    bad_bytes = F.when(kind == "application/pdf", F.substring(content, 1, 5) != F.lit(b"%PDF-")).otherwise(~F.is_valid_utf8(content.cast("string")))
    code = (
        F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, "EMPTY")
        .when(F.octet_length(content) > max_bytes, "TOO_LARGE")
        .when(F.coalesce(name, F.lit("")).isin("", ".", ".."), "UNSUPPORTED_MEDIA_TYPE")
        .when(~F.coalesce(kind.isin(*MEDIA_EXTENSIONS), F.lit(False)), "UNSUPPORTED_MEDIA_TYPE")
        .when(~fits, "UNSUPPORTED_MEDIA_TYPE")
        .when(~parameters_ok(F.col("media_type")), "UNSUPPORTED_MEDIA_TYPE")
        .when(bad_bytes, "INVALID_CONTENT")
    )
    out = uploads.withColumn("name", name).withColumn("route", kind).withColumn("reject_code", code)
    if bases is not None:
        out = out.join(bases.select("kb_id", "kb_status"), "kb_id", "left")
        out = out.withColumn("reject_code", F.coalesce("reject_code", F.when(F.col("kb_status").isNull(), "KB_NOT_FOUND").when(F.col("kb_status") != "ACTIVE", "KB_NOT_ACTIVE")))
    status = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return out.withColumn("http_status", F.coalesce(status[F.col("reject_code")], F.lit(202)))


def object_key(kb_id: Column, addition_id: Column, filename: Column) -> Column:
    return F.concat(F.lit("knowledge-bases/"), kb_id, F.lit("/additions/"), addition_id, F.lit("/source"), suffix(filename))


def decoded(content: Column) -> Column:
    """UTF-8 text without one leading byte-order mark; null if it isn't UTF-8."""
    return F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^\ufeff", "")


def query_suite(spark: SparkSession, path: str) -> DataFrame:
    """suite_id, query_id, text, purpose, problem of a JSON query suite; blank fields and repeated ids are named, not raised."""
    raw = spark.read.schema("suite_id string, description string, queries array<struct<id: string, text: string, purpose: string>>").json(path, multiLine=True)
    return suite_rows(raw)


def suite_rows(suites: DataFrame) -> DataFrame:
    rows = suites.select("suite_id", F.explode_outer("queries").alias("q")).select("suite_id", F.col("q.id").alias("query_id"), F.col("q.text").alias("text"), F.col("q.purpose").alias("purpose"))
    repeated = rows.groupBy("suite_id", "query_id").agg((F.count("*") > 1).alias("repeated"))
    blank = lambda c: strip(F.coalesce(F.col(c), F.lit(""))) == ""
    problem = F.when(blank("query_id") | blank("text") | blank("purpose"), "blank").when(F.col("repeated"), "repeated")
    return rows.join(repeated, ["suite_id", "query_id"], "left").withColumn("problem", problem).drop("repeated")
