"""Stored rows: lookup by key, value objects from flat columns, locations. Faults are a column, not an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, or none. The filter reaches the scan."""
    return rows.filter(F.col(key) == F.lit(value))


def saved(rows: DataFrame, changed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The table after saving changed rows, and those that it can't save: a row to be saved must be there already."""
    there = changed.join(rows.select(key), key, "left_semi")
    kept = rows.join(there.select(key), key, "left_anti")
    return kept.unionByName(there), changed.join(rows.select(key), key, "left_anti")


def location_problem(line_start: Column, line_end: Column, page_number: Column) -> Column:
    """lines (only one of both), order (not positive or not ordered), page (not positive), or null."""
    return (
        F.when(line_start.isNull() != line_end.isNull(), "lines")
        .when((line_start < 1) | (line_end < line_start), "order")
        .when(page_number < 1, "page")
    )


def _failure(rows: DataFrame) -> tuple[Column, Column]:
    code, message = F.col("failure_code"), F.col("failure_message")
    problem = F.when(code.isNull() & message.isNotNull(), "failure").when(strip(message) == "", "message")
    return F.when(code.isNotNull(), F.struct(code.alias("code"), message.alias("message"))), problem


def map_additions(rows: DataFrame) -> DataFrame:
    """Adds failure (code, message) and problem: failure where a message has no code, message where it is blank."""
    value, problem = _failure(rows)
    return rows.withColumns({"failure": value, "problem": problem})


def map_versions(rows: DataFrame) -> DataFrame:
    """Adds failure, projection (reference, indexed_chunk_count) and problem, also projection where one of its columns is missing."""
    value, problem = _failure(rows)
    reference, count = F.col("projection_ref"), F.col("indexed_chunk_count")
    projection = F.when(reference.isNotNull() & count.isNotNull(), F.struct(reference.alias("reference"), count.alias("indexed_chunk_count")))
    odd = F.when(reference.isNull() != count.isNull(), "projection")
    return rows.withColumns({"failure": value, "projection": projection, "problem": F.coalesce(problem, odd)})
