"""Ingestion of a folder that files arrive in. Ours: the batch operators, run on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MEDIA_EXTENSIONS


def stream_uploads(spark: SparkSession, path: str, kb_id: str, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands each micro-batch of new files, as uploads, to ``sink``; give it an idempotent one (upsert)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    kinds = F.create_map(*[F.lit(x) for m, es in MEDIA_EXTENSIONS.items() for e in es for x in (e, m)])
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.readStream.format("binaryFile").schema(schema).load(path)
    rows = files.select(F.sha2("path", 256).alias("upload_id"), F.lit(kb_id).alias("kb_id"), name.alias("filename"), kinds[F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))].alias("media_type"), "content")
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
