"""Sharding by a two-pass external shuffle.

First pass: every record is scattered, by a seeded hash of its place in the input, into one of as many buckets as make a bucket fit
in memory (by bytes). Second pass: each bucket is shuffled by Fisher-Yates with its own seeded generator. A record's place in the
whole order is its bucket's base plus its place in the bucket; records are dealt to the shards in turn, so that counts
differ by one at most (law ``rows``) and slots have no gaps.

Defined results: a null text has size 8 and the checksum of no bytes. Equal rows are records of their own, as are rows of repeated or null ids. For the same files and
seed, each record gets the same slot, also where a task is run again. Extra columns pass through ``shuffle_shards``; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts, row_ids

SHARDS = 24
ROW = ("_file", "_row")


def shuffle_shards(records: DataFrame, shards: int = SHARDS, seed: int = 17, bucket_bytes: int = 4 << 20) -> DataFrame:
    """All columns of ``records`` plus shard and slot. ``bucket_bytes``: mean bytes of a bucket, so that it fits in memory; a single
    record may be larger. Buckets come from the record's file and row (or number, where it isn't from a file), so no value can fill one."""
    records_ = row_ids(records)
    texts = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in records.schema if f.dataType.typeName() in ("string", "binary")]
    size = sum(texts, F.lit(16 * len(records.columns)))
    n_bytes = records.select(size.alias("n")).agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-n_bytes // bucket_bytes))
    where = lambda df: df.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), "_file", "_row"), F.lit(buckets)))
    counts = where(records_.select(*ROW)).groupBy("_bucket").count()
    # bases in two steps, so that no task holds all buckets' counts: blocks of a thousand buckets, then within them
    block = F.floor(F.col("_bucket") / 1000)
    blocks = counts.groupBy(block.alias("_block")).agg(F.sum("count").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = counts.withColumn("_block", block).withColumn("_in", F.coalesce(F.sum("count").over(Window.partitionBy("_block").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bases = inner.join(blocks.select("_block", "_before"), "_block").select("_bucket", (F.col("_before") + F.col("_in")).alias("_base"))
    # as many partitions as the bytes ask for, whatever the session's number of shuffle partitions
    scattered = where(records_).join(bases, "_bucket").repartition(max(parts(records.sparkSession), -(-n_bytes // (64 << 20))), "_bucket")

    def fisher_yates(table: pa.Table) -> pa.Table:
        b = table["_bucket"][0].as_py()
        table = table.sort_by([("_file", "ascending"), ("_row", "ascending")])  # the same start, whatever order the shuffle delivers
        order = np.arange(table.num_rows)
        draws = np.random.Generator(np.random.PCG64([seed, b])).random(table.num_rows)
        for i in range(table.num_rows - 1, 0, -1):
            j = int(draws[i] * (i + 1))
            order[i], order[j] = order[j], order[i]
        table = table.take(pa.array(order))
        place = pa.array(np.arange(table.num_rows, dtype=np.int64) + table["_base"][0].as_py())
        return table.drop_columns(["_bucket", "_base", *ROW]).append_column("_place", place)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema) + ", _place long"
    placed = scattered.select(*(F.col(f"`{c}`") for c in records.columns), "_bucket", "_base", *ROW).groupBy("_bucket").applyInArrow(fisher_yates, schema)
    return placed.select(*(F.col(f"`{c}`") for c in records.columns), F.pmod("_place", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("_place") / shards).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, each sorted by slot."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shuffle_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return sharded.select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
