"""Exact top-k inner products by no-random-access aggregation.

Each task holds one batch of vectors as one list per dimension, sorted by component. For a query, the lists are read
from the end that contributes most, all to the same depth, a chunk after the other; each entry read is added to its vector's partial sum.
What a vector has shown so far gives its lower bound (its unseen components at the lists' far ends) and its upper bound (at the
lists' current depth). Reading stops when no vector that hasn't been seen can reach the k-th best lower bound or the task's k best so far;
of the seen, those whose upper bound still can are resolved to exact scores. A task's first batch is small, so that the others have a bound to start from.

Queries come in blocks of at most ``block`` vectors, one after the other, which bounds what is collected and broadcast at a time.
Every task hands on k rows a query.

Defined results: a component is floor(scale * x) as an integer. Vectors that are null, empty, or hold null or non-finite
components take no part, nor do null ids. A query only meets vectors of its own dimension, and none of its own id.
Equal scores rank by id; repeated candidate rows each count. Rows that give a query id several vectors are one query, whose
candidates are scored with each of them. Sums are whole numbers: in doubles while these hold them exactly, else in 64 bits or Python's integers; scores
beyond 64 bits become the nearest that fits. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

SCALE, K = 1024, 10
FIRST = 512  #: rows of a task's first batch


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v: the usable vectors as integers."""
    usable = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    all_rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    whole = all_rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).filter(usable)
    return whole.select("vec_id", F.transform("x", lambda e: F.floor(e * scale).cast("long")).alias("v"))


class Lists:
    """A batch of vectors as sorted lists."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        order = np.argsort(rows, axis=0, kind="stable").T.astype(np.int32)  # a list for each dimension
        values = np.take_along_axis(rows.T, order, axis=1)
        # from the low end and from the high end
        self.order, self.values = np.stack([order, order[:, ::-1]]), np.stack([values, values[:, ::-1]])
        self.size = max(abs(int(rows.max())), abs(int(rows.min()))) * rows.shape[1]

    def best(self, query: np.ndarray, own: int, k: int, floor) -> tuple[np.ndarray, np.ndarray]:
        """ids and exact scores of the rows that may be among the k best, given that scores below ``floor`` (if any) are not."""
        n, d = self.rows.shape
        most = self.size * max(abs(int(query.max())), abs(int(query.min()))) * 2
        kind = float if most < 1 << 53 else np.int64 if most < 1 << 63 else object
        q, side, dims = query.astype(kind), (query >= 0).astype(np.int64), np.arange(d)
        last = self.values[1 - side, dims, 0].astype(kind) * q  # what an unseen component gives at least: the end that is read last
        step, depth, alive = max(16, n // 16), 0, None
        lower = np.full(n, last.sum(), dtype=kind)
        others = self.ids != own
        read = []
        while depth + step < n and alive is None:
            who = self.order[side, dims, depth : depth + step]
            gives = self.values[side, dims, depth : depth + step].astype(kind) * q[:, None]
            depth += step
            read.append((who, gives))
            self.add(lower, who, gives - last[:, None])
            edge = self.values[side, dims, depth - 1].astype(kind) * q  # and what an unseen one gives at most
            outside = edge.sum()
            if floor is not None and outside < floor:
                bound = floor
            elif np.count_nonzero(others) > k and (depth // step) % 2 == 0:
                bound = np.sort(lower[others])[-k] if kind is object else np.partition(lower[others], -k)[-k]
            else:
                continue
            if outside < bound:  # no outsider qualifies
                bound = bound if floor is None else max(bound, floor)
                upper = np.full(n, outside, dtype=kind)
                for who, gives in read:
                    self.add(upper, who, gives - edge[:, None])
                alive = np.flatnonzero((upper >= bound) & others)
        if alive is None:
            alive = np.flatnonzero(others)
        return self.ids[alive], self.rows[alive].astype(kind) @ q if len(alive) else np.empty(0, dtype=kind)

    @staticmethod
    def add(sums: np.ndarray, who: np.ndarray, what: np.ndarray) -> None:
        if sums.dtype == float:
            sums += np.bincount(who.ravel(), weights=what.ravel(), minlength=len(sums))
        else:
            np.add.at(sums, who.ravel(), what.ravel())


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score; both frames have vec_id and v (array of long)."""
    spark = vectors.sparkSession
    blocks = max(1, -(-queries.count() // block))
    found = []
    for i in range(blocks):
        by_size: dict[int, list] = {}
        for q in queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).distinct().collect():
            by_size.setdefault(len(q.v), []).append((q.vec_id, np.array(q.v, dtype=np.int64)))
        held = spark.sparkContext.broadcast([(d, [x for x, _ in qs], np.array([v for _, v in qs])) for d, qs in by_size.items()])

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            state: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

            def meet(b: pa.RecordBatch) -> None:
                offsets = b["v"].offsets.to_numpy()
                ids, lens, starts = b["vec_id"].to_numpy(zero_copy_only=False), np.diff(offsets), offsets[:-1]
                flat = b["v"].values.to_numpy(zero_copy_only=False)
                for d, qids, matrix in held.value:
                    rows = np.flatnonzero(lens == d)
                    if not len(rows):
                        continue
                    lists = Lists(ids[rows], flat[starts[rows][:, None] + np.arange(d)])
                    for j, qid in enumerate(qids):
                        had = state.get((d, j))
                        new_ids, scores = lists.best(matrix[j], qid, k, had[1][-1] if had is not None and len(had[1]) == k else None)
                        if had is not None:
                            new_ids, scores = np.concatenate([had[0], new_ids]), np.concatenate([had[1], scores])
                        first = np.lexsort((new_ids, -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(scores)), key=lambda x: (-scores[x], new_ids[x]))[:k], dtype=np.int64)
                        state[d, j] = new_ids[first], scores[first]

            for b in batches:
                first = FIRST if not state else 0
                if first:
                    meet(b.slice(0, first))
                if b.num_rows > first:
                    meet(b.slice(first))
            if state:
                qids = {d: x for d, x, *_ in held.value}
                q = np.concatenate([np.full(len(v[0]), qids[d][j]) for (d, j), v in state.items()])
                scores = [min(max(int(s), -(1 << 63)), (1 << 63) - 1) for v in state.values() for s in v[1].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([v[0] for v in state.values()])), pa.array(scores, pa.int64())], ["query_id", "vec_id", "score"])

        found.append(cut(vectors.mapInArrow(run, "query_id long, vec_id long, score long"), "best"))
        held.destroy()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return reduce(DataFrame.union, found).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))


ORACLE = """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
