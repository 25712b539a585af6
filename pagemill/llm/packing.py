"""Best-fit packing of token sequences by the configuration linear program.

The pieces' lengths form a histogram of at most ``capacity`` counts, which is all that reaches the driver. There the
configuration LP (fewest sequences so that every length is covered as often as it occurs) is solved by multiplicative weights:

* Each round prices lengths by their size times a weight. One unbounded-knapsack dynamic program over the capacities gives, for every
  length at once, the best-paid configuration that holds it. Lengths covered too little gain weight, so that the next round's
  configurations hold more of them. The prices, divided by the best configuration's, are a dual solution: a lower bound.
* Among the configurations known so far, the amounts of all that hold a length are multiplied by what it lacks (demand by
  cover), a length at a time, for a fixed number of sweeps. Covers and demands then differ by some percent, so the program is solved nearly, not exactly.

The amounts are rounded by systematic sampling: a running sum says how often each is used, as far as its lengths are left. What
rounding leaves is filled up best-fit, from the longest length left on. Rounds, steps and capacity bound the number of
configurations, whatever the rows.

Pieces find their place by their rank among those of their length: a rank in a salted group plus the group's base, so that
a length that most pieces have is spread over tasks.

Defined results: a null text is empty and yields one piece, its end token. Each row is a document, repeated rows, repeated and
null doc_ids too (pieces of equal rows change places freely, as they are equal). Other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import bpe
from .common import cut, map_rows, pick, row_ids

CAPACITY, END = 1024, 2


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but the first may be shorter."""
    first = n - (n - 1) // capacity * capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(documents: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""

    def make():
        coder = bpe(tokenizer)

        def f(b: pa.RecordBatch):
            cols: list[list] = [[] for _ in range(6)]
            for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                ids = np.append(coder.ids(t), np.uint32(end)).astype("<u4")
                for k, (s, n) in enumerate(cuts(len(ids), capacity)):
                    own = ids[s : s + n]
                    for c, v in zip(cols, (i, k, s, n, zlib.crc32(own.tobytes()), own.astype(np.int32))):
                        c.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")[: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t, _ in zip(cols, types, names)], list(names))

        return f

    return map_rows(pick(documents, doc_id="long", text="string"), make, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class Config(NamedTuple):
    uses: tuple[tuple[int, int], ...]  #: (length, copies)
    times: int


class Plan(NamedTuple):
    configs: list[Config]
    bound: float  #: no packing needs fewer sequences
    programmed: int  #: sequences that come from the LP, those of one full piece not counted
    filled: int  #: and those filled up best-fit


def knapsack(gain: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The most that lengths within each capacity can pay, and a length that a best choice takes there (0: none that fills it)."""
    lengths = np.flatnonzero(gain)
    pays = gain[lengths]
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        fit = np.searchsorted(lengths, c, side="right")
        best[c] = best[c - 1]
        if fit:
            v = best[c - lengths[:fit]] + pays[:fit]
            j = int(v.argmax())
            if v[j] > best[c]:
                best[c], took[c] = v[j], lengths[j]
    return best, took


def around(lengths: np.ndarray, took: np.ndarray, capacity: int) -> list[tuple[tuple[int, int], ...]]:
    """For each length, the best-paid configuration that holds it."""
    filled = np.maximum.accumulate(np.where(took > 0, np.arange(capacity + 1), 0))
    room, owner, member = filled[capacity - lengths], [np.arange(len(lengths))], [lengths]
    while room.any():
        still = np.flatnonzero(room)
        t = took[room[still]]
        owner.append(still), member.append(t)
        room[still] = filled[room[still] - t]
    key, n = np.unique(np.concatenate(owner) * (capacity + 1) + np.concatenate(member), return_counts=True)
    out: list[list] = [[] for _ in lengths]
    for o, l, k in zip((key // (capacity + 1)).tolist(), (key % (capacity + 1)).tolist(), n.tolist()):
        out[o].append((l, k))
    return [tuple(x) for x in out]


def program(counts: np.ndarray, capacity: int, rounds: int, sweeps: int) -> tuple[list[tuple[tuple[int, int], ...]], np.ndarray, float]:
    """Configurations, the amount of each in a nearly exact cover (some lengths get less than their demand, others more), and a lower bound of all covers."""
    rng = np.random.Generator(np.random.PCG64(7))
    lengths, demand, size = np.flatnonzero(counts), counts.astype(float), np.arange(capacity + 1) / capacity
    # dual solutions known beforehand: prices by size, and a price of 1 for whatever is over half the capacity
    bound = max(float(demand @ size), float(demand[capacity // 2 + 1 :].sum()))
    weight, amount = np.zeros(capacity + 1), np.empty(0)
    known: dict[tuple, int] = {}
    column, row, copies = [], [], []  # of the matrix of configurations
    for r in range(rounds):
        # ties abound where sequences are full; a slight jitter lets each round break them in another way
        jitter = rng.normal(0, 0.002, capacity + 1) * (r > 0)
        gain = np.where(demand > 0, size * np.exp(0.005 * weight + jitter), 0)
        best, took = knapsack(gain, capacity)
        bound = max(bound, float(demand @ gain) / best[capacity])
        for c in around(lengths, took, capacity):
            if c not in known:
                known[c] = len(known)
                for l, k in c:
                    column.append(known[c]), row.append(l), copies.append(k)
        amount = np.append(amount, np.full(len(known) - len(amount), bound / len(known)))
        col, rows, n = np.array(column), np.array(row), np.array(copies, dtype=float)
        share = n * size[rows]
        for _ in range(10):  # all lengths at once, each weighed by the part of the sequence that it takes
            cover = np.bincount(rows, weights=n * amount[col], minlength=capacity + 1)
            lack = np.zeros(capacity + 1)
            lack[lengths] = np.clip(np.log(demand[lengths] / np.maximum(cover[lengths], 1e-12)), -2, 2)
            weight = np.clip(weight + lack, -3, 3)
            amount *= np.exp(np.bincount(col, weights=share * lack[rows], minlength=len(amount)))
    order = np.argsort(rows, kind="stable")
    col, n, at = col[order], n[order], np.searchsorted(rows[order], np.arange(capacity + 2))
    for _ in range(sweeps):  # a length at a time
        for l in rng.permutation(lengths).tolist():
            own = col[at[l] : at[l + 1]]
            have = amount[own]
            amount[own] = have * (demand[l] / max(float(n[at[l] : at[l + 1]] @ have), 1e-12))
    return list(known), amount, bound


def rounded(counts: np.ndarray, capacity: int, configs: list, amount: np.ndarray, part: float) -> tuple[list[Config], list[Config]]:
    """What ``part`` of the LP's amounts gives in whole numbers, and the best-fit rest; together they hold each length as often as it occurs."""
    left = counts.copy()
    own: list[Config] = []
    rest: list[Config] = []

    def use(out: list[Config], uses, times: int) -> None:
        for l, n in uses:
            left[l] -= n * times
        out.append(Config(tuple(sorted(uses, reverse=True)), times))

    owed = 0.0
    for c in np.random.Generator(np.random.PCG64(11)).permutation(len(configs)).tolist():
        owed = min(owed, 2.0) + part * amount[c]
        times = min([int(owed), *(int(left[l]) // n for l, n in configs[c])])
        if times > 0:
            use(own, configs[c], times)
            owed -= times
    while left.any():  # from the longest length on, as tightly as the lengths left allow
        top = int(np.flatnonzero(left)[-1])
        chosen, room, spare = [top], capacity - top, left.copy()
        spare[top] -= 1
        small = np.flatnonzero(spare[: room + 1])
        while len(small):
            # a pair that fills the room exactly, if there is one, else the longest that fits
            mates = room - small
            exact = small[(spare[mates] > (mates == small)) & (mates > 0)] if len(small) > 1 else small[:0]
            take = [room] if spare[room] else [int(exact[-1]), room - int(exact[-1])] if len(exact) else [int(small[-1])]
            for t in take:
                chosen.append(t)
                spare[t] -= 1
                room -= t
            small = np.flatnonzero(spare[: room + 1]) if room else small[:0]
        ls, n = np.unique(chosen, return_counts=True)
        use(rest, list(zip(ls.tolist(), n.tolist())), max(1, int((left[ls] // n).min())))
    return own, rest


def plan(counts: np.ndarray, capacity: int, rounds: int = 50, sweeps: int = 80) -> Plan:
    """Configurations with how often each is used; together they hold every length exactly as often as counts[length] says.

    The more of the LP's amounts are rounded at once, the fewer lengths are left to fit the last ones together. So parts are tried
    from the largest on, until the sequences are within 0.2 % of the bound; otherwise that of the fewest is taken."""
    left = counts.astype(np.int64).copy()
    full, left[capacity] = int(left[capacity]), 0
    whole = [Config(((capacity, 1),), full)] if full else []
    if not left.any():
        return Plan(whole, full, 0, 0)
    configs, amount, bound = program(left, capacity, rounds, sweeps)
    best = None
    for part in (0.95, 0.9, 0.8, 0.7, 0.5):
        own, rest = rounded(left, capacity, configs, amount, part)
        n, m = (sum(c.times for c in x) for x in (own, rest))
        if best is None or n + m < best.programmed + best.filled:
            best = Plan(whole + own + rest, full + bound, n, m)
        if n + m <= 1.002 * bound + 1:
            break
    return best


def pack(frame: DataFrame, capacity: int = CAPACITY, group: int = 200) -> DataFrame:
    """The rows of ``frame`` (doc_id, piece, length and others) with sequence_id and offset. It is read more than once: give a written one."""
    histogram = frame.groupBy("length").count().collect()  # capacity rows at most
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram:
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece has length {length}")
        counts[length] = n
    # (length, first rank) -> copies in a bin, first bin, place of the first copy
    keys, copies, bins, places, used, first = [], [], [], [], np.zeros(capacity + 1, dtype=np.int64), 0
    for c in plan(counts, capacity).configs:
        at = 0
        for length, n in c.uses:
            keys.append((length, int(used[length]))), copies.append(n), bins.append(first), places.append(at)
            used[length] += n * c.times
            at += n * length
        first += c.times
    order = sorted(range(len(keys)), key=keys.__getitem__)
    lens, starts, copies, bins, places = (np.array(x, dtype=np.int64)[order] if len(order) else np.empty(0, np.int64) for x in ([k[0] for k in keys], [k[1] for k in keys], copies, bins, places))
    held = frame.sparkSession.sparkContext.broadcast((lens, starts, copies, bins, places))

    # a length that many pieces have is ranked in groups, of about as many rows as there are groups; pieces go by their place in the
    # files, so that equal ones part too
    salts = [max(1, -(-n // max(group, math.isqrt(n)))) for n in counts.tolist()]
    of_length = F.get(F.array(*map(F.lit, salts)), F.col("length").cast("int"))
    salted = row_ids(frame).withColumn("_salt", F.pmod(F.xxhash64("_file", "_row"), of_length).cast("int"))
    base = salted.groupBy("length", "_salt").count().withColumn("_base", F.sum("count").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_salt", F.coalesce("_base", F.lit(0)).alias("_base"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_file", "_row"))).join(base, ["length", "_salt"])

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lens, starts, copies, bins, places = held.value
        length, rank = length.to_numpy(), rank.to_numpy()
        big = np.int64(1) << np.int64(50)
        at = np.searchsorted(lens * big + starts, length * big + rank, side="right") - 1
        rel = rank - starts[at]
        return pd.DataFrame({"sequence_id": bins[at] + rel // copies[at], "offset": places[at] + rel % copies[at] * length})

    placed = ranked.withColumn("_p", place("length", F.col("_base") + F.col("_rank") - 1))
    return placed.select(*frame.columns, F.col("_p.sequence_id").alias("sequence_id"), F.col("_p.offset").alias("offset"))


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids: the packed token sequences themselves, from pieces made with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten(F.transform("p", lambda x: x.ids)).alias("ids"), F.transform("p", lambda x: x.doc_id).alias("doc_ids"))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None) -> DataFrame:
    return pack(cut(pieces(documents, capacity, end, tokenizer), "pieces"), capacity)


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
