"""Repeated substrings by distributed prefix doubling over anchored positions.

Wanted: every byte covered by a string of ``length`` bytes that also starts elsewhere. Ranking every suffix would shuffle tens
of times the input, so ranks are kept for units of neighbouring starts, and only as long as they are not settled:

* Each start p has an anchor, chosen by the bytes behind p alone: of the ``reach`` positions from p on, the one whose next
  ``gram`` bytes hash least. Starts of one anchor form a run; equal strings have equal anchors at equal distances.
* A round ranks units by their core, the bytes that the strings of all its starts share, and then by their hull, the bytes that
  any of them covers. Units whose core is unique are dropped: none of their strings repeats. Units whose hull occurs
  twice are done: all of their strings repeat. The others, with one unit of each repeated hull beside them, are split and
  go to the next round, whose cores are longer: runs (41 bytes), then eight starts (193), then single starts (200).

As in prefix doubling, positions are ranked by ever longer prefixes until unique or past the threshold; a rank is a 128-bit
hash that stands for the rank pair, so nothing is sorted globally, and a very frequent passage is a count with partial
sums and a join that AQE may split.

Defined results: a null text has no bytes. Rows that repeat a document repeat its strings. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, bitmap, cut, in_bitmap, map_rows, mix, pick, signed

LENGTH, GRAM, STEP = 200, 32, 8
_rng = np.random.Generator(np.random.PCG64(2024))
BYTE = _rng.integers(0, 1 << 64, size=(2, 256), dtype=np.uint64)
BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: list = [None, None]


def powers(n: int, family: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse's powers modulo 2**64, for i below n; kept and grown by need."""
    have = _powers[family]
    if have is None or len(have[0]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        out = []
        with np.errstate(over="ignore"):
            for b in (BASE[family], pow(BASE[family], -1, 1 << 64)):
                p = np.full(m, U64(b))
                p[0] = 1
                out.append(np.cumprod(p, dtype=np.uint64))
        have = _powers[family] = (out[0], out[1])
    return have


class Hashes:
    """Hashes of any substrings of some bytes, from prefix sums."""

    def __init__(self, data: np.ndarray, families: int = 2):
        self.sums = []
        with np.errstate(over="ignore"):
            for f in range(families):
                p = powers(len(data) + 1, f)[0]
                self.sums.append(np.concatenate([np.zeros(1, U64), np.cumsum(BYTE[f][data] * p[: len(data)], dtype=np.uint64)]))

    def grams(self, k: int) -> np.ndarray:
        """A hash of the k bytes from each position on, good in its upper bits."""
        s = self.sums[0]
        x = s[k:] - s[:-k]
        x *= powers(len(s), 0)[1][: len(x)]
        x ^= x >> U64(31)
        x *= U64(0xBF58476D1CE4E5B9)
        return x

    def of(self, start: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
        s = self.sums[family]
        with np.errstate(over="ignore"):
            return mix((s[end] - s[start]) * powers(len(s), family)[1][start] + (end - start).astype(U64))


def runs(h: Hashes, n: int, reach: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchor, first start, last start of each run of n bytes' starts."""
    if n < length:
        return (np.empty(0, np.int64),) * 3
    key = h.grams(GRAM)
    key &= U64(0xFFFFFFFF00000000)
    key |= np.arange(0xFFFFFFFF, 0xFFFFFFFF - len(key), -1).view(U64)  # the rightmost of equals
    width = 1
    while width * 2 <= reach:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < reach:
        key = np.minimum(key[: len(key) - (reach - width)], key[reach - width :])
    anchor = (U64(0xFFFFFFFF) - (key[: n - length + 1] & U64(0xFFFFFFFF))).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
    return anchor[first], first, np.concatenate([first[1:] - 1, [n - length]])


UNIT = "row_key long, c1 long, c2 long, g1 long, g2 long, a long, p long, q long, mine boolean"
NAMES = [x.split()[0] for x in UNIT.split(", ")]


def split(lists: pa.ListArray):
    """The fields of each row's structs, as arrays; lists of many small objects would take twenty times the memory."""
    fields = [x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten()]
    ends = np.cumsum(lengths(lists))
    for at, end in zip([0, *ends[:-1]], ends):
        yield [x[at:end] for x in fields]


def lengths(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)


def units(docs: DataFrame, level: int, reach: int, length: int, seen=None, only_core: bool = False) -> DataFrame:
    """The units of a round. docs: row_key, text and, after the first round, todo (a, p, q, mine of the units to split)."""

    def make():
        def rows(key: int, text: str, todo):
            data = np.frombuffer((text or "").encode(), dtype=np.uint8)
            if len(data) < length:
                return None
            h = Hashes(data, 1 if only_core else 2)
            if level == 0:
                a, p, q = runs(h, len(data), reach, length)
                s, e = a, a + (length + 1 - reach)
                mine = np.ones(len(a), dtype=bool)
                if seen is not None:
                    keep = in_bitmap(h.of(s, e), seen.value)
                    a, p, q, s, e, mine = (x[keep] for x in (a, p, q, s, e, mine))
                tag = U64(0)
            else:
                step = STEP if level == 1 else 1
                a, p, q, mine = todo
                # blocks are counted back from the anchor, so that they agree between documents
                low = (a - q) // step
                count = (a - p) // step - low + 1
                at = np.repeat(np.arange(len(a)), count)
                a, p, q, mine = a[at], p[at], q[at], mine[at]
                hi = a - (np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + low[at]) * step
                p, q = np.maximum(hi - step + 1, p), np.minimum(hi, q)
                s = a - (a - q) // step * step
                e = s - (step - 1) + length
                if level == 1:
                    tag = ((a - q) // step).astype(U64)  # the distance from the anchor is part of a block's name
                else:
                    s, e, tag = p, p + length, U64(0)
            if not len(a):
                return None
            c1 = signed(h.of(s, e))
            if only_core:
                return c1
            with np.errstate(over="ignore"):
                c2, g1, g2 = (signed(x + tag) for x in (h.of(s, e, 1), h.of(p, q + length), h.of(p, q + length, 1)))
            return [np.full(len(a), key), c1, c2, g1, g2, a, p, q, mine]

        def f(b: pa.RecordBatch):
            todo = split(b["todo"]) if level else repeat(None)
            out, size = [], 0
            for key, text, own in zip(b["row_key"].to_pylist(), b["text"], todo):
                got = rows(key, text.as_py(), own)
                if got is not None:
                    out.append(got)
                    size += len(got) if only_core else len(got[0])
                if size > 200_000:
                    yield batch(out)
                    out, size = [], 0
            if out:
                yield batch(out)

        def batch(out):
            if only_core:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], ["c1"])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], NAMES)

        return f

    return map_rows(docs, make, "c1 long" if only_core else UNIT)


def settle(rows: DataFrame, length: int, last: bool, name: str) -> tuple[DataFrame, DataFrame | None]:
    """Spans (row_key, s, e) of the units that are done, and those (row_key, a, p, q, mine) to split."""
    # written first: AQE splits a skewed join only if neither side was aggregated in the stage of the join
    again = cut(rows.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.max("mine").alias("any")).filter("n > 1 AND any").select("c1", "c2"), f"{name}-again")
    kept = cut(rows.join(again, ["c1", "c2"]), name)
    span = lambda df: df.select("row_key", F.col("p").alias("s"), (F.col("q") + length).alias("e"))
    if last:
        return span(kept.filter("mine")), None
    hulls = cut(kept.groupBy("c1", "c2", "g1", "g2").agg(F.count("*").alias("n"), F.min(F.struct("row_key", "a", "p", "q", "mine")).alias("u")), f"{name}-hulls")
    twice = hulls.filter("n > 1").select("c1", "c2", "g1", "g2")
    done = span(kept.filter("mine").join(twice, ["c1", "c2", "g1", "g2"]))
    open_cores = cut(hulls.filter("n = 1 AND u.mine").select("c1", "c2").distinct(), f"{name}-open")
    todo = hulls.join(open_cores, ["c1", "c2"]).select("u.row_key", "u.a", "u.p", "u.q", ((F.col("n") == 1) & F.col("u.mine")).alias("mine"))
    return done, todo


def repeated_spans(documents: DataFrame, length: int = LENGTH, reach: int = 160) -> DataFrame:
    """doc_id, text and spans: sorted, separate byte ranges (s, e) that repeated strings of ``length`` bytes cover."""
    if length < reach + GRAM - 1 or reach < 2 * STEP or length + 1 - reach < GRAM:
        raise ValueError("length must be at least reach + 31")
    sc = documents.sparkSession.sparkContext
    docs = pick(documents, doc_id="long", text="string").withColumn("row_key", F.xxhash64("doc_id", "text"))
    keyed = docs.select("row_key", "text")
    # first, the short cores alone: which occur twice at all; a bitmap of bounded size then thins out the full units
    twice = cut(units(keyed, 0, reach, length, only_core=True).groupBy("c1").count().filter("count > 1").select("c1"), "cores")
    seen = sc.broadcast(bitmap(twice, "c1"))
    spans, rows = None, units(keyed, 0, reach, length, seen)
    for level in (0, 1, 2):
        done, todo = settle(rows, length, level == 2, f"level{level}")
        spans = done if spans is None else spans.union(done)
        if level == 0:
            seen.destroy()  # its units are written; the driver needn't hold every bitmap until the end
        if todo is None:
            break
        per = cut(todo.groupBy("row_key").agg(F.collect_list(F.struct("a", "p", "q", "mine")).alias("todo")), f"todo{level}")
        rows = units(_only(keyed, _held(per)).dropDuplicates(["row_key"]).join(per, "row_key"), level + 1, reach, length)
    merged = cut(spans.groupBy("row_key").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("found")), "spans")
    hits = _held(merged)
    maybe = _only(docs, hits)
    none = F.array().cast("array<struct<s: bigint, e: bigint>>")
    # documents outside the bitmap surely have none, so their texts needn't move
    clean = _only(docs, hits, inside=False).select("doc_id", "text", none.alias("spans"))

    def join_up():
        def f(b: pa.RecordBatch):
            n = lengths(b["found"])
            row = np.repeat(np.arange(len(n)), n)
            s, e = (x.to_numpy() + (row << 40) for x in b["found"].flatten().flatten())  # rows apart by more than any length
            e = np.maximum.accumulate(e)
            new = np.ones(len(s), dtype=bool)
            new[1:] = s[1:] > e[:-1]
            last = np.roll(new, -1)  # the first span is always new, so the last row is always a last one
            own, base = row[new], row[new] << 40
            ends = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(n)))]).astype(np.int32)
            merged = pa.StructArray.from_arrays([pa.array(s[new] - base), pa.array(e[last] - base)], ["s", "e"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text"], pa.ListArray.from_arrays(pa.array(ends), merged)], ["doc_id", "text", "spans"])

        return f

    hit = map_rows(maybe.join(merged, "row_key", "left").select("doc_id", "text", "found"), join_up, "doc_id long, text string, spans array<struct<s: bigint, e: bigint>>")
    return hit.unionByName(clean)


def doubled_spans(documents: DataFrame, length: int = LENGTH, first: int = 25) -> DataFrame:
    """doc_id, s, e: the same ranges by plain prefix doubling of every position, a row for each range. Ranks are exact: places in the
    sorted order of the first ``first`` bytes, then of pairs of the ranks at a position and at a growing offset. Unique positions leave after
    each round; the last offset is what makes the prefix ``length`` long. Its shuffles are many times its input, so it is not what op10 runs."""
    if not 0 < first <= length:
        raise ValueError("first must be positive, and at most length")
    docs = cut(pick(documents, doc_id="long", text="string").withColumn("row", F.monotonically_increasing_id()), "rows")

    def make():
        def f(b: pa.RecordBatch):
            for row, text in zip(b["row"].to_pylist(), b["text"].to_pylist()):
                data = (text or "").encode()
                n = len(data) - first + 1 if len(data) >= length else 0
                for at in range(0, n, 100_000):
                    p = np.arange(at, min(at + 100_000, n))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), row)), pa.array(p), pa.array([data[i : i + first] for i in p], pa.binary())], ["row", "p", "x"])

        return f

    def rerank(rows: DataFrame, *by: str) -> DataFrame:
        found = rows.groupBy(*by).count().filter("count > 1").select(*by)
        ranks = cut(found.orderBy(*by).withColumn("place", F.monotonically_increasing_id()), "ranks")
        return cut(rows.join(ranks, list(by)).select("row", "p", F.col("place").alias("rank")), "ranked")

    h = first
    ranked = rerank(map_rows(docs.select("row", "text"), make, "row long, p long, x binary"), "x")
    while h < length:
        step = min(h, length - h)
        behind = ranked.select("row", (F.col("p") - step).alias("p"), F.col("rank").alias("next"))
        ranked = rerank(ranked.join(behind, ["row", "p"]), "rank", "next")
        h += step
    w = Window.partitionBy("row").orderBy("p")
    start = F.coalesce(F.col("p") > F.lag("p").over(w) + length, F.lit(True))
    runs_ = ranked.withColumn("start", start.cast("int")).withColumn("run", F.sum("start").over(w))
    spans = runs_.groupBy("row", "run").agg(F.min("p").alias("s"), (F.max("p") + length).alias("e"))
    return docs.select("row", "doc_id").join(spans, "row").select("doc_id", "s", "e")


def _held(keys: DataFrame):
    """The row_key of some documents as a bitmap of bounded size, on all machines."""
    return keys.sparkSession.sparkContext.broadcast(bitmap(keys, "row_key"))


def _only(docs: DataFrame, held, inside: bool = True) -> DataFrame:
    """The documents whose row_key may be in the bitmap; or those whose key surely isn't."""

    def make():
        def f(b: pa.RecordBatch):
            got = in_bitmap(b["row_key"].to_numpy(zero_copy_only=False).view(U64), held.value)
            yield b.filter(pa.array(got == inside))

        return f

    return map_rows(docs, make, docs.schema)


def drop_spans(text: str | None, spans) -> bytes:
    data, at, out = (text or "").encode(), 0, []
    for x in spans:
        out.append(data[at : x["s"]])
        at = x["e"]
    return b"".join(out) + data[at:]


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def make():
        def f(b: pa.RecordBatch):
            n, gone, k, sha = [], [], [], []
            for t, spans in zip(b["text"].to_pylist(), b["spans"].to_pylist()):
                n.append(len((t or "").encode())), gone.append(sum(x["e"] - x["s"] for x in spans)), k.append(len(spans))
                sha.append(hashlib.sha256(drop_spans(t, spans)).hexdigest())
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(x, pa.int64()) for x in (n, gone, k)), pa.array(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

        return f

    return map_rows(found, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def brute(texts: list[str | None], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Spans by counting every string; for tests."""
    from collections import Counter

    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        own: list[tuple[int, int]] = []
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                if own and i <= own[-1][1]:
                    own[-1] = (own[-1][0], i + length)
                else:
                    own.append((i, i + length))
        out.append(own)
    return out
