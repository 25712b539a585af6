"""Benchmark decontamination by winnowing.

Both sides are cut into words; of every ``window - k + 1`` consecutive k-grams the one of least hash (the rightmost of
equals) is kept. A passage of ``window`` words keeps the same k-gram wherever it stands, so a join of the kept k-grams
meets every shared passage; from each meeting the match is extended word by word within the window's reach and kept
if it spans a whole window.

Defined results: null or wordless texts have no words, no hits. An item shorter than a window (but not wordless) is one
window of its own length. Rows with the same doc_id and text count as one row, as do items with the same item_id and
text; other columns are ignored. A null item_id takes no part.

Scale: one pass over the documents. A bitmap of bounded size (filled from all items) drops k-grams that no item has
before the shuffle; the join is on the k-gram's hash, so a passage in a third of all documents is a skewed join that AQE splits, and its other side is as small as the items that hold it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, WordHash, bitmap, cut, grams, in_bitmap, map_rows, pick, signed

#: A-Z to lower case, everything that isn't part of a word to a space.
WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the rightmost least value of each w consecutive values."""
    if len(h) < w:
        return np.empty(0, dtype=np.int64)
    least = np.lib.stride_tricks.sliding_window_view(h, w)[:, ::-1].argmin(axis=1)
    return np.unique(np.arange(w - 1, len(h)) - least)


def context(ws: list[bytes], at: int, k: int, reach: int) -> str:
    """The reach words before a k-gram, and it with the reach words after it."""
    return (b" ".join(ws[max(0, at - reach) : at]) + b"\n" + b" ".join(ws[at : at + k + reach])).decode()


def matched(a: str, b: str) -> tuple[int, int]:
    """How many words agree before and from the k-gram on."""
    # context() joins by single spaces; str.split() would also cut at U+00A0, U+3000 and others that words have
    (al, ar), (bl, br) = (tuple(s.split(" ") if s else [] for s in x.split("\n")) for x in (a, b))
    left = right = 0
    for x, y in zip(reversed(al), reversed(bl)):
        if x != y:
            break
        left += 1
    for x, y in zip(ar, br):
        if x != y:
            break
        right += 1
    return left, right


def item_prints(items: DataFrame, k: int, window: int) -> DataFrame:
    """item_id, fp, length of the gram, context: one row for each kept k-gram of an item, copies left out."""

    def make():
        cache = WordHash()

        def f(b: pa.RecordBatch):
            out: list[tuple] = []
            for i, t in zip(b["item_id"].to_pylist(), b["text"].to_pylist()):
                ws = words(t)
                if i is None or not ws:
                    continue
                h = cache.of(ws)
                if len(ws) < window:
                    out.append((i, int(signed(grams(h, len(ws)) + U64(len(ws)))[0]), len(ws), context(ws, 0, len(ws), 0)))
                    continue
                g = grams(h, k)
                out += [(i, int(v), 0, context(ws, p, k, window - k)) for p, v in ((p, signed(g[p : p + 1])[0]) for p in winnow(g, window - k + 1).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else ([],) * 4, (pa.int64(), pa.int64(), pa.int32(), pa.string()))], ["item_id", "fp", "short", "ctx"])

        return f

    return map_rows(pick(items, item_id="long", text="string"), make, "item_id long, fp long, short int, ctx string").distinct()


def decontaminate(documents: DataFrame, items: DataFrame, k: int = 5, window: int = 10, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document (the columns of ``key``, longs, and text_key): n_words, spans (array of start, end in words, as matched), item_ids."""
    if not 1 <= k <= window:
        raise ValueError("k must be from 1 to window")
    spark, key_columns = documents.sparkSession, key
    prints = cut(item_prints(items, k, window), "prints")
    held = spark.sparkContext.broadcast(bitmap(prints, "fp"))
    lengths = sorted(r.short for r in prints.filter("short > 0").select("short").distinct().collect())  # below window values at most

    def make():
        cache, seen = WordHash(), held.value

        def f(b: pa.RecordBatch):
            ids, keys, kinds, fps, ns, ctxs = [], [], [], [], [], []  # ids: numbers of rows

            def add(i, key, kind, fp, n, ctx):
                ids.append(i), keys.append(key), kinds.append(kind), fps.append(fp), ns.append(n), ctxs.append(ctx)

            for i, t in enumerate(b["text"].to_pylist()):
                key = xxhash.xxh3_64_intdigest(b"\0" if t is None else b"\1" + t.encode()) - (1 << 63)
                ws = words(t)
                add(i, key, -1, key ^ i, len(ws), None)
                if not ws:
                    continue
                h = cache.of(ws)
                g = grams(h, k)
                at = winnow(g, window - k + 1)
                at = at[in_bitmap(g[at], seen)]
                for p, v in zip(at.tolist(), signed(g[at]).tolist()):
                    add(i, key, 0, v, p, context(ws, p, k, window - k))
                for n in lengths:
                    g = grams(h, n) + U64(n)
                    at = np.flatnonzero(in_bitmap(g, seen)) if len(g) else ()
                    for p, v in zip(list(at), signed(g[at]).tolist() if len(at) else ()):
                        add(i, key, n, v, int(p), context(ws, int(p), n, 0))
            own = b.drop_columns(["text"]).take(pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(keys, pa.int64()), pa.array(kinds, pa.int32()), pa.array(fps, pa.int64()), pa.array(ns, pa.int64()), pa.array(ctxs, pa.string())], [*key_columns, "text_key", "short", "fp", "n", "ctx"])

        return f

    # written, so that no task runs this and the comparison below in two Python workers at once
    rows = cut(map_rows(pick(documents, **dict.fromkeys(key, "long"), text="string"), make, "".join(f"{c} long, " for c in key) + "text_key long, short int, fp long, n long, ctx string"), "grams")

    @F.pandas_udf("struct<s: long, e: long>")
    def span(n: pd.Series, short: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        s, e = [], []
        for p, m, x, y in zip(n, short, a, b):
            if y is None:
                s.append(None), e.append(None)
                continue
            left, right = matched(x, y)
            ok = right >= m if m > 0 else right >= k and left + right >= window
            s.append(p - left if ok else None), e.append((p + (m if m > 0 else right)) if ok else None)
        return pd.DataFrame({"s": pd.array(s, "Int64"), "e": pd.array(e, "Int64")})

    met = rows.join(prints.withColumnRenamed("ctx", "item_ctx"), ["fp", "short"], "left").withColumn("span", span("n", "short", "ctx", "item_ctx"))
    hit = F.col("span.s").isNotNull()
    return met.groupBy(*key, "text_key").agg(
        F.max(F.when(F.col("short") == -1, F.col("n"))).alias("n_words"),
        F.array_sort(F.collect_set(F.when(hit, F.struct(F.col("span.s").alias("s"), F.col("span.e").alias("e"))))).alias("spans"),
        F.collect_set(F.when(hit, F.col("item_id"))).alias("item_ids"),
    )


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a.end, x.e).alias("end"), (a.n + F.greatest(F.lit(0).cast("long"), x.e - F.greatest(a.end, x.s))).alias("n")),
        lambda a: a.n,
    )
    return found.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",").cast("binary"), 256).alias("items_sha256"),
        (covered > 0).alias("contaminated"),
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM g),
x AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, i, n FROM x JOIN g USING (n, g)),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""
