"""MinHash near-duplicates with bottom-k sketches of one hash function.

A document's set is its distinct shingles of five words, each hashed to 64 bits; the set sorted is also its sketch, whose
least ``k`` values are a uniform sample of the set. Documents of equal sets form a class at once. Between classes:

1. Inverted lists hold the least ``lists`` values of every class. Linked sets (Jaccard >= 0.85) share at least ``share`` of
   these but for a chance of up to 8.2e-8 (one set within the other, binomial; the estimate of 3 misses 1.5e-7 more), so it is enough to list, of each class, the rarest ``lists - share + 1``
   of its values (any two sets sharing ``share`` meet in one), and a class too few of whose values occur elsewhere has no link.
2. Of the listed classes, the full sets tell how many shingles no other listed class has. These bound the class's Jaccard
   with any other, given the lengths, so a copy with too many edits of its own is out, however large its group.
3. In each list every class is paired with a hub, the class with the least share of such own shingles, not with all others.
   The pairs pass the bound and the estimate from the union's bottom-k sketch, and the exact Jaccard of full sets decides.
4. The links' components are contracted. The classes of lists that still hold several components are joined once more, by
   their full sets: two linked sets share one of their rarest shingles, as many as the lengths allow to differ (the prefix
   filter), so lists are keyed by shingle and length band, and only pairs between a list's main component and the
   others, or among the others, are formed. So groups of thousands of near copies cost a few pairs a member, and of links
   between these components none is missed but by the estimate; classes that met in no list aren't joined here.

Classes are known by the 128-bit hash of their sets and numbered where they are written, so doc_ids play no part in links.

Defined results: every row gives a row. Null and wordless texts have an empty set and no link. Under five words, the whole
sequence is the one shingle. Rows that repeat a doc_id are linked by their own texts, each apart. A component is named by
the least doc_id of its rows; null doc_ids name none, so a component of nulls alone has a null name. ``kept`` is whether
the row's doc_id is the name, and true for all rows of a component without a name or without links.
Other columns are ignored; an empty table gives an empty one. Shingles are compared as 64-bit hashes (a clash within a
pair has a chance under 1e-10).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, WordHash, cut, grams, in_bitmap, map_rows, pick, signed
from .common import bitmap as slots_of
from .graph import components


def shingles(text: str | None, k: int, cache: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    ws = (text or "").encode().lower().split()
    if not ws:
        return np.empty(0, dtype=U64)
    h = cache.of(ws)
    return np.unique(grams(h, k)) if len(ws) >= k else grams(h, len(ws)) + U64(len(ws))


def sketches(documents: DataFrame, words: int, k: int, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``key`` (longs), n_shingles, class (hash of the full set), sketch (its k least values)."""

    def make():
        cache = WordHash()

        def f(b: pa.RecordBatch):
            ns, cs, sk = [], [], []
            for t in b["text"].to_pylist():
                s = shingles(t, words, cache)
                ns.append(len(s)), cs.append(xxhash.xxh3_128_digest(s.tobytes())), sk.append(signed(s[:k]))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in key), pa.array(ns, pa.int64()), pa.array(cs, pa.binary()), pa.array(sk, pa.list_(pa.int64()))], [*key, "n_shingles", "class", "sketch"])

        return f

    return map_rows(pick(documents, **dict.fromkeys(key, "long"), text="string"), make, "".join(f"{c} long, " for c in key) + "n_shingles long, class binary, sketch array<long>")


def full_sets(documents: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """class, set of the classes whose representative's doc_id (0 for null) is in ``wanted`` (least). A bitmap keeps other documents
    from leaving the scan, and a task hands on each class once. Other classes may pass as well."""
    spark = documents.sparkSession
    held = spark.sparkContext.broadcast(slots_of(wanted.select(F.xxhash64("least").alias("h")), "h"))
    docs = pick(documents, doc_id="long", text="string").select(F.xxhash64(F.coalesce("doc_id", F.lit(0).cast("long"))).alias("h"), "text")

    def make():
        cache, seen, had = WordHash(), held.value, set()

        def f(b: pa.RecordBatch):
            b = b.take(pa.array(np.flatnonzero(in_bitmap(b["h"].to_numpy(zero_copy_only=False).view(U64), seen))))
            keys, sets = [], []
            for t in b["text"].to_pylist():
                s = shingles(t, words, cache)
                key = xxhash.xxh3_128_digest(s.tobytes())
                if key not in had:
                    had.add(key), keys.append(key), sets.append(signed(s))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["class", "set"])

        return f

    return map_rows(docs, make, "class binary, set array<long>")


def prefix_pairs(nodes: DataFrame, sets: DataFrame, threshold: int, bound) -> DataFrame:
    """Pairs (node, node2) of different c among nodes (node, n, core, c) that the prefix filter can't exclude."""
    share = threshold / (100 + threshold)  # linked sets of n and n2 have at least this part of n + n2 in common
    tokens = cut(nodes.join(sets.select("node", "set"), "node").select("node", F.explode("set").alias("g")), "tokens")
    df = cut(tokens.groupBy("g").agg(F.count("*").alias("df")).filter("df > 1"), "tokens")
    rare = tokens.join(df, "g").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("rare"))
    # shingles of one set come first in the order, so they count as the prefix's first
    ordered = nodes.join(rare, "node").withColumn("own", F.col("n") - F.size("rare"))
    band = lambda n: F.floor(F.log(n) * 33)

    def prefix(least_sum):
        take = (F.col("n") - F.ceil(share * least_sum - 1e-9) + 1 - F.col("own")).cast("int")
        return F.explode(F.slice("rare", F.lit(1), F.greatest(take, F.lit(0))))

    low = F.ceil(F.col("n") * threshold / 100 - 1e-9)
    high = F.least(F.col("n"), F.floor(F.col("core") * (1 + 100 / threshold) - F.col("n")) + 1)
    larger = ordered.filter(low <= high).withColumn("band", F.explode(F.sequence(band(low), band(high))))
    larger = larger.withColumn("t", prefix(F.col("n") + F.greatest(low, F.ceil(F.exp(F.col("band") / 33) - 1e-6)))).select("node", "n", "core", "c", "band", F.col("t.g").alias("g"))
    smaller = ordered.withColumn("t", prefix(2 * F.col("n"))).select("node", "n", "core", "c", band(F.col("n")).alias("band"), F.col("t.g").alias("g"))
    seen = larger.select("g", "band", "c").union(smaller.select("g", "band", "c")).groupBy("g", "band", "c").count()
    # written before they are joined: only then can AQE split a list that most classes are in
    lists = cut(seen.groupBy("g", "band").agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.count("*").alias("cs")).filter("cs > 1").drop("cs"), "lists")
    larger, smaller = cut(larger.join(lists, ["g", "band"]), "larger"), cut(smaller.join(lists.withColumnRenamed("main", "m2"), ["g", "band"]).select("g", "band", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("core").alias("core2"), F.col("c").alias("c2"), "m2"), "smaller")
    first = (F.col("n2") < F.col("n")) | (F.col("n2") == F.col("n")) & (F.col("node2") < F.col("node"))
    # of equal lengths, either may be the larger one of the pair; the order by node picks one, and both have the full prefix there
    may = first & (F.col("c") != F.col("c2")) & bound(F.col("n"), F.col("core"), F.col("n2"), F.col("core2"))
    others = larger.filter("c <> main").join(smaller, ["g", "band"]).filter(may)
    mains = larger.filter("c = main").join(smaller.filter("c2 <> m2"), ["g", "band"]).filter(may)
    return others.select("node", "node2").union(mains.select("node", "node2"))


def near_classes(documents: DataFrame, key: tuple[str, ...] = ("doc_id",), threshold: int = 85, words: int = 5, k: int = 64, lists: int = 32, share: int = 15) -> DataFrame:
    """The columns of ``key`` (longs, doc_id among them), n_shingles and component: a number that rows of linked sets have in
    common, null for empty sets. Links: 100 * intersection >= threshold * union of the full sets."""
    sig = cut(sketches(documents, words, k, key), "sketches")
    # one node for each class of equal non-empty sets, numbered where it is written; least: the doc_id of a document that has it
    classes = sig.filter("n_shingles > 0").groupBy("class").agg(F.coalesce(F.min("doc_id"), F.lit(0).cast("long")).alias("least"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    nodes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    postings = nodes.select("node", "n", F.explode(F.slice("sketch", 1, lists)).alias("value"))
    # aggregates are written before they are joined, as AQE splits a value that most classes have only between plain exchanges
    shared = cut(postings.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    held = F.least(F.col("n"), F.lit(lists))
    need = F.greatest(F.floor(held * (share / lists)), F.lit(1)).cast("int")  # values a linked set must share at least
    mine = postings.join(shared, "value").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("rare"))
    mine = mine.withColumn("take", (F.size("rare") - need + 1).cast("int")).filter("take > 0")
    entries = cut(mine.select("node", "n", F.explode(F.slice("rare", F.lit(1), F.col("take"))).alias("e")).select("node", "n", F.col("e.value").alias("value")), "postings")

    listed = cut(nodes.join(entries.select("node").distinct(), "node").select("class", "node", "least", "sketch"), "listed")
    sets = cut(full_sets(documents, listed, words).join(listed.select("class", "node", "sketch"), "class").dropDuplicates(["node"]).select("node", "set", "sketch"), "sets")

    # shingles that no other listed class has: own; those of the class are counted exactly, by one aggregation
    own = sets.select("node", F.explode("set").alias("g")).groupBy("g").agg(F.count("*").alias("df"), F.min("node").alias("node")).filter("df = 1").groupBy("node").agg(F.count("*").alias("own"))
    core = F.col("n") - F.coalesce("own", F.lit(0))  # the most that it can share with another
    cores = entries.join(own, "node", "left").withColumn("core", core).filter(100 * F.col("core") >= threshold * F.col("n"))
    entries = cut(cores.select("value", "node", "n", "core"), "entries")

    def bound(n, core, n2, core2):
        """Whether the Jaccard of two sets of these sizes and cores may reach the threshold."""
        most = F.least(core, core2)
        return 100 * most >= threshold * (n + n2 - most)

    @F.pandas_udf("double")
    def estimate(a: pd.Series, b: pd.Series) -> pd.Series:
        """Jaccard from the bottom-k sketch of the union: the share of its values that both have."""
        out = []
        for x, y in zip(a, b):
            x, y = np.asarray(x).view(U64), np.asarray(y).view(U64)
            both = np.concatenate([x, y])
            both.sort()
            same = both[1:] == both[:-1]
            least = np.concatenate([both[:1], both[1:][~same]])[:k]
            out.append(np.count_nonzero(both[1:][same] <= least[-1]) / len(least))
        return pd.Series(out)

    slack = 6 * (threshold / 100 * (1 - threshold / 100) / k) ** 0.5  # six standard errors of the estimate

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.greatest("node", "node2").alias("u"), F.least("node", "node2").alias("v")).distinct()
        a = sets.select(F.col("node").alias("u"), F.col("set").alias("s"), F.col("sketch").alias("k"))
        b = sets.select(F.col("node").alias("v"), F.col("set").alias("s2"), F.col("sketch").alias("k2"))
        likely = cut(pairs.join(a.select("u", "k"), "u").join(b.select("v", "k2"), "v").filter(estimate("k", "k2") >= threshold / 100 - slack).select("u", "v"), "likely")
        both = F.size(F.array_intersect("s", "s2"))
        return likely.join(a.select("u", "s"), "u").join(b.select("v", "s2"), "v").filter(100 * both >= threshold * (F.size("s") + F.size("s2") - both)).select("u", "v")

    # hubs: the class of least own share in each list
    order = F.struct(-F.col("core") / F.col("n"), F.col("node"))
    hub = cut(entries.groupBy("value").agg(F.min_by(F.struct("node", "n", "core"), order).alias("hub")), "hubs")
    pairs = entries.join(hub, "value").select("node", "n", "core", F.col("hub.node").alias("node2"), F.col("hub.n").alias("n2"), F.col("hub.core").alias("core2"))
    comps = components(verified(pairs.filter((F.col("node") != F.col("node2")) & bound(F.col("n"), F.col("core"), F.col("n2"), F.col("core2")))))

    now = entries.join(comps, "node", "left").withColumn("c", F.coalesce("component", "node"))
    now = cut(now, "now")
    several = cut(now.groupBy("value").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).filter("c1 <> c2").select("value"), "several")
    left = cut(now.join(several, "value").select("node", "n", "core", "c").distinct(), "open")
    if not left.isEmpty():
        found = verified(prefix_pairs(left, sets, threshold, bound))
        comps = components(comps.select(F.col("node").alias("u"), F.col("component").alias("v")).union(found))

    named = cut(nodes.select("class", "node").join(comps, "node", "left").select("class", F.coalesce("component", "node").alias("component")), "named")
    # empty sets are in no class and join nothing; a class of a third of all rows is a skewed join, which AQE splits
    linked = sig.filter("n_shingles > 0").join(named, "class").select(*key, "n_shingles", "component")
    return linked.union(sig.filter("n_shingles = 0").select(*key, "n_shingles", F.lit(None).cast("long")))


def near_components(documents: DataFrame, threshold: int = 85, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the component's least doc_id), kept; a row for each row."""
    rows = cut(near_classes(documents, threshold=threshold, words=words), "classes")
    names = cut(rows.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("name")), "names")
    whole = rows.join(names, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("name")))
    return whole.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def repeated_rows(documents: DataFrame, threshold: int = 85, words: int = 5) -> DataFrame:
    """_file, _row (those of ``common.row_ids``) of all rows but one of each component, that of the least doc_id; a null doc_id comes last."""
    rows = cut(near_classes(documents, ("doc_id", "_file", "_row"), threshold, words).filter("component IS NOT NULL"), "classes")
    place = F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_file", "_row")
    first = cut(rows.groupBy("component").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("component", "first"), "firsts")
    return rows.join(first, "component").filter((F.col("_file") != F.col("first._file")) | (F.col("_row") != F.col("first._row"))).select("_file", "_row")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)]) AS s FROM w WHERE len(w) > 0),
c AS MATERIALIZED (SELECT min(doc_id) AS rep, s FROM (SELECT doc_id, list_sort(s) AS s FROM s) GROUP BY s),
e AS MATERIALIZED (SELECT rep, len(s) AS n, unnest(s) AS g FROM c),
p AS MATERIALIZED (SELECT a.rep AS x, b.rep AS y FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
l AS MATERIALIZED (SELECT x, y FROM p UNION SELECT y, x FROM p UNION SELECT rep, rep FROM c),
r AS (SELECT x AS node, y AS to_node FROM l UNION SELECT r.node, l.y FROM r JOIN l ON r.to_node = l.x),
m AS (SELECT node, min(to_node) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, CAST(coalesce(len(s.s), 0) AS BIGINT) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, w.doc_id = coalesce(component_id, w.doc_id) AS kept
FROM w LEFT JOIN s USING (doc_id) LEFT JOIN (SELECT rep, s FROM c) c ON c.s = list_sort(s.s) LEFT JOIN m ON m.node = c.rep
"""
