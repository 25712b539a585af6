"""Vectors: embedding checks, point ids and records, idempotent upsert, exact filtered search."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, uuid5

DISTANCES = ("cosine", "dot", "euclid", "manhattan")
BLOCK = 10_000


class Model(NamedTuple):
    """What a provider must say it is."""

    model_id: str
    model_revision: str
    vector_dimension: int


def same_model(info, model: Model) -> bool:
    """Whether a provider's answer names the wanted model and revision."""
    return isinstance(info, dict) and (info.get("model_id"), info.get("model_sha")) == (model.model_id, model.model_revision)


def embed(chunks: DataFrame, provider: Callable[[], Callable[[list[str]], list[list[float]]]], dimension: int, batch: int = 16, model: Model | None = None) -> DataFrame:
    """Adds input, vector and error_code. ``provider`` is made once a task; blank inputs are never sent, answers are checked.

    With ``model``, the provider's ``info()`` is asked before its first batch in a task, then remembered; nothing is sent to one that says
    it is another model. A failed question is asked again with the next batch."""
    source = chunks.withColumn("input", F.concat_ws("\n\n", F.col("heading_path"), F.col("text")))

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ask, known = None, model is None
        for inputs in frames:
            vectors: list = [None] * len(inputs)
            errors: list = [None if t and t.strip() else "EMBEDDING_RESPONSE_INVALID" for t in inputs]
            todo = [i for i, e in enumerate(errors) if e is None]
            for at in range(0, len(todo), batch):
                some = todo[at : at + batch]
                try:
                    ask = ask or provider()
                    if not known and not (known := same_model(ask.info(), model)):
                        raise ValueError("another model")
                    got = ask([inputs.iloc[i] for i in some])
                except OSError:
                    for i in some:
                        errors[i] = "EMBEDDING_PROVIDER_UNAVAILABLE"
                    continue
                except (ValueError, TypeError, KeyError):  # an answer that can't be read
                    got = []
                whole = len(got) == len(some)
                for j, i in enumerate(some):
                    v = got[j] if whole else None
                    fine = v is not None and len(v) == dimension and all(isinstance(x, (int, float)) and not isinstance(x, bool) and abs(x) < float("inf") for x in v)
                    vectors[i], errors[i] = ([float(x) for x in v], None) if fine else (None, "EMBEDDING_RESPONSE_INVALID")
            yield pd.DataFrame({"vector": vectors, "error_code": errors})

    call = F.pandas_udf(_typed(run), "struct<vector: array<float>, error_code: string>")
    return source.withColumn("_e", call("input")).withColumn("vector", F.col("_e.vector")).withColumn("error_code", F.col("_e.error_code")).drop("_e")


def _typed(run):
    run.__annotations__ = {"frames": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return run


def point_id(version: Column, index: Column) -> Column:
    return uuid5(version, F.concat(F.lit("chunk:"), index.cast("string")))


def finite(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def check_points(points: DataFrame, dimension: int) -> DataFrame:
    """Adds problem: the first that a point has, or null. Repeats of (version, index) are counted, not gathered."""
    repeated = points.groupBy("document_version_id", "chunk_index").agg((F.count("*") > 1).alias("_twice"))
    pages = F.col("page_start").isNull() != F.col("page_end").isNull()
    problem = (
        F.when(F.col("chunk_index").isNull() | (F.col("chunk_index") < 0), "index")
        .when(strip(F.coalesce("text", F.lit(""))) == "", "text")
        .when(pages | (F.col("page_start") < 1) | (F.col("page_end") < F.col("page_start")), "pages")
        .when(F.col("vector").isNull() | (F.size("vector") != dimension), "dimension")
        .when(~finite(F.col("vector")), "values")
        .when(F.col("_twice"), "repeated")
    )
    return points.join(repeated, ["document_version_id", "chunk_index"], "left").withColumn("problem", problem).drop("_twice")


def payload(points: DataFrame) -> DataFrame:
    """id, vector, payload as JSON; page keys only where there are pages."""
    fields = ("kb_id", "document_id", "document_version_id", "chunk_index", "content_type", "content_role", "heading_path", "text", "page_start", "page_end")
    return points.select("id", "vector", F.to_json(F.struct(*(c for c in fields if c in points.columns))).alias("payload"))


def upsert(stored: DataFrame | None, fresh: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The points after an upsert: of each id, that of the highest seq; of equals, that of the highest hash. Partial aggregation
    keeps one row an id and task."""
    both = fresh if stored is None else stored.unionByName(fresh, allowMissingColumns=True)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(seq), F.xxhash64(*rest))).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def collection_problem(manifest: DataFrame, name: str, size: int, distance: str) -> str | None:
    """What forbids writing to a collection: 'size', 'distance' or nothing; a missing one may be made."""
    if distance not in DISTANCES:
        raise ValueError(f"no such distance: {distance}")
    row = manifest.filter(F.col("name") == name).first()
    return None if row is None else "size" if row["size"] != size else "distance" if row["distance"] != distance else None


def ensure_collections(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds action to wanted (name, size, distance): create, keep, or refuse where the stored size or distance differs."""
    have = manifest.select("name", F.col("size").alias("_s"), F.col("distance").alias("_d"))
    same = (F.col("_s") == F.col("size")) & (F.col("_d") == F.col("distance"))
    action = F.when(F.col("_s").isNull() & F.col("_d").isNull(), "create").when(F.coalesce(same, F.lit(False)), "keep").otherwise("refuse")
    return wanted.join(have, "name", "left").withColumn("action", action).drop("_s", "_d")


def with_vectors(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Chunks joined to answers (doc_key, chunk_index, vector). A document with a chunk or an answer too many gets an error_code."""
    both = chunks.withColumn("_c", F.lit(1)).join(answers.select("doc_key", "chunk_index", "vector"), ["doc_key", "chunk_index"], "full")
    whole = both.groupBy("doc_key").agg((F.count("_c") == F.count("vector")).alias("_n"), F.max((F.col("_c").isNull() | F.col("vector").isNull()).cast("int")).alias("_odd"))
    error = F.when(~F.col("_n") | (F.col("_odd") == 1), "EMBEDDING_RESPONSE_INVALID")
    return both.join(whole, "doc_key").filter("_c IS NOT NULL").withColumn("error_code", error).drop("_c", "_n", "_odd")


def index(stored: DataFrame | None, points: DataFrame, dimension: int, collection: str) -> tuple[DataFrame, DataFrame]:
    """The points after an upsert of the versions without faults, and their projections (collection, indexed_chunk_count)."""
    checked = check_points(points, dimension)
    bad = checked.filter("problem IS NOT NULL").select("document_version_id").distinct()
    good = checked.join(bad, "document_version_id", "left_anti").drop("problem").withColumn("id", point_id(F.col("document_version_id"), F.col("chunk_index")))
    done = good.groupBy("document_version_id").agg(F.lit(collection).alias("collection"), F.count("*").alias("indexed_chunk_count"))
    return upsert(stored, good), done


def scroll(points: DataFrame, version: str) -> DataFrame:
    """The points of one version, without their vectors; its count() is exact."""
    return points.filter(F.col("document_version_id") == version).drop("vector")


def retrieve(points: DataFrame, ids: DataFrame) -> DataFrame:
    """The points of the given ids; missing ones are left out."""
    return points.join(ids.select("id").distinct(), "id", "left_semi")


def score(distance: str, a: Column, b: Column) -> Column:
    """Similarity (cosine, dot) or distance, in double."""
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = lambda x, y: add(F.zip_with(x, y, lambda p, q: p * q))
    if distance == "dot":
        return dot(a, b)
    if distance == "cosine":
        return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    if distance == "euclid":
        return F.sqrt(add(F.zip_with(a, b, lambda p, q: (p - q) * (p - q))))
    if distance == "manhattan":
        return add(F.zip_with(a, b, lambda p, q: F.abs(p - q)))
    raise ValueError(f"no such distance: {distance}")


def search(points: DataFrame, queries: DataFrame, top_k: int = 5, distance: str = "cosine", on: str | None = None, digits: int | None = None) -> DataFrame:
    """query_id, rank, id, score. Queries (query_id, query_vector and, to filter, the column ``on``) against all points.

    With ``on``, only points of the query's value are scored, by an equi-join. Points of ties rank by id."""
    if top_k < 1:
        raise ValueError("top_k must be positive")
    q = queries.withColumn("query_vector", F.col("query_vector").cast("array<double>"))
    p = points.select("id", F.col("vector").cast("array<double>").alias("vector"), *([on] if on else []))
    if on:
        pairs = p.join(q, on)
    else:
        # without a filter, queries meet the points in broadcast blocks of a checked size
        n = q.count()
        many = math.ceil(n / (0.9 * BLOCK)) if n > BLOCK else 1
        blocks = [q.filter(F.pmod(F.xxhash64("query_id"), F.lit(many)) == i) for i in range(many)]
        pairs = reduce(DataFrame.unionByName, (p.join(F.broadcast(b), F.lit(True)) for b in blocks))
    s = score(distance, F.col("query_vector"), F.col("vector"))
    s = F.round(s, digits) if digits is not None else s
    up = F.desc("score") if distance in ("cosine", "dot") else F.asc("score")
    w = Window.partitionBy("query_id").orderBy(up, "id")
    return pairs.withColumn("score", s).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k).select("query_id", "rank", "id", "score")


def evaluation(suite: DataFrame, results: DataFrame, target: dict, model: Model, captured_at: str, revision: str = "unknown", collection: str | None = None) -> DataFrame:
    """suite_id and document: one JSON document a suite, its queries with their ranked results, vectors left out.

    suite: suite_id, description, query_id, text, purpose; results: query_id, rank, id, score, payload (JSON).
    target: document_version_id, collection, top_k. ``collection`` describes the collection as JSON. Nulls are written."""
    ranked = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("point_id"), F.col("score").cast("double").alias("score"), "payload"))).alias("results"))
    per = suite.join(ranked, "query_id", "left").groupBy("suite_id", "description").agg(F.array_sort(F.collect_list(F.struct("query_id", "text", "purpose", "results"))).alias("queries"))
    read = lambda r: r.withField("payload", F.parse_json(r.payload))  # noqa: E731  last, as parsed JSON can't be sorted
    queries = F.transform("queries", lambda q: q.withField("results", F.transform(F.coalesce(q.results, F.array()), read)))
    # The document's keys, in order.
    document = F.struct(
        F.lit(1).alias("schema_version"),
        F.lit(captured_at).alias("captured_at"),
        F.lit(revision).alias("git_revision"),
        F.struct("suite_id", "description").alias("suite"),
        F.struct(F.lit(target["document_version_id"]).alias("document_version_id"), F.lit(target["collection"]).alias("qdrant_collection"), F.lit(target["top_k"]).alias("top_k")).alias("target"),
        F.struct(*(F.lit(v).alias(k) for k, v in model._asdict().items()), F.lit(None).cast("string").alias("query_instruction")).alias("embedding_profile"),
        F.parse_json(F.lit(collection)).alias("qdrant_collection_info"),
        queries.alias("queries"),
    )
    return per.select("suite_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))
