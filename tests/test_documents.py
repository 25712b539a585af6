"""Cases that tell right from nearly right in the document operators."""

import itertools
import json
import random
import re
import statistics

import duckdb
import pyarrow as pa
import pytest
from conftest import SF, canon
from pyspark.sql import functions as F
from test_queries import brute_split

from pagemill import queries
from pagemill.functions import text as T
from pagemill.operators import chunking, document_marks, layout, lifecycle, vectors
from pagemill.plans import ingest
from pagemill.sources import pages, parsers, uploads

UPLOAD = "upload_id string, kb_id string, filename string, media_type string, content binary"


def values(spark, rows, f):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(f(F.col("x"))).collect()]


def test_strip_is_that_of_python(spark):
    rows = ["", " ", "\n\t a b ", "　x y ", "\x1c\x85z", "plain", "​kept​"]
    assert values(spark, rows, T.strip) == [r.strip() for r in rows]


def test_paragraphs_are_those_of_one_pass(spark):
    rng, parts = random.Random(3), ["a", "bc d", "", " ", "\t", "　", "é"]
    texts = ["", "\n", "one", "one\n", "\n\none\r\ntwo\x0b\n \nthree  four\x1c", *("".join(rng.choice(parts) + rng.choice(["\n", "\r\n", " ", "\r"]) for _ in range(rng.randrange(12))) for _ in range(200))]
    for t, nodes in zip(texts, values(spark, texts, parsers.paragraph_nodes)):
        want, held = [], []
        for n, row in enumerate([*t.splitlines(), ""], 1):
            if row.strip():
                held.append(row)
            elif held:
                want.append(("\n".join(held), n - len(held), n - 1))
                held = []
        assert [(x.text, x.line_start, x.line_end) for x in nodes] == want, repr(t)
    assert values(spark, [None], parsers.paragraph_nodes) == [None]


def test_plain_texts_need_no_python_columns(spark):
    """Rows of ASCII texts and their sections that fit go to Python as nulls; the results show that nothing else is done with them."""
    rows = [("a", "kb", "a.txt", "text/plain", b"one  two\n\nthree\n"), ("b", "kb", "b.md", "text/markdown", "# T\n\ncafé\n\n```py\n x \n```\n".encode()), ("c", "kb", "c.txt", "text/plain", "é x\n".encode())]
    docs = ingest.parsed(uploads.validate(spark.createDataFrame(rows, UPLOAD)))
    got = {r.doc_key: (r.text, r.content_type, list(r.heading_path), r.source_line_start, r.source_line_end) for r in ingest.chunks(docs).collect()}
    assert got == {"a": ("one two\n\nthree", "text", [], 1, 3), "b": ("café\n\n x", "mixed", ["T"], 3, 7), "c": ("é x", "text", [], 1, 1)}


def test_outcomes(spark):
    rows = [("ok", "kb", "a.txt", "text/plain", b"words"), ("empty", "kb", "a.txt", "text/plain", b""), ("blank", "kb", "a.txt", "text/plain", b" \n"), ("type", "kb", "a.htm", "text/html", b"x"), ("bytes", "kb", "a.txt", "text/plain", b"\xff")]
    rows += [("pdf", "kb", "a.pdf", "application/pdf", b"%PDF-1.7"), ("code", "kb", "a.md", "text/markdown", b"```\n" + b"word " * 60 + b"\n```\n"), ("two", "kb", "a.txt", "text/plain", b"a b c d\n\ne f g h\n")]
    checked = uploads.validate(spark.createDataFrame(rows, UPLOAD))
    got = {r.doc_key: (r.n_chunks, r.error_code) for r in ingest.outcomes(checked, ingest.parsed(checked), chunking.Profile(4, 5, 6, 0, 50)).collect()}
    assert got == {
        "ok": (1, None), "empty": (0, "EMPTY"), "blank": (0, "NO_EXTRACTABLE_TEXT"), "type": (0, "UNSUPPORTED_MEDIA_TYPE"), "bytes": (0, "INVALID_CONTENT"),
        "pdf": (0, "UNSUPPORTED_MEDIA_TYPE"), "code": (0, "CONTENT_BLOCK_TOO_LARGE"), "two": (2, None),
    }
    # what the role policy empties: a paged document of which all is contents
    nodes = [("heading", 1, "Contents", None, None, None, 1, "body"), ("paragraph", None, "Chapter one 5", None, None, None, 1, "body")]
    docs = spark.createDataFrame([("toc", nodes, None)], f"doc_key string, nodes {ingest.NODES}, error_code string")
    one = spark.createDataFrame([("toc", None)], "upload_id string, reject_code string")
    assert [tuple(r) for r in ingest.outcomes(one, docs).collect()] == [("toc", 0, "NO_EXTRACTABLE_TEXT")]


def test_run_to_the_index(spark, tmp_path):
    ids = {name: f"00000000-0000-4000-8000-{i:012d}" for i, name in enumerate(("fine", "down", "wide", "blank", "type", "page", "again"))}
    text = {"fine": b"a b c d\n\ne f g h\n", "down": b"down\n\nx x x x x\n", "wide": b"wide", "blank": b" \n", "type": b"%PDF-1.7", "page": b"page", "again": b""}
    rows = [(ids[n], "kb", "a.pdf" if n == "type" else "a.txt", "application/pdf" if n == "type" else "text/plain", t) for n, t in text.items()]
    checked = uploads.validate(spark.createDataFrame(rows, UPLOAD))
    docs, profile = ingest.parsed(checked), chunking.Profile(4, 5, 6, 0, 50)

    def provider():
        def ask(texts):
            if any("down" in t for t in texts):
                raise OSError
            return [[float(len(t)), 1.0] + [0.0] * ("wide" in t) for t in texts]

        return ask

    path = str(tmp_path / "embedded")
    ingest.embedded(ingest.chunks(docs, profile), provider, 2, batch=1).write.parquet(path)
    made = spark.read.parquet(path)
    made = made.withColumn("page_start", F.when(F.col("doc_key") == ids["page"], 0).otherwise(F.col("page_start")))
    points, done, late = ingest.indexed(None, made, 2, "chunks")
    name = {v: k for k, v in ids.items()}
    assert sorted((name[r.doc_key], r.chunk_index, r.text) for r in points.collect()) == [("fine", 0, "a b c d"), ("fine", 1, "e f g h")]
    got = {name[r.doc_key]: tuple(r)[1:] for r in ingest.statuses(checked, ingest.outcomes(checked, docs, profile), done, late).collect()}
    assert got == {
        "fine": ("COMPLETED", "SEARCHABLE", 2, None), "down": ("FAILED", "FAILED", None, "EMBEDDING_PROVIDER_UNAVAILABLE"), "wide": ("FAILED", "FAILED", None, "EMBEDDING_RESPONSE_INVALID"),
        "blank": ("FAILED", None, None, "NO_EXTRACTABLE_TEXT"), "type": ("FAILED", None, None, "PARSING_FAILED"), "page": ("FAILED", "FAILED", None, "VECTOR_INDEX_UNAVAILABLE"),
    }
    # the same once more changes nothing
    again = ingest.indexed(points, made, 2, "chunks", seq=1)[0]
    assert sorted(r.id for r in again.collect()) == sorted(r.id for r in points.collect())


def test_statuses(spark):
    rows = [("a", "kb", "a.txt", "text/plain", b""), ("b", "kb", "a.txt", "text/plain", b"x"), ("c", "kb", "a.txt", "text/plain", b"\xff"), ("d", "kb", " ", "text/plain", b"x"), ("e", "kb", "a.txt", " TEXT/plain ; charset=UTF-8\t", b"x")]
    assert {r.upload_id: r.http_status for r in uploads.validate(spark.createDataFrame(rows, UPLOAD)).collect()} == {"a": 422, "b": 202, "c": 422, "d": 415, "e": 202}


def test_invariants(spark):
    """One fault a row; an id's first letter says whether the row is fine."""
    rows = [("f1", "ACCEPTED", None, None, None, None, 1), ("x1", "ACCEPTED", "ref", None, None, None, 1), ("x2", "ACCEPTED", None, "d", None, None, 1)]
    rows += [("f2", "PROCESSING", "ref", None, None, None, 1), ("x3", "PROCESSING", "", None, None, None, 1), ("x4", "PROCESSING", None, None, None, None, 1), ("x5", "PROCESSING", "ref", None, "v", None, 1)]
    rows += [("f3", "COMPLETED", "ref", "d", "v", None, 1), ("x6", "COMPLETED", "", "d", "v", None, 1), ("x7", "COMPLETED", "ref", "d", None, None, 1), ("x8", "COMPLETED", "ref", "d", "v", "CODE", 1)]
    rows += [("f4", "FAILED", None, None, None, "CODE", 1), ("f5", "FAILED", "ref", None, None, "CODE", 1), ("x9", "FAILED", "ref", None, None, None, 1), ("x0", "FAILED", "ref", "d", None, "CODE", 1), ("xa", "ACCEPTED", None, None, None, None, 0), ("xb", "ACCEPTED", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "addition_id string, status string, source_ref string, document_id string, document_version_id string, failure_code string, size_bytes long")
    assert sorted(r.addition_id for r in lifecycle.addition_violations(df).collect()) == sorted(r[0] for r in rows if r[0][0] == "x")


def test_view_hides_what_no_addition_names(spark):
    a = spark.createDataFrame([("a", "COMPLETED", "d", "v", None), ("b", "PROCESSING", None, None, None)], "addition_id string, status string, document_id string, document_version_id string, failure_code string")
    v = spark.createDataFrame([("v", "SEARCHABLE", 3), ("w", "PROCESSING", None)], "version_id string, status string, indexed_chunk_count int")
    assert {r.addition_id: (r.version_status, r.indexed_chunk_count) for r in lifecycle.status_view(a, v).collect()} == {"a": ("SEARCHABLE", 3), "b": (None, None)}


def test_failures_keep_one_row_an_addition(spark):
    a = spark.createDataFrame([("a", "PROCESSING", None), ("b", "COMPLETED", None), ("c", "ACCEPTED", None)], "addition_id string, status string, failure_code string")
    v = spark.createDataFrame([("v", "a", "PROCESSING", None)], "version_id string, addition_id string, status string, failure_code string")
    e = spark.createDataFrame([("a", 2, "PdfParsingError"), ("a", 1, "VectorIndexUnavailableError"), ("b", 1, "KeyError"), ("c", 1, None)], "addition_id string, seq int, error string")
    a, v = lifecycle.fail(a, v, e)
    assert sorted(map(tuple, a.collect())) == [("a", "FAILED", "VECTOR_INDEX_UNAVAILABLE"), ("b", "COMPLETED", None), ("c", "ACCEPTED", None)]
    assert [r.status for r in v.collect()] == ["FAILED"]


def test_a_key_is_put_once(spark):
    have = spark.createDataFrame([("k1",)], "object_key string")
    fresh = spark.createDataFrame([("k1", "a"), ("k2", "c"), ("k2", "b"), ("k3", "d"), ("k3", "d"), ("k3", "d"), ("k4", None)], "object_key string, body string")
    put, refused = lifecycle.put_objects(have, fresh)
    assert sorted(map(tuple, put.collect()), key=str) == [("k2", "b"), ("k3", "d"), ("k4", None)]
    assert sorted(map(tuple, refused.collect())) == [("k1", "a"), ("k2", "c"), ("k3", "d"), ("k3", "d")]


def test_upsert_of_equal_seq_does_not_depend_on_order(spark):
    rows = [(1, 5, f"t{i}") for i in range(40)]
    got = {vectors.upsert(None, spark.createDataFrame(random.Random(s).sample(rows, 40), "id int, seq int, text string").repartition(1 + s)).first().text for s in range(4)}
    assert len(got) == 1


def test_blank_texts_are_a_problem(spark):
    p = spark.createDataFrame([("v", i, t, None, None, [1.0]) for i, t in enumerate(["\n\t", " ", "x", None])], "document_version_id string, chunk_index int, text string, page_start int, page_end int, vector array<float>")
    assert {r.chunk_index: r.problem for r in vectors.check_points(p, 1).collect()} == {0: "text", 1: "text", 2: None, 3: "text"}


def test_an_answer_that_cannot_be_read(spark):
    def provider():
        def ask(texts):
            raise ValueError("no JSON")

        return ask

    df = spark.createDataFrame([([], "x")], "heading_path array<string>, text string")
    assert vectors.embed(df, provider, 2).first().error_code == "EMBEDDING_RESPONSE_INVALID"


LINE = "doc_key string, page_number int, line_idx int, text string, max_size double, body double"


def test_furniture_of_first_lines(spark):
    firsts = ["Том", "___", "***", "— —", "7" * 40, "0007", "7", "8"]
    rows = [(f"d{i}", 7, j, t if j == 0 else f"line {i} {j}", 10.0, 10.0) for i, t in enumerate(firsts) for j in range(6)]
    got = {r.text for r in layout.furniture(spark.createDataFrame(rows, LINE)).filter("furniture").collect()}
    assert got == {"***", "— —", "0007", "7"}


def test_heading_levels_go_by_tenths(spark):
    sizes = [14.4, 14.3, 14.26, 20.04, 20.0, 12.0]
    rows = [("d", 1, i, f"h{i}", s, 10.0, 0.0, False, False) for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, LINE + ", bold_ratio double, furniture boolean, footnote boolean")
    assert {r.line_idx: r.level for r in layout.headings(df).collect()} == {0: 2, 1: 3, 2: 3, 3: 1, 4: 1, 5: 4}


@pytest.mark.parametrize("seed", range(5))
def test_long_prose_is_cut_as_before(seed):
    rng = random.Random(seed)
    ws = [f"w{i}" + rng.choice(["", "", "", ".", "?\""]) for i in range(rng.randrange(1, 5000))]
    text = " ".join(ws)
    assert chunking.split_prose(text, [], chunking.Profile(), chunking.words) == [" ".join(x) for x in brute_split(ws)]


def test_tokenizer_counts_special_tokens(spark, tmp_path):
    """A file whose post-processor adds two special tokens; chunks are cut by its counts."""
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer(tokenizers.models.WordLevel({w: i for i, w in enumerate(["?", "<", ">", "a", "b", "."])}, unk_token="?"))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    t.post_processor = tokenizers.processors.TemplateProcessing(single="< $A >", special_tokens=[("<", 1), (">", 2)])
    t.save(str(tmp_path / "t.json"))
    count = chunking.Tokenizer(str(tmp_path / "t.json"))
    texts = ["", "a", "a b. c", "  ", None]
    got = chunking.token_counts(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string"), count).orderBy("i").collect()
    assert [r.n_tokens for r in got] == [2, 3, 6, 2, 0]
    units = [{"kind": "paragraph", "text": "a b a b. " * 9, "content_role": "body", "line_start": 1, "line_end": 1, "page_number": None}]
    made = chunking.pack_section(units, ["b"], chunking.Profile(10, 12, 14, 0, 20), count)
    assert len(made) > 3 and all(count(chunking.embedding_input(["b"], c["text"])) <= 12 for c in made)
    with pytest.raises(ValueError):
        chunking.Tokenizer(" ")


def test_another_model_gets_no_texts(spark, tmp_path):
    sent = str(tmp_path / "sent")

    class Provider:
        def __init__(self, info):
            self.answer = info

        def info(self):
            if self.answer is None:
                raise OSError
            return self.answer

        def __call__(self, texts):
            with open(sent, "a") as f:
                f.writelines(texts)
            return [[1.0] for _ in texts]

    docs, model = spark.createDataFrame([(None, "x")], "heading_path string, text string"), vectors.Model("m", "r", 1)
    errors = [vectors.embed(docs, lambda i=i: Provider(i), 1, model=model).first().error_code for i in ({"model_id": "m", "model_sha": "q"}, {"model_id": "n", "model_sha": "r"}, [], None)]
    assert errors == ["EMBEDDING_RESPONSE_INVALID"] * 3 + ["EMBEDDING_PROVIDER_UNAVAILABLE"] and not (tmp_path / "sent").exists()
    assert vectors.embed(docs, lambda: Provider({"model_id": "m", "model_sha": "r"}), 1, model=model).first().vector == [1.0]


def test_evaluation_document(spark):
    suite = spark.createDataFrame([("s", None, "q1", "t", "p"), ("s", None, "q2", "t", "p")], "suite_id string, description string, query_id string, text string, purpose string")
    found = spark.createDataFrame([("q1", 2, "b", 0.5, '{"x": [1]}'), ("q1", 1, "a", 0.5, "{}")], "query_id string, rank int, id string, score double, payload string")
    got = json.loads(vectors.evaluation(suite, found, {"document_version_id": "v", "collection": "c", "top_k": 2}, vectors.Model("m", "r", 3), "now", collection='{"n": 1}').first().document)
    assert list(got) == ["schema_version", "captured_at", "git_revision", "suite", "target", "embedding_profile", "qdrant_collection_info", "queries"]
    assert got["suite"] == {"suite_id": "s", "description": None} and got["qdrant_collection_info"] == {"n": 1} and got["git_revision"] == "unknown"
    assert got["embedding_profile"] == {"model_id": "m", "model_revision": "r", "vector_dimension": 3, "query_instruction": None}
    first, second = got["queries"]
    assert [(r["rank"], r["point_id"], r["payload"]) for r in first["results"]] == [(1, "a", {}), (2, "b", {"x": [1]})] and second["results"] == []


def test_unknown_steps_and_nulls(spark):
    runs = spark.createDataFrame([(1, None, None), (2, "store", None)], "addition_id int, failed_step string, error string")
    got = [(r.addition_id, r.checkpoint, r.failure_code) for r in lifecycle.checkpoints(runs).orderBy("addition_id", "seq").collect()]
    assert got == [(1, c, None) for c in ("accept", "start", "register", "complete")] + [(2, "accept", None), (2, "fail", "PROCESSING_FAILED")]


def slow_lines(words):
    """doc, page, line and text of words (doc, page, seq, text, x0, top, size), by the rule itself."""
    out = []
    for key, own in itertools.groupby(sorted(words, key=lambda w: (w[0], w[1], w[5], w[4], w[2])), key=lambda w: w[:2]):
        lines = []
        for w in own:
            centre = w[5] + w[6] / 2
            if not lines or abs(centre - statistics.median(x[5] + x[6] / 2 for x in lines[-1])) > max(w[6], statistics.median(x[6] for x in lines[-1])) * 0.3:
                lines.append([])
            lines[-1].append(w)
        out += [(*key, i, " ".join(x[3] for x in sorted(line, key=lambda x: (x[4], x[2])))) for i, line in enumerate(lines)]
    return out


def test_lines_of_even_and_of_mixed_pages(spark, monkeypatch):
    rnd = random.Random(3)
    words = [("d%d" % (i % 3), i // 60 % 7, i, f"w{i}", rnd.choice([0.0, 9.0, 20.0]), rnd.choice([0.0, 1.0, 2.5, 12.0, 15.0]) if i % 2 else 30.0, rnd.choice([8.0, 10.0])) for i in range(1500)]
    words += [("e", 1, i, f"w{i}", 10.0 * (i % 8), 24.0 * (i // 8), 10.0) for i in range(200)]
    rows = [(d, p, seq, f"\u00a0{t} ", x, x + 5, top, top + z, "A-Bold", z) for d, p, seq, t, x, top, z in words] + [("e", 2, 0, " \u2003", 0.0, 1.0, 0.0, 1.0, None, 1.0), ("e", 2, 1, "x", float("nan"), 1.0, 0.0, 1.0, None, 1.0), ("e", 2, 2, None, 0.0, 1.0, 0.0, 1.0, None, 1.0)]
    schema = "doc_key string, page_number int, word_seq int, text string, x0 double, x1 double, top double, bottom double, fontname string, size double"
    want = slow_lines(words)
    for held in (layout.WORDS, 50):  # whole, and with pages that go on from batch to batch
        monkeypatch.setattr(layout, "WORDS", held)
        for frame, together in ((spark.createDataFrame(rnd.sample(rows, len(rows)), schema), False), (spark.createDataFrame(sorted(rows, key=lambda r: r[:3]), schema).coalesce(1), True)):
            got = layout.page_lines(frame, together=together).collect()
            assert sorted((r.doc_key, r.page_number, r.line_idx, r.text) for r in got) == sorted(want)
            assert all(r.bold_ratio == 1 and r.n_chars == sum(map(len, r.text.split())) for r in got)


@pytest.mark.parametrize("name", ["pdf_furniture", "pdf_footnotes", "pdf_headings", "pdf_nodes"])
def test_layout_reads_and_deals_out_its_words_once(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


@pytest.mark.parametrize("name", ["pdf_furniture", "pdf_footnotes", "pdf_headings", "pdf_nodes"])
def test_layout_has_no_row_for_a_word(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") == 1 + (name == "pdf_nodes")


def odd_texts():
    few = [None, "", " \n\t", "one", " a  b\r\n", "a\x0bb \x0b c", "é ü 語　 x", "1 " * 200, "7 | x " * 90, "\f".join("abc"), "· " * 199]
    return few + [" ".join(f"w{i % 977}" for i in range(n)) for n in (8, 199, 200, 201, 5000)]


@pytest.mark.parametrize("bound", [(1 << 20, 60_000), (40, 400)])
def test_set_words_are_all_words(monkeypatch, bound):
    monkeypatch.setattr(pages, "BYTES", bound[0])
    monkeypatch.setattr(pages, "WORDS", bound[1])
    texts = odd_texts()
    batch = pa.RecordBatch.from_pydict({"doc_key": pa.array(range(-3, len(texts))), "text": pa.array(["cut off"] * 3 + texts)}).slice(3)
    tables = list(pages.set_words(batch))
    got = [tuple(r.values()) for t in tables for r in t.to_pylist()]
    want = []
    for doc, text in enumerate(texts):
        for i, w in enumerate(filter(None, re.split(r"[\t\n\f\r ]+", text or ""))):
            line, at = i // 8 % 25, i % 8
            size, top = 18.0 if line == 5 else 7.0 if line > 22 else 10.0, line * 24.0 + 20 * (line > 22)
            want.append((doc, i // 200 + 1, i, w if line else f"Head{at}", at * 50.0, at * 50.0 + 40, top, top + size, "Courier" if line == 10 else "Times", size))
    assert got == want
    seen = [{(d, p) for d, p in zip(t["doc_key"].to_pylist(), t["page_number"].to_pylist())} for t in tables]
    assert sum(map(len, seen)) == len(set().union(*seen))  # no page is in two tables


@pytest.mark.parametrize("name", ["pdf_furniture", "pdf_footnotes"])
def test_layout_of_odd_texts_against_sql(spark, tmp_path, name):
    texts = [t for t in odd_texts() if name == "pdf_furniture" or not set(t or "") & set("\x0b 　")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert canon(queries.QUERIES[name](spark, str(tmp_path)).toPandas()) == canon(con.sql(queries.ORACLE[name]).df())


@pytest.mark.parametrize("repetitions", [1, 2, 3])
def test_furniture_repeats_on_so_many_pages(spark, repetitions):
    rows = [("d", p, j, "abc"[k] if j == 0 else f"{'x' * p} {'y' * j}", 10.0, 10.0) for k, own in enumerate([[1], [2, 3], [4, 5, 6]]) for p in own for j in range(6)]
    got = {r.text for r in layout.furniture(spark.createDataFrame(rows, LINE), layout.Layout(repetitions=repetitions)).filter("furniture AND line_idx = 0").collect()}
    assert got == set("abc"[repetitions - 1 :])


def json_words():
    """Pages of words from rows of them in JSON, in tables of a page or more; made here, as workers don't know this file."""
    kinds = {"doc_key": "int64", "page_number": "int32", "word_seq": "int32", "text": "string"} | dict.fromkeys(["x0", "x1", "top", "bottom"], "float64") | {"fontname": "string", "size": "float64"}

    def words(docs):
        for doc, text in zip(docs["doc_key"].to_pylist(), docs["text"].to_pylist()):
            for own in ({1, 2}, {3}, {4, 5, 6}):
                if rows := [(doc, *w) for w in json.loads(text) if w[0] in own]:
                    yield pa.table([pa.array(x, pa.type_for_alias(kind)) for x, kind in zip(zip(*rows), kinds.values())], list(kinds))

    return words


def odd_pages(seed):
    rnd = random.Random(seed)
    texts = ["1", "02", "3", "000", "7 | x", "x|  12", "x |", "|\u2028| 5", "a\u2028b | 5", "·", "--", "_", "ǅ", "²", "İx", "ΑΣ", "ας", "ασ", "Page 12", "page  3", "a\x0b b", "\u3000note", "• x", "1. y", "12) z", "٣", "x" * 201, "bold", "tail"]
    sizes = [[10.0], [6.0, 7.0, 10.0], [8.25, 8.5, 8.75, 10.0, 10.75, 12.0, 14.3, 14.35, 14.25, 14.2, 18.0]][seed % 3]
    out, top = [], 0.0
    for page in rnd.sample(range(1, 7), rnd.randint(1, 6)):
        for line in range(rnd.choice([1, 2, 3, 4, 5, 12])):
            top += rnd.choice([20.0, 40.0])
            for k in range(rnd.choice([1, 1, 2])):
                size = rnd.choice(sizes)
                out.append((page, line * 2 + k, rnd.choice(texts), k * 50.0, k * 50.0 + 40, top, top + size, rnd.choice(["A", "A-Bold", "Courier"]), size))
    return json.dumps(sorted(out, key=lambda w: w[:2]))


@pytest.mark.parametrize("held", [4 << 20, 700])
@pytest.mark.parametrize("rules", [{}, {"repetitions": 1}, {"repetitions": 3, "edge_lines": 1}])
def test_marks_of_whole_documents_are_those_of_windows(spark, monkeypatch, held, rules):
    monkeypatch.setattr(document_marks, "BYTES", held)
    rows = spark.createDataFrame([(None if i == 7 else i, odd_pages(i)) for i in range(150)], "doc_key long, text string")
    own, key = layout.Layout(**rules), "doc_key bigint, page_number int"
    cols = ["doc_key", "page_number", "line_idx", "text"]
    marked = document_marks.marked_documents(rows, json_words(), cols, ["furniture"], key, own)
    lines = layout.set_lines(rows, json_words(), key, own)
    want = layout.furniture(layout.add_body(lines), own).filter("furniture").select(cols).collect()
    assert want and sorted(map(tuple, marked.collect())) == sorted(map(tuple, want))
    cols += ["body", "furniture", "footnote", "heading", "level"]
    every = document_marks.marked_documents(rows, json_words(), cols, ["furniture", "footnote", "heading"], key, own)
    want = layout.analysed_lines(lines, own).filter("furniture OR footnote OR heading").select(cols)
    assert every.dtypes == want.dtypes
    want = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, every.collect())) == want and all(len({r[i] for r in want}) > 1 for i in range(4, 9))


@pytest.mark.parametrize("name", ["pdf_furniture", "pdf_headings"])
def test_documents_and_no_lines_are_dealt_out(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.index("MapInArrow") < plan.index("Exchange")


def test_marks_of_a_document_in_several_rows(spark, tmp_path):
    """A running head on one page of each of two rows, and a body size that only both rows have."""
    page = lambda p, head, n, size: [(p, 8 * j, head if j == 0 else f"w{j}{'x' * j}" + "y" * p, 0.0, 40.0, 24.0 * j, 24.0 * j + size, "A", size) for j in range(n)]
    rows = [(1, json.dumps(page(4, "head", 6, 10.0))), (2, json.dumps(page(1, "head", 6, 10.0))), (1, json.dumps(page(1, "head", 6, 10.0) + page(2, "other", 5, 14.0)))]
    got = document_marks.marked_documents(spark.createDataFrame(rows, "doc_key long, text string").repartition(3), json_words(), ["doc_key", "page_number", "text", "body", "heading"], ["furniture", "heading"]).collect()
    assert {(r.doc_key, r.page_number) for r in got if r.text == "head"} == {(1, 4), (1, 1)} and {r.body for r in got} == {10.0}
    assert sum(r.heading for r in got) == 5 and {r.page_number for r in got if r.heading} == {2}


def test_few_long_lines_are_marked_together(spark, tmp_path, monkeypatch):
    """By bytes, not by their number: words may be very long."""
    monkeypatch.setattr(document_marks, "BYTES", 100_000)
    most = spark.sparkContext.accumulator(0)
    marked = document_marks._marked

    def counted(lines, *a):
        most.add(int(lines.nbytes > 400_000))
        return marked(lines, *a)

    monkeypatch.setattr(document_marks, "_marked", counted)
    rows = spark.createDataFrame([(i, " ".join("x" * 10_000 for _ in range(9))) for i in range(60)], "doc_key long, text string").coalesce(1)
    found = document_marks.marked_documents(rows, pages.set_words, ["doc_key", "line_idx"], ["furniture"]).count()
    assert found == 0 and most.value == 0
