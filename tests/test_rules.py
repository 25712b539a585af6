import uuid

import pytest
from pyspark.sql import functions as F

from pagemill.functions.text import normalize_nodes
from pagemill.operators import chunking, structure, vectors
from pagemill.operators.chunking import Profile, TooLarge, pack_section
from pagemill.operators.layout import page_nodes
from pagemill.schemas import node
from pagemill.sources import parsers, uploads


def brief(nodes):
    return [(n["kind"], n["level"], n["text"], n["language"], n["line_start"], n["line_end"]) for n in nodes]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("~~~ js\nconst x = 1;\n~~~~\n", [("code", None, "const x = 1;", "js", 1, 3)]),
        ("Main title\n==========\n\nSubtitle\n---\nbody", [("heading", 1, "Main title", None, 1, 2), ("heading", 2, "Subtitle", None, 4, 5), ("paragraph", None, "body", None, 6, 6)]),
        ("```text\nvalue", [("code", None, "value", "text", 1, 2)]),
        ("####### not-heading", [("paragraph", None, "####### not-heading", None, 1, 1)]),
        ("#not-heading", [("paragraph", None, "#not-heading", None, 1, 1)]),
        ("# #", [("heading", 1, "#", None, 1, 1)]),
        ("# API #\n\nfirst\nsecond\n\n### Client", [("heading", 1, "API", None, 1, 1), ("paragraph", None, "first\nsecond", None, 3, 4), ("heading", 3, "Client", None, 6, 6)]),
        ("", []),
        (None, []),
    ],
)
def test_markdown(text, expected):
    assert brief(parsers.markdown_nodes(text)) == expected


def test_plain_text(spark):
    docs = spark.createDataFrame([("a", "first line\ncontinued\n\n\nsecond"), ("b", "alpha\n \t\nbeta\n"), ("c", ""), ("d", None)], "doc_key string, text string")
    rows = {(r.doc_key, r.node_idx): (r.text, r.line_start, r.line_end) for r in parsers.text_paragraphs(docs).collect()}
    assert rows == {("a", 0): ("first line\ncontinued", 1, 2), ("a", 1): ("second", 5, 5), ("b", 0): ("alpha", 1, 1), ("b", 1): ("beta", 3, 3)}
    folded = docs.select("doc_key", parsers.paragraph_nodes(F.col("text")).alias("n")).collect()
    assert {(r.doc_key, i): (x.text, x.line_start, x.line_end) for r in folded for i, x in enumerate(r.n or [])} == rows


def para(text, page=1, role="body"):
    return node("paragraph", text, page_number=page, content_role=role)


def texts(nodes):
    return [n["text"] for n in normalize_nodes(nodes)[0]]


def test_hyphens():
    assert texts([para("Domain-driven design is a known compound."), para("A represen-\ntation remains Domain-\ndriven.", 2)]) == ["Domain-driven design is a known compound.", "A representation remains Domain-driven."]
    assert texts([para("Бизнес-\nценности важны.")]) == ["Бизнес-ценности важны."]
    assert texts([para("пред-ставляет"), para("представляет", 2), para("Client-server")]) == ["представляет", "представляет", "Client-server"]
    assert texts([para("Для этого было проведе-"), para("1", role="footnote"), para("но много")]) == ["Для этого было", "1", "проведено много"]
    assert texts([node("paragraph", "author-provided-\nbreak", line_start=1, line_end=2)]) == ["author-provided- break"]
    assert normalize_nodes([node("heading", "x", level=1)])[1] == "NO_EXTRACTABLE_TEXT"
    assert texts([node("code", "\n\tcall()  \r\n\r\n  next()\t\n", language=" py "), para("Cafe\u0301\t guide")]) == ["\tcall()\n\n  next()", "Caf\u00e9 guide"]


def unit(text, kind="paragraph", role="body", lines=(None, None)):
    return node(kind, text, content_role=role, line_start=lines[0], line_end=lines[1])


@pytest.mark.parametrize(
    "units, profile, count, expected",
    [
        ([unit("one two three"), unit("four five")], Profile(4, 5, 6, 0, 6), chunking.words, ["one two three\n\nfour five"]),
        ([unit("one two three"), unit("four five")], Profile(4, 4, 6, 0, 6), chunking.words, ["one two three", "four five"]),
        ([unit("intro"), unit("x = 1", "code")], Profile(4, 4, 5, 0, 5), chunking.words, ["intro\n\nx = 1"]),
        ([unit("First sentence. Second sentence has several words.")], Profile(4, 4, 5, 0, 5), chunking.words, ["First sentence.", "Second sentence has several", "words."]),
        ([unit("abcdefgh")], Profile(4, 4, 5, 0, 6), len, ["abcd", "efgh"]),
        ([unit("alpha bravo charlie delta echo foxtrot golf"), unit("next")], Profile(4, 4, 5, 1, 5), chunking.words, ["alpha bravo charlie delta", "delta echo foxtrot golf", "next"]),
    ],
)
def test_packing(units, profile, count, expected):
    assert [c["text"] for c in pack_section(units, [], profile, count)] == expected


def test_packing_limits():
    with pytest.raises(TooLarge, match="6 tokens; safety limit is 5"):
        pack_section([unit("a b c d e f", "code")], [], Profile(3, 3, 4, 0, 5))
    assert pack_section([unit("a", lines=(2, 3)), unit("b", lines=(7, 8))], [], Profile(10, 10, 10, 0, 10))[0]["source_line_end"] == 8
    assert [c["text"] for c in pack_section([unit("one two three four")], ["Chapter context"], Profile(4, 4, 5, 0, 5))] == ["one two", "three four"]
    for bad in ((0, 1, 1, 0, 1), (5, 4, 6, 0, 7), (4, 5, 6, 4, 7), (4, 5, 6, -1, 7), (4, 7, 6, 0, 7), (4, 5, 9, 0, 7)):
        with pytest.raises(ValueError):
            Profile(*bad)


def test_structure(spark):
    rows = [("h", 3, "ЧАСТЬ I", 31), ("h", 1, "Начало", 31), ("h", 3, "Part 4", 33), ("p", None, "text", 33)]
    nodes = spark.createDataFrame([("d", i, "heading" if k == "h" else "paragraph", lv, t, p, "body") for i, (k, lv, t, p) in enumerate(rows)], "doc_key string, node_idx int, kind string, level int, text string, page_number int, content_role string")
    assert [(r.level, r.text) for r in structure.compose_headings(nodes).orderBy("node_idx").collect()] == [(1, "ЧАСТЬ I — Начало"), (3, "Part 4"), (None, "text")]


def test_uploads(spark):
    rows = [("a.txt", "Text/Plain; Charset=UTF-8", b"x", None), ("a.txt", "text/plain; charset=latin1", b"x", "UNSUPPORTED_MEDIA_TYPE"), ("a.txt", "text/plain", b"\xff", "INVALID_CONTENT"), ("a.txt", "text/plain", b"", "EMPTY"), ("a.txt", "text/plain", None, "EMPTY"), ("c:\\x\\a.PDF", "application/pdf", b"%PDF-1", None), ("a.md", "text/plain", b"x", "UNSUPPORTED_MEDIA_TYPE"), ("a.txt", "text/plain", b"x" * 9, "TOO_LARGE"), (None, None, b"x", "UNSUPPORTED_MEDIA_TYPE")]
    df = spark.createDataFrame([("k", *r) for r in rows], "kb_id string, filename string, media_type string, content binary, expected string")
    assert [r.reject_code for r in uploads.validate(df, max_bytes=8).collect()] == [r[3] for r in rows]
    bases = spark.createDataFrame([("k", "ARCHIVED")], "kb_id string, kb_status string")
    assert uploads.validate(df.limit(1), bases).first().http_status == 409


def test_point_ids(spark):
    ns = "30000000-0000-0000-0000-000000000003"
    got = spark.range(50).select(vectors.point_id(F.lit(ns), F.col("id")).alias("x")).collect()
    assert [r.x for r in got] == [str(uuid.uuid5(uuid.UUID(ns), f"chunk:{i}")) for i in range(50)]
    assert got[1].x == "e3f23926-3bd0-5134-82b5-d27693a96f5f"


def line(text, top, size=10.0, **more):
    return {"text": text, "page_number": 1, "x0": 0.0, "top": top, "bottom": top + size, "size": size, "code_ratio": 0.0, "body": 10.0, "furniture": False, "footnote": False, "heading": False, "level": None} | more


def test_page_nodes():
    rows = [line("head", 0, furniture=True), line("Big", 30, 20.0, heading=True, level=1), line("title", 52, 20.0, heading=True, level=1), line("one", 80), line("two", 92), line("- item", 104), line("three", 130), line("x = 1", 142, code_ratio=1.0), line("y", 154, code_ratio=1.0, x0=12.0), line("note", 200, footnote=True)]
    got = [(n["kind"], n["text"], n["content_role"]) for n in page_nodes(rows)]
    assert got == [("paragraph", "head", "header_footer"), ("heading", "Big title", "body"), ("paragraph", "one\ntwo", "body"), ("paragraph", "- item", "body"), ("paragraph", "three", "body"), ("code", "x = 1\n  y", "body"), ("paragraph", "note", "footnote")]


def test_embedding(spark):
    df = spark.createDataFrame([(1, [], "a"), (2, ["h"], "b"), (3, [], " ")], "i int, heading_path array<string>, text string")
    got = {r.i: (r.input, r.vector, r.error_code) for r in vectors.embed(df, lambda: lambda ts: [[1.0, float(len(t))] for t in ts], 2, 2).collect()}
    assert got[2] == ("h\n\nb", [1.0, 4.0], None) and got[3][2] == "EMBEDDING_RESPONSE_INVALID"
    bad = vectors.embed(df, lambda: lambda ts: [[1.0, float("inf")] for _ in ts], 2).collect()
    assert {r.error_code for r in bad} == {"EMBEDDING_RESPONSE_INVALID"}


def test_stream(spark, tmp_path):
    from pagemill.streaming.ingest import stream_uploads

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello")
    seen = []
    q = stream_uploads(spark, str(tmp_path / "in"), "kb", lambda df, i: seen.extend(uploads.validate(df).collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert [(r.filename, r.reject_code) for r in seen] == [("a.txt", None)]


def test_files(spark, tmp_path):
    (tmp_path / "b.md").write_text("# x")
    assert [(r.filename, r.media_type) for r in uploads.read_files(spark, str(tmp_path), "kb").collect()] == [("b.md", "text/markdown")]


def test_search_in_blocks(spark, monkeypatch):
    points = spark.range(40).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector"))
    queries = points.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    whole = sorted(vectors.search(points, queries, 3, "euclid").collect())
    monkeypatch.setattr(vectors, "BLOCK", 15)
    assert len(whole) == 120 and sorted(vectors.search(points, queries, 3, "euclid").collect()) == whole


def test_index_refuses_faulty_versions(spark):
    rows = [("v1", 0, "a", [1.0]), ("v1", 1, "b", [2.0]), ("v2", 0, "a", [1.0]), ("v2", 1, " ", [1.0])]
    points = spark.createDataFrame([(*r, None, None, 1) for r in rows], "document_version_id string, chunk_index int, text string, vector array<double>, page_start int, page_end int, seq int")
    points = points.withColumn("document_version_id", F.when(F.col("document_version_id") == "v1", "00000000-0000-4000-8000-000000000001").otherwise("00000000-0000-4000-8000-000000000002"))
    stored, done = vectors.index(None, points, 1, "c")
    assert [r.indexed_chunk_count for r in done.collect()] == [2]
    again, _ = vectors.index(stored, points, 1, "c")
    assert again.count() == 2
