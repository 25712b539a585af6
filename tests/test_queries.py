import unicodedata

import duckdb
import pytest
from conftest import SF, canon, tables

from pagemill import queries


@pytest.fixture(scope="module")
def con():
    return tables(duckdb.connect())


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.ORACLE])
def test_against_sql(spark, con, name):
    assert canon(queries.QUERIES[name](spark, SF).toPandas()) == canon(con.sql(queries.ORACLE[name]).df())


def test_layout_flags(spark):
    rows = queries.pdf_headings(spark, SF).toPandas()
    # the large line is a heading of level 1; the two small ones at the end are a footnote
    assert set(rows[rows.heading].line_idx) <= {5} and set(rows[rows.heading].level) == {1}
    assert set(rows[rows.footnote & ~rows.heading].line_idx) <= {23, 24}


def test_partitioning_does_not_matter(spark):
    a = queries.chk_pack(spark, SF).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = queries.chk_pack(spark, SF).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert canon(a) == canon(b)


def brute_split(ws):
    """A paragraph's words in pieces of at most 600, each after up to 80 words of the one before; cut at sentences, else words."""
    out, at, core = [], 0, []
    while at < len(ws):
        lead = core[-80:]
        end = min(len(ws), at + 600 - len(lead))
        if end < len(ws):
            end = max((i + 1 for i in range(at, end) if ws[i].rstrip("\"')]")[-1:] in tuple(".!?…。！？")), default=end)
        core = ws[at:end]
        out.append(lead + core)
        at = end
    return out


def brute_chunks(text):
    """(text, first line, last line) of a plain text's chunks."""
    units, block = [], []
    rows = unicodedata.normalize("NFC", (text or "").removeprefix("\ufeff")).splitlines()
    for i, row in enumerate([*rows, ""], 1):
        if row.strip():
            block.append((i, row))
        elif block:
            units.append((" ".join(r for _, r in block).split(), block[0][0], block[-1][0]))
            block = []
    if sum(len(u[0]) for u in units) <= 800:
        groups = [units] if units else []
    else:
        groups, pending = [], []
        for u in units:
            if len(u[0]) > 800:
                groups += [pending, *([(ws, *u[1:])] for ws in brute_split(u[0]))]
                pending = []
            else:
                if sum(len(x[0]) for x in [*pending, u]) > 600:
                    groups.append(pending)
                    pending = []
                pending.append(u)
        groups = [g for g in [*groups, pending] if g]
    return [("\n\n".join(" ".join(u[0]) for u in g), g[0][1], g[-1][2]) for g in groups]


def long_texts():
    word = lambda i: f"w{i}" + (".", "!\"", "", "", "", "", "", "")[i * i % 8 if i % 90 == 0 else 2]
    plain = " ".join(f"x{i}" for i in range(2500))
    prose = " ".join(word(i) for i in range(1900))
    paragraphs = "\n\n".join("\n".join(" ".join(f"p{p}l{n}w{i}" for i in range(9)) for n in range(1 + p * 7 % 40)) for p in range(60))
    return [plain, prose, paragraphs, paragraphs.replace("\n", "\r\n"), f"{paragraphs}\n \n{prose}\n\n\n{plain}\nend", "\ufeffone\ntwo\n\nthree", " \n\t\n", "", None, " ".join(["e\u0301"] * 800), " ".join(["a"] * 801)]


def test_ingests_whole_documents(spark, tmp_path):
    held = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    held += [(10**6 + i, t) for i, t in enumerate(long_texts())]
    spark.createDataFrame(held, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in queries.ingest_documents(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, {})[r.chunk_index] = (r.text, r.source_line_start, r.source_line_end)
    expected = {i: dict(enumerate(c)) for i, t in held if (c := brute_chunks(t))}
    assert got == expected
    assert sum(len(c) > 1 for c in got.values()) > 5 and any("\n\n" in x[0] for c in got.values() for x in c.values())


def test_entry_is_whole(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    texts = queries.table(spark, __spark_entry__.SF_SMALL, "documents").select("doc_id", "text").collect()
    assert len(rows) == sum(len(brute_chunks(r.text)) for r in texts) and max(r.chunk_index for r in rows) > 0
