"""Parsers: decoded text to ordered nodes. Plain text is native; Markdown's open fences need a pass in order, in Python."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, lines
from ..schemas import NODES, node


def paragraph_nodes(text: Column) -> Column:
    """A plain text's paragraphs as nodes: blocks of lines between blank ones, found by where they start and end. One pass over
    the lines inside the row; the lines and their marks are bound to variables, else each step would split the text again."""
    null = lambda t: F.lit(None).cast(t)

    def blocks(rows: Column, blank: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(rows) - 1)
        edge = lambda i, beside: ~F.get(blank, i) & F.coalesce(F.get(blank, beside), F.lit(True))
        starts, ends = F.filter(at, lambda i: edge(i, i - 1)), F.filter(at, lambda i: edge(i, i + 1))
        block = lambda s, e: F.struct(
            F.lit("paragraph").alias("kind"), null("int").alias("level"), F.array_join(F.slice(rows, s + 1, e - s + 1), "\n").alias("text"), null("string").alias("language"),
            (s + 1).alias("line_start"), (e + 1).alias("line_end"), null("int").alias("page_number"), F.lit("body").alias("content_role"),
        )
        return F.when(F.size(rows) > 0, F.zip_with(starts, ends, block)).otherwise(F.array().cast(NODES)).cast(NODES)

    mark = lambda rows: F.transform(rows, lambda r: r.rlike(rf"\A{SPACE}*\z"))
    found = F.transform(F.array(lines(text)), lambda rows: F.transform(F.array(mark(rows)), lambda blank: blocks(rows, blank))[0])[0]
    return F.when(text.isNotNull(), found)


def text_paragraphs(docs: DataFrame, key: str = "doc_key") -> DataFrame:
    """key, node_idx, text, line_start, line_end of plain texts."""
    nodes = docs.select(key, F.posexplode(paragraph_nodes(F.col("text"))).alias("node_idx", "n"))
    return nodes.select(key, "node_idx", "n.text", "n.line_start", "n.line_end")


_atx = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?)|[ \t]*)")
_fence = re.compile(r" {0,3}(`{3,}|~{3,})(.*)")
_rule = re.compile(r" {0,3}(=+|-+)[ \t]*")


def markdown_nodes(text: str | None) -> list[dict]:
    """Headings (both kinds), fenced code and paragraphs of a Markdown text, with their 1-based lines."""
    out: list[dict] = []
    held: list[str] = []  # a paragraph's lines so far
    began = 0
    fence: tuple[str, int, str | None, int] | None = None  # its sign, length, language, line
    body: list[str] = []

    def close(end: int) -> None:
        if held:
            out.append(node("paragraph", "\n".join(held), line_start=began, line_end=end))
            held.clear()

    rows = (text or "").splitlines()
    for n, row in enumerate(rows, 1):
        if fence:
            end = re.fullmatch(rf" {{0,3}}{re.escape(fence[0])}{{{fence[1]},}}[ \t]*", row)
            if end:
                out.append(node("code", "\n".join(body), language=fence[2], line_start=fence[3], line_end=n))
                fence = None
            else:
                body.append(row)
            continue
        if not row.strip():
            close(n - 1)
            continue
        if m := _atx.fullmatch(row):
            close(n - 1)
            title = re.sub(r"[ \t]+#+[ \t]*$", "", m[2] or "").strip()
            out.append(node("heading", title, level=len(m[1]), line_start=n, line_end=n))
            continue
        m = _fence.fullmatch(row)
        if m and not (m[1][0] == "`" and "`" in m[2]):
            close(n - 1)
            info = m[2].split()
            fence, body = (m[1][0], len(m[1]), info[0] if info else None, n), []
            continue
        m = _rule.fullmatch(row)
        if m and held:
            title = "\n".join(held).strip()
            held.clear()
            out.append(node("heading", title, level=1 if m[1][0] == "=" else 2, line_start=began, line_end=n))
            continue
        if not held:
            began = n
        held.append(row)
    if fence:
        out.append(node("code", "\n".join(body), language=fence[2], line_start=fence[3], line_end=len(rows)))
    close(len(rows))
    return out


def markdown(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(markdown_nodes)

    return F.pandas_udf(run, NODES)(text)


def parse(docs: DataFrame, extra: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Adds nodes and error_code to decoded documents (text, route): each route has its parser, others are unsupported."""
    routes = {"text/plain": paragraph_nodes, "text/markdown": markdown} | (extra or {})
    for r in routes:
        if not r or r != r.strip().lower() or ";" in r or "/" not in r:
            raise ValueError(f"not a media type: {r!r}")
    nodes = F.lit(None).cast(NODES)
    for r, f in routes.items():
        here = F.col("route") == r
        nodes = F.when(here, f(F.when(here, F.col("text")))).otherwise(nodes)  # Python parsers run on every row, so others' texts are null there
    error = F.when(~F.col("route").isin(*routes), "UNSUPPORTED_MEDIA_TYPE").when(F.col("text").isNull(), "PARSING_FAILED")
    return docs.withColumn("nodes", nodes).withColumn("error_code", error)
