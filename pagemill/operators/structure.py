"""Structure over node rows (key, node_idx, kind, level, text, page_number, content_role, ...), all by windows over a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import INDEXED_ROLES

# Heading vocabularies.
LABEL = r"(?iu)^\s*(часть|part|глава|chapter)\s+(\d+|[ivxlcdm]+)\s*$"
CONTENTS = r"(?iu)^\s*(оглавление|содержание|contents|table of contents)\s*$"
FRONT = r"(?iu)^\s*(предисловие(\s.*)?|об авторе|благодарности|посвящение|от издательства|foreword|preface|acknowledge?ments|about the author)\s*$"
BODY = r"(?iu)^\s*(часть|part|глава|chapter)\s+(\d+|[ivxlcdm]+)(?![\p{L}\p{N}_])"


def explode_nodes(docs: DataFrame, key: str = "doc_key") -> DataFrame:
    return docs.select(key, F.posexplode("nodes").alias("node_idx", "n")).select(key, "node_idx", "n.*")


def compose_headings(nodes: DataFrame, key: str = "doc_key") -> DataFrame:
    """A numbered label and the heading after it, on the same page, become one; pairs can't overlap, as the second isn't a label."""
    w = Window.partitionBy(key).orderBy("node_idx")
    label = (F.col("kind") == "heading") & F.col("text").rlike(LABEL)
    plain = F.struct("kind", "text", "level", "page_number", "content_role", label.alias("label"))
    here, after, before = plain, F.lead(plain).over(w), F.lag(plain).over(w)

    def pair(a, b):
        return F.coalesce((a.kind == "heading") & (b.kind == "heading") & a.label & ~b.label & (a.page_number == b.page_number) & (a.content_role != "header_footer") & (b.content_role != "header_footer"), F.lit(False))

    with_pairs = nodes.withColumn("_here", here).withColumn("_next", after).withColumn("_last", before)
    first, second = pair(F.col("_here"), F.col("_next")), pair(F.col("_last"), F.col("_here"))
    joined = with_pairs.withColumn("_first", first).filter(~second)
    out = joined.withColumn("text", F.when(F.col("_first"), F.concat("text", F.lit(" — "), F.col("_next.text"))).otherwise(F.col("text"))).withColumn("level", F.when(F.col("_first"), F.col("_next.level")).otherwise(F.col("level")))
    return out.drop("_here", "_next", "_last", "_first").withColumn("node_idx", F.row_number().over(w) - 1)


def classify_roles(nodes: DataFrame, key: str = "doc_key") -> DataFrame:
    """Headings switch the role of the paged nodes after them; documents without pages stay as they are."""
    whole = Window.partitionBy(key)
    so_far = whole.orderBy("node_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = (F.col("kind") == "heading") & ~F.col("content_role").isin("header_footer", "footnote") & F.col("page_number").isNotNull()
    mark = F.when(heading, F.when(F.col("text").rlike(CONTENTS), "table_of_contents").when(F.col("text").rlike(FRONT), "front_matter").when(F.col("text").rlike(BODY), "body"))
    any_contents = F.max(((F.col("kind") == "heading") & F.col("text").rlike(CONTENTS)).cast("int")).over(whole) == 1
    role = F.coalesce(F.last(mark, ignorenulls=True).over(so_far), F.when(any_contents, "front_matter").otherwise("body"))
    keeps = F.col("page_number").isNull() | F.col("content_role").isin("header_footer", "footnote")
    return nodes.withColumn("content_role", F.when(keeps, F.col("content_role")).otherwise(role))


def select_indexed(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("content_role").isin(*INDEXED_ROLES))


def heading_paths(nodes: DataFrame, key: str = "doc_key") -> DataFrame:
    """heading_path: the stack of headings in force at each node. A level's last heading is live unless a higher level came after it."""
    so_far = Window.partitionBy(key).orderBy("node_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = [F.last(F.when((F.col("kind") == "heading") & (F.col("level") == i), F.struct("node_idx", "text")), ignorenulls=True).over(so_far) for i in range(1, 7)]
    out = nodes
    for i, x in enumerate(last, 1):
        out = out.withColumn(f"_h{i}", x)
    live, above = [], F.lit(-1)
    for i in range(1, 7):
        h = F.col(f"_h{i}")
        live.append(F.when(h.isNotNull() & (h.node_idx > above), h.text))
        above = F.greatest(above, F.coalesce(h.node_idx, F.lit(-1)))
    return out.withColumn("heading_path", F.filter(F.array(*live), lambda x: x.isNotNull())).drop(*(f"_h{i}" for i in range(1, 7)))


def sections(nodes: DataFrame, key: str = "doc_key") -> DataFrame:
    """section: a number that grows at each heading and where the role changes between neighbouring content nodes."""
    w = Window.partitionBy(key).orderBy("node_idx")
    head = F.col("kind") == "heading"
    turn = ~head & (F.lag("kind").over(w) != "heading") & (F.lag("content_role").over(w) != F.col("content_role"))
    out = nodes.withColumn("_new", F.when(head | F.coalesce(turn, F.lit(False)), 1).otherwise(0))
    return out.withColumn("section", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def section_units(nodes: DataFrame, key: str = "doc_key") -> DataFrame:
    """One row a section with content: heading_path and its units in order."""
    fields = ("node_idx", "kind", "text", "content_role", "line_start", "line_end", "page_number")
    content = nodes.filter("kind <> 'heading'")
    return content.groupBy(key, "section").agg(F.min_by("heading_path", "node_idx").alias("heading_path"), F.array_sort(F.collect_list(F.struct(*fields))).alias("units"))
