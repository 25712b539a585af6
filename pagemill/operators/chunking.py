"""Chunks: sections that fit are one chunk natively; the others are packed and split in order, one section at a time."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from typing import ClassVar

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_count
from ..schemas import CHUNK

TokenCounter = Callable[[str], int]


def words(text: str) -> int:
    return len(text.split())


class Tokenizer:
    """Counts a tokenizer file's tokens, special ones included. Only the path travels; a worker loads the file once."""

    loaded: ClassVar[dict] = {}

    def __init__(self, path: str):
        if not path.strip():
            raise ValueError("the tokenizer's path must not be blank")
        self.path = path

    def __call__(self, text: str) -> int:
        if self.path not in self.loaded:
            from tokenizers import Tokenizer as File

            self.loaded[self.path] = File.from_file(self.path)
        return len(self.loaded[self.path].encode(text, add_special_tokens=True).ids)


def token_counts(texts: DataFrame, count: TokenCounter = words, column: str = "text") -> DataFrame:
    """Adds n_tokens; null texts have none."""

    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([0 if t is None else count(t) for t in batch], dtype="int64")

    return texts.withColumn("n_tokens", F.pandas_udf(run, "long")(column))


@dataclass(frozen=True)
class Profile:
    target: int = 600
    soft: int = 800
    hard: int = 1000
    overlap: int = 80
    embedding: int = 2048

    def __post_init__(self):
        if not 1 <= self.target <= self.soft <= self.hard <= self.embedding or not 0 <= self.overlap < self.target:
            raise ValueError("limits must satisfy 1 <= target <= soft <= hard <= embedding and 0 <= overlap < target")


class TooLarge(ValueError):
    pass


def embedding_input(path: list[str], text: str) -> str:
    return "\n\n".join([*path, text])


# What ends a sentence.
_sentence = re.compile(r"[.!?…。！？][\"')\]]*(?=\s|$)")
_word = re.compile(r"\S+\s*")


def split_prose(text: str, path: list[str], p: Profile, count: TokenCounter) -> list[str]:
    """Pieces of at most ``target`` tokens, each after an overlap from the one before; cut at sentences, else words, else characters."""
    sentence_ends, word_ends = [m.end() for m in _sentence.finditer(text)], [m.end() for m in _word.finditer(text)]
    out, at, core, plain = [], 0, "", count is words
    while at < len(text):
        lead = ""
        if p.overlap:
            for m in reversed(list(re.finditer(r"\S+", core))):
                tail = core[m.start() :]
                if count(tail) > p.overlap:
                    break
                lead = tail

        def fits(end: int) -> bool:
            piece = text[at:end].strip()
            return count(embedding_input(path, f"{lead} {piece}" if lead else piece)) <= p.target

        # of words, a piece holds no more than its limit, so nothing behind that many needs a look
        behind = bisect_right(word_ends, at) + p.target if plain else len(word_ends)
        limit = word_ends[behind - 1] if behind <= len(word_ends) else len(text)

        def last(ends: list[int]) -> int | None:
            after = ends[bisect_right(ends, at) : bisect_right(ends, limit)]
            if plain:  # word counts grow with the text, so the last that fits is found by halving
                lo, hi = 0, len(after)
                while lo < hi:
                    mid = (lo + hi) // 2
                    lo, hi = (mid + 1, hi) if fits(after[mid]) else (lo, mid)
                return after[lo - 1] if lo else None
            return max((e for e in after if fits(e)), default=None)

        end = len(text) if (not plain or limit == len(text)) and fits(len(text)) else last(sentence_ends) or last(word_ends)
        if end is None:
            lo, hi = at, len(text)
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if fits(mid) else (lo, mid - 1)
            end = lo
        if end <= at:
            raise TooLarge(f"heading path leaves no room for prose: minimum input has {count(embedding_input(path, text[at : at + 1]))} tokens; target is {p.target}")
        core = text[at:end].strip()
        if not core:
            raise TooLarge("prose cannot make progress within token limit")
        out.append(f"{lead} {core}" if lead else core)
        at = end
        while at < len(text) and text[at].isspace():
            at += 1
    return out


def assemble(units: list[dict], path: list[str]) -> dict:
    kinds = {"code" if u["kind"] == "code" else "text" for u in units}
    low = lambda f: min((u[f] for u in units if u[f] is not None), default=None)
    high = lambda f: max((u[f] for u in units if u[f] is not None), default=None)
    return {"heading_path": path, "text": "\n\n".join(u["text"] for u in units), "content_type": kinds.pop() if len(kinds) == 1 else "mixed", "content_role": units[0]["content_role"], "source_line_start": low("line_start"), "source_line_end": high("line_end"), "page_start": low("page_number"), "page_end": high("page_number")}


def pack_section(units: list[dict], path: list[str], p: Profile, count: TokenCounter = words) -> list[dict]:
    """A section's chunks in order."""
    size = lambda us: count(embedding_input(path, "\n\n".join(u["text"] for u in us)))
    for u in units:
        if u["kind"] == "code" and (n := size([u])) > p.embedding:
            raise TooLarge(f"code block embedding input has {n} tokens; safety limit is {p.embedding}")
    if not units or size(units) <= p.soft:
        return [assemble(units, path)] if units else []
    groups: list[list[dict]] = []
    pending: list[dict] = []
    for u in units:
        n = size([u])
        alone = [[u]] if u["kind"] == "code" and n > p.hard else [[dict(u, text=t)] for t in split_prose(u["text"], path, p, count)] if u["kind"] != "code" and n > p.soft else None
        if alone is not None or pending and size([*pending, u]) > p.target:
            groups += [pending] * bool(pending)
            pending = []
        if alone is not None:
            groups += alone
        else:
            pending.append(u)
    return [assemble(g, path) for g in [*groups, *[pending] * bool(pending)]]


def chunk_sections(sections: DataFrame, profile: Profile = Profile(), count: TokenCounter = words, key: str = "doc_key") -> DataFrame:
    """key, section, chunks, error_code from rows of heading_path and units. With the plain word counter, sections that fit are one chunk
    natively, and Python gets null for them."""

    def run(paths: pd.Series, units: pd.Series) -> pd.DataFrame:
        chunks, errors = [], []
        for path, us in zip(paths, units):
            if us is None:
                chunks.append(None)
                errors.append(None)
                continue
            try:
                chunks.append(pack_section([dict(u) if isinstance(u, dict) else u.asDict() for u in us], list(path), profile, count))
                errors.append(None)
            except TooLarge:
                chunks.append([])
                errors.append("CONTENT_BLOCK_TOO_LARGE")
        return pd.DataFrame({"chunks": chunks, "error_code": errors})

    packed = F.pandas_udf(run, f"struct<chunks: array<{CHUNK}>, error_code: string>")
    if count is not words:
        return sections.withColumn("_c", packed("heading_path", "units")).select(key, "section", "_c.chunks", "_c.error_code")
    one = whole_sections(sections).withColumn("_fits", F.col("n_tokens") <= profile.soft)
    one = one.withColumn("_c", packed("heading_path", F.when(~F.col("_fits"), F.col("units"))))
    native = F.array(F.struct("heading_path", "text", "content_type", "content_role", "source_line_start", "source_line_end", "page_start", "page_end")).cast(f"array<{CHUNK}>")
    return one.select(key, "section", F.when(F.col("_fits"), native).otherwise(F.col("_c.chunks")).alias("chunks"), "_c.error_code")


def number_chunks(chunked: DataFrame, key: str = "doc_key") -> DataFrame:
    """key, chunk_index (from 0 over the document) and the chunk's columns; a document with an error has none."""
    bad = F.max(F.col("error_code").isNotNull().cast("int")).over(Window.partitionBy(key))
    rows = chunked.withColumn("_bad", bad).filter("_bad = 0").select(key, "section", F.posexplode("chunks").alias("_p", "c"))
    return rows.withColumn("chunk_index", F.row_number().over(Window.partitionBy(key).orderBy("section", "_p")) - 1).select(key, "chunk_index", "c.*")


def whole_sections(units: DataFrame) -> DataFrame:
    """Sections with the columns that each has as one chunk, and n_tokens: its words, path included."""
    text = F.array_join(F.transform("units", lambda x: x.text), "\n\n")
    kinds = F.array_distinct(F.transform("units", lambda x: F.when(x.kind == "code", "code").otherwise("text")))
    field = lambda pick, name: pick(F.transform("units", lambda x: x[name]))
    return units.withColumns({
        "text": text,
        "n_tokens": word_count(F.concat_ws("\n\n", F.col("heading_path"), text)),
        "content_type": F.when(F.size(kinds) == 1, kinds[0]).otherwise("mixed"),
        "content_role": F.col("units")[0].content_role,
        "source_line_start": field(F.array_min, "line_start"),
        "source_line_end": field(F.array_max, "line_end"),
        "page_start": field(F.array_min, "page_number"),
        "page_end": field(F.array_max, "page_number"),
    })


def fitting_sections(nodes: DataFrame, soft: int, key: str = "doc_key") -> DataFrame:
    """Sections of at most ``soft`` words, path included, each as one chunk: native all through (the plain word counter)."""
    from .structure import section_units

    return whole_sections(section_units(nodes, key)).filter(F.col("n_tokens") <= soft).drop("units")
