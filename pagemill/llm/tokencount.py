"""Edit-aware token counts.

A document's text is cut into pre-tokens, which BPE never merges across. Runs of ``leaf`` pre-tokens are the leaves of a segment
tree that holds their characters and tokens; inner nodes hold sums. An edit finds its leaf by descending the tree, and
encodes again from the leaf of the characters before it (boundary context: what pre-tokens there look ahead at) up to the first
pre-token that ends where an old leaf ended behind the edit; from there on pre-tokens are as before. The new counts go to
the touched leaves, and the sums on their paths follow; leaves that have grown to twice their size are split.

Defined results: a null text is empty: no tokens. Strings of special tokens are ordinary text. An edit (start, drop, add) counts in
code points of the text as the edits before it left it; places beyond the end mean the end, nulls mean 0 and "".
Every row gives a row; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe
from .common import map_rows

LEAF = 64


class Counter(dict):
    """pre-token -> tokens, remembered up to a bound."""

    BOUND = 500_000

    def __init__(self, tokenizer: str | None = None):
        self.coder = bpe(tokenizer)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.unusual = regex.compile("[^\u0000-ԯ]")

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        n = self[piece] = len(self.coder.fast.encode_ordinary(piece)) if len(piece) < 400 else len(self.coder.fast._encode_single_piece(piece.encode()))
        return n

    def cut(self, text: str) -> list[int]:
        """Where the pre-tokens of a text end. Beyond common letters the regex module knows other classes, so the tokenizer splits."""
        if self.unusual.search(text):
            return [e for _, (_, e) in self.coder.slow.pre_tokenizer.pre_tokenize_str(text)]
        return [m.end() for m in self.pattern.finditer(text)]

    def pieces(self, text: str, start: int = 0, window: int = 1 << 12) -> Iterator[tuple[int, str]]:
        """(end, pre-token) from a pre-token's start on, split a window at a time, so that an edit costs the same in texts of any length and script."""
        while start < len(text):
            ends = self.cut(text[start : start + window])
            if start + window < len(text):
                # the last may go on behind the window, and white space before it may end elsewhere then
                ends, wider = ends[:-2], window * 2
                if not ends:
                    window = wider
                    continue
            at = 0
            for e in ends:
                yield start + e, text[start + at : start + e]
                at = e
            start += at

    def all(self, text: str) -> list[str]:
        return self.pattern.findall(text) if not self.unusual.search(text) else [p for _, p in self.pieces(text, window=1 << 20)]


class Tree:
    """The segment tree of one text."""

    def __init__(self, text: str | None, counter: Counter, leaf: int = LEAF):
        self.text, self.counter, self.leaf = text or "", counter, leaf
        pieces = counter.all(self.text)
        self.n_pieces = self.encoded = len(pieces)
        at = np.arange(0, len(pieces), leaf)
        lens, toks = (np.fromiter(map(f, pieces), np.int64, len(pieces)) for f in (len, counter.__getitem__))
        self.build(*((np.add.reduceat(x, at) if pieces else x) for x in (lens, toks)))

    def build(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        """The sums over the leaves' characters and tokens."""
        self.leaves = len(chars)
        self.size = 1 << max(0, self.leaves - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        for sums, values in ((self.chars, chars), (self.tokens, tokens)):
            sums[self.size : self.size + self.leaves] = values
            for level in range(self.size.bit_length() - 2, -1, -1):
                lo = 1 << level
                sums[lo : 2 * lo] = sums[2 * lo : 4 * lo : 2] + sums[2 * lo + 1 : 4 * lo : 2]

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and where that leaf starts."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if char >= before + self.chars[node]:
                before += int(self.chars[node])
                node += 1
        return node - self.size, before

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        dc, dt = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += dc
            self.tokens[node] += dt
            node //= 2

    def edit(self, start: int | None, drop: int | None, add: str | None) -> None:
        n, add = len(self.text), add or ""
        start = min(max(start or 0, 0), n)
        stop = min(n, start + max(drop or 0, 0))
        if start == stop and not add:
            return
        fresh = self.text[:start] + add + self.text[stop:]
        if not self.leaves:
            self.__init__(fresh, self.counter, self.leaf)
            return
        # a pre-token looks past its end: two characters for a contraction, else over the white space that follows
        before = max(0, start - 3)
        while before and self.text[before].isspace():
            before -= 1
        first, begin = self.find(min(before, n - 1))
        last, end = first, begin + int(self.chars[first + self.size])
        while end < stop and last + 1 < self.leaves:
            last += 1
            end += int(self.chars[last + self.size])
        shift, lens, toks = len(fresh) - n, [], []
        at = begin
        for to, piece in self.counter.pieces(fresh, begin):
            lens.append(to - at), toks.append(self.counter[piece])
            at = to
            while end + shift < at and last + 1 < self.leaves:
                last += 1
                end += int(self.chars[last + self.size])
            if at >= start + len(add) and at == end + shift and end >= stop:
                break
        self.encoded += len(lens)
        self.text, had = fresh, last - first + 1
        slots = had if len(lens) <= 2 * self.leaf * had else -(-len(lens) // self.leaf)  # leaves that grew too full are split
        cut = [len(lens) * i // slots for i in range(slots + 1)]
        sums = [[sum(x[a:b]) for a, b in zip(cut, cut[1:])] for x in (lens, toks)]
        if slots == had:
            for i in range(slots):
                self.put(first + i, sums[0][i], sums[1][i])
        else:
            old = (x[self.size : self.size + self.leaves] for x in (self.chars, self.tokens))
            self.build(*(np.concatenate([x[:first], y, x[last + 1 :]]) for x, y in zip(old, sums)))


def count_tokens(documents: DataFrame, leaf: int = LEAF, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_pieces, n_leaves; with a column ``edits`` (array of start, drop, add) also n_edits, n_tokens_edited,
    n_reencoded (pre-tokens encoded for the edits) and edited_text."""
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    edits = F.col("edits") if "edits" in documents.columns else F.array()
    columns.append(edits.cast("array<struct<start: bigint, drop: bigint, add: string>>").alias("edits"))

    def make():
        counter = Counter(tokenizer)

        def f(b: pa.RecordBatch):
            out: list[list] = [[] for _ in range(7)]
            for t, edits in zip(b["text"].to_pylist(), b["edits"].to_pylist()):
                tree = Tree(t, counter, leaf)
                row = [tree.total, tree.n_pieces, tree.leaves]
                edits = [e for e in edits or () if e is not None]
                for e in edits:
                    tree.edit(e["start"], e["drop"], e["add"])
                for c, v in zip(out, (*row, len(edits), tree.total, tree.encoded - row[1], tree.text)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, pa.int64()) for c in out[:6]), pa.array(out[6], pa.string())], ["doc_id", "n_tokens", "n_pieces", "n_leaves", "n_edits", "n_tokens_edited", "n_reencoded", "edited_text"])

        return f

    return map_rows(documents.select(*columns), make, "doc_id long, n_tokens long, n_pieces long, n_leaves long, n_edits long, n_tokens_edited long, n_reencoded long, edited_text string")


def sample_edits(doc_id: str = "doc_id", text: str = "text"):
    """Three edits of every document, from a hash of its id: a word put in, some characters replaced, some dropped."""
    size = F.coalesce(F.length(text), F.lit(0)).cast("long") + 1
    at = lambda i: F.pmod(F.xxhash64(F.col(doc_id), F.lit(i)), size)
    one = lambda i, drop, add: F.struct(at(i).alias("start"), F.lit(drop).cast("long").alias("drop"), F.lit(add).alias("add"))
    return F.array(one(1, 0, " revised"), one(2, 7, "new words"), one(3, 12, ""))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("edits", sample_edits())
    counted = count_tokens(documents)
    return counted.select("doc_id", "n_tokens", "n_pieces", "n_leaves", "n_edits", "n_tokens_edited", "n_reencoded", F.crc32(F.col("edited_text").cast("binary")).alias("edited_crc32"))


def apply_edits(text: str | None, edits) -> str:
    """Plain text editing, for tests."""
    t = text or ""
    for e in edits or ():
        if e is not None:
            s = min(max(e["start"] or 0, 0), len(t))
            t = t[:s] + (e["add"] or "") + t[min(len(t), s + max(e["drop"] or 0, 0)) :]
    return t


def text_crc(text: str) -> int:
    return zlib.crc32(text.encode())
