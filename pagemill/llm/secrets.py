"""Secret scans with one combined automaton.

All rules, read backwards, are compiled into a single minimal automaton. It passes over a text's bytes once, from the end,
and its accepting states tell at each byte which rules match from there on. Texts without any are done; for the others each
rule's own automaton finds, from the leftmost start on, the longest match, then goes on behind it. A private key goes on to its last line.

Defined results: a null text is empty, without spans (``drop_secrets`` leaves it null). Every row of the input gives a row, repeated ones
and those of null or repeated ids too. ``scan_secrets`` ignores other columns, ``drop_secrets`` passes them through, whatever their names.
An empty table gives an empty one. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import getitem
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import Dfa, compile_dfa, linked, parse, reverse
from .common import map_rows, pick


class Rule(NamedTuple):
    kind: str
    head: str  #: what stands before the value
    tail: str  #: one byte of the value's class; the value is the longest run of it
    least: int  #: bytes of the value for a match to count
    strict: bool = False  #: shorter runs are no matches at all (else they are consumed, then dropped)
    rest: str = ""  #: what the match goes on with, if that is there


_ANY = r"([\x00-\x2C\x2E-\xFF]|-[\x00-\x2C\x2E-\xFF])*"  # no two hyphens in a row
_LINE = r"((\\n|\\r|[\x09-\x0D\x20])+[A-Za-z0-9+/=]{40}[A-Za-z0-9+/=]*)"
#: A key's body up to its last line; where that is missing, the long lines that follow.
_KEY = rf"({_ANY}-----END [A-Z ]*PRIVATE KEY( BLOCK)?-----|{_LINE}*)"

#: The first three are the base kinds, in the order in which spans of one start are listed.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 6),
    Rule("access", "AKIA", "[A-Z0-9]", 16, True),
    Rule("hex", "", "[0-9a-f]", 24, True),
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 20, True),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY( BLOCK)?", "-", 5, True, _KEY),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        fold = lambda r: "(?i)" if r.head.startswith("(?i)") else ""
        shortest = [("cat", [parse(r.head), parse(f"{fold(r)}{r.tail}{{{r.least if r.strict else 1}}}")]) for r in rules]
        self.backward: Dfa = compile_dfa([reverse(t) for t in shortest], search=True)
        self.forward = [compile_dfa([("cat", [parse(r.head), ("plus", parse(fold(r) + r.tail)), parse(r.rest)])], search=False) for r in rules]
        self.heads = [compile_dfa([parse(r.head)], search=False) for r in rules]
        self.ready = False

    def __getstate__(self):
        return self.__dict__ | {"ready": False, "screen": None, "mark": None, "ends": None, "values": None}

    def prepare(self) -> Scanner:
        """Transition arrays in the form that steps fastest here; made once a task, as they hold themselves."""
        if not self.ready:
            self.screen = linked(self.backward, sink=True)
            self.mark = linked(self.backward)
            self.ends = [linked(d) for d in self.forward]
            self.values = [linked(d) for d in self.heads]
            self.ready = True
        return self

    @staticmethod
    def longest(automaton, data: bytes, at: int) -> int:
        """Where the longest match from ``at`` on ends; ``at`` - 1 if there is none."""
        rows, accepts, dead = automaton
        row, end = rows[0], at if id(rows[0]) in accepts else at - 1
        for i in range(at, len(data)):
            row = row[data[i]]
            if row is dead:
                break
            if id(row) in accepts:
                end = i + 1
        return end

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end), sorted by start, then kind."""
        data = (text or "").encode()
        rows, accepts, _ = self.screen
        if id(reduce(getitem, data[::-1], rows[0])) not in accepts:
            return []
        rows, accepts, _ = self.mark
        starts: list[list[int]] = [[] for _ in self.rules]
        row, i = rows[0], len(data)
        for b in reversed(data):
            i -= 1
            row = row[b]
            if id(row) in accepts:
                for r in accepts[id(row)]:
                    starts[r].append(i)
        found = []
        for r, rule in enumerate(self.rules):
            done = 0
            for at in reversed(starts[r]):
                if at < done:
                    continue
                done = self.longest(self.ends[r], data, at)
                if done - self.longest(self.values[r], data, at) >= rule.least:
                    found.append((at, r, done))
        found.sort()
        if data.isascii():
            return [(self.rules[r].kind, a, e) for a, r, e in found]
        points, at, n = {}, 0, 0  # code points before each place, by one running count
        for place in sorted({x for a, _, e in found for x in (a, e)}):
            n += len(data[at:place].decode(errors="ignore"))
            at, points[place] = place, n
        return [(self.rules[r].kind, points[a], points[e]) for a, r, e in found]


def scan_secrets(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans (array of kind, start, end)."""
    scanner = Scanner(rules)

    def make():
        s = scanner.prepare()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

        def f(b: pa.RecordBatch):
            spans = [[dict(zip(("kind", "start", "end"), x)) for x in s.spans(t)] for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(spans, kind)], ["doc_id", "spans"])

        return f

    return map_rows(pick(documents, doc_id="long", text="string"), make, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def report(found: DataFrame) -> DataFrame:
    base = ("assign", "access", "hex")
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")

    def of(kind: str):
        return F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long")

    return found.select(
        "doc_id",
        *(of(k).alias(f"n_{k}") for k in base),
        F.sha2(line(F.filter("spans", lambda x: x.kind.isin(*base))).cast("binary"), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def drop_secrets(documents: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """The documents with the union of all spans replaced by ``mark`` in their text; n_chars, where there is one, follows."""
    scanner = Scanner(rules)

    def make():
        s = scanner.prepare()

        def clean(t: str | None) -> str | None:
            out, done = [], 0
            for _, a, e in s.spans(t):
                if e <= done:
                    continue
                if a >= done:
                    out += [t[done:a], mark]
                done = e
            return t if not out else "".join(out) + t[done:]

        def f(b: pa.RecordBatch):
            at = b.schema.get_field_index("text")
            yield b.set_column(at, "text", pa.array([clean(t) for t in b["text"].to_pylist()], pa.string()))

        return f

    out = map_rows(documents.withColumn("text", F.col("text").cast("string")), make, documents.withColumn("text", F.col("text").cast("string")).schema)
    return out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else out


def brute(text: str | None) -> list[tuple[str, int, int]]:
    """The base kinds by Python's re, for tests."""
    import re

    t, out = text or "", []
    for k, (kind, p, least) in enumerate((("assign", r"""(?ia)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", r"(AKIA[A-Z0-9]+)", 20), ("hex", r"([0-9a-f]+)", 24))):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(p, t) if len(m[1]) >= least]
    return [(kind, a, e) for a, _, e, kind in sorted(out)]
