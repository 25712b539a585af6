"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: case, accents, letters that look like Latin ones, and digits or signs that stand for letters inside a
word. The lexicon holds whole words and word beginnings, learned with their weights (log odds) from labelled documents; phrases
of a match and a neighbouring word that are no sign of toxicity are exceptions, and a match inside one doesn't count.
The score is a logistic function of the matched weight, also relative to the text's length.

Learning reads at most ``train_rows`` labelled documents (the least by a hash of doc_id) outside the held-out third; scoring
covers every whole text. Lexicon and exceptions are bounded, so what is broadcast doesn't grow with the data.

Defined results: null and empty texts are scored like texts without a match. If several label rows name a document, it is
toxic if any says so; null labels are none. Without usable labels every score is 0. Every row of documents gives a row.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_id, cut, map_rows, pick

TRAIN_ROWS, MOST_TERMS, THRESHOLD = 20_000, 3000, 0.7
LEAST = 3  #: toxic training documents that a term must be in, however many there are
#: Letters that look like Latin ones.
LOOKALIKES = dict(zip("авсеніјкмопрѕтухԁɡӏ", "abcehijkmonpstyxdgl")) | dict(zip("αβεικνορτυχ", "abeiknoptyx"))
#: Signs that stand for letters inside a word.
SIGNS = dict(zip("013457@$!|", "oieastasii"))
_inside = re.compile(r"(?<=[a-z])[013457@$!|]+(?=[a-z])|(?<![^ ])[013457@$](?=[a-z])")


class Folding(dict):
    """Code point -> folded letters, a sign of SIGNS, or a space."""

    def __missing__(self, c: int) -> str:
        out = ""
        for x in unicodedata.normalize("NFKD", chr(c).lower()):
            x = LOOKALIKES.get(x, x)
            if x in SIGNS or x.isalpha():
                out += x
            elif not unicodedata.combining(x):
                out += " "
        self[c] = out
        return out


_folding = Folding()


def fold(text: str | None) -> str:
    """The folded text: words of letters between single or several spaces, one before and one behind."""
    t = (text or "").translate(_folding)
    t = _inside.sub(lambda m: "".join(SIGNS[c] for c in m[0]), f" {t} ")
    return re.sub("[0-9@$!|]", " ", t)


class Model(NamedTuple):
    terms: dict[str, float]  #: " word " or " beginning" -> weight
    exceptions: frozenset[str]  #: "word word"
    bias: float
    slopes: tuple[float, float, float]


class Matcher:
    def __init__(self, model: Model):
        self.model, self.trie = model, ahocorasick.Automaton()
        for t, w in model.terms.items():
            self.trie.add_word(t, (len(t), w))
        if model.terms:
            self.trie.make_automaton()

    def matches(self, folded: str):
        """(start of the word, weight) of each match."""
        if self.model.terms:
            for end, (n, w) in self.trie.iter(folded):
                yield end - n + 2, w

    @staticmethod
    def phrases(folded: str, at: int) -> tuple[str, str]:
        """The word at a place with the word before and with the word behind."""
        end = folded.index(" ", at)
        before = folded[max(0, at - 40) : at].split()[-1:]
        behind = folded[end : end + 40].split()[:1]
        return " ".join([*before, folded[at:end]]), " ".join([folded[at:end], *behind])

    def features(self, text: str | None) -> tuple[float, float, float]:
        f = fold(text)
        best: dict[int, float] = {}
        for at, w in self.matches(f):
            if w > best.get(at, 0) and not (self.model.exceptions and not self.model.exceptions.isdisjoint(self.phrases(f, at))):
                best[at] = w
        if not best:
            return 0.0, 0.0, 0.0
        total = sum(best.values())
        return max(best.values()), math.log1p(total), total / math.sqrt(1 + f.count(" "))

    def score(self, text: str | None) -> float:
        z = self.model.bias + sum(a * b for a, b in zip(self.model.slopes, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _beginnings(words: set[str]) -> set[str]:
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:n]}" for w in words for n in range(4, min(len(w), 9))}


def _counts(rows: DataFrame, found, schema: str = "term string, toxic int") -> DataFrame:
    """In how many documents of either label each of found(text)'s terms is, added up per task first."""

    def make():
        def f(b: pa.RecordBatch):
            got = Counter()
            for t, y in zip(b["text"].to_pylist(), b["toxic"].to_pylist()):
                got.update((x, y) for x in found(t))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.string()), pa.array([y for _, y in got], pa.int32()), pa.array(list(got.values()), pa.int64())], ["term", "toxic", "n"])

        return f

    part = map_rows(rows.select("text", "toxic"), make, "term string, toxic int, n long")
    return part.groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("neg"))


def learn(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, most_terms: int = MOST_TERMS) -> Model:
    own = pick(labels, doc_id="long", toxic="int").filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(F.pmod(crc_id("doc_id"), F.lit(3)) != 1)
    sample = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = cut(pick(documents, doc_id="long", text="string").join(F.broadcast(sample), "doc_id").select("text", "toxic"), "labelled")
    size = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_pos, n_neg = size.get(1, 0), size.get(0, 0)
    if not n_pos or not n_neg:
        return Model({}, frozenset(), -30.0, (0.0, 0.0, 0.0))
    # terms of enough toxic documents (a number bounded by their words), then in how many others these are
    common = _counts(rows.filter("toxic = 1"), lambda t: _beginnings(set(fold(t).split()))).filter(F.col("pos") >= LEAST).orderBy(F.desc("pos"), "term").limit(50 * most_terms)
    pos = {r.term: r.pos for r in common.collect()}
    known = frozenset(pos)
    neg = {r.term: r.neg for r in _counts(rows.filter("toxic = 0"), lambda t: known & _beginnings(set(fold(t).split()))).collect()}
    weight = {t: math.log((p + 0.5) / (n_pos + 1)) - math.log((neg.get(t, 0) + 0.5) / (n_neg + 1)) for t, p in pos.items()}
    good = sorted((t for t, w in weight.items() if w > 2.5), key=lambda t: (-weight[t] * math.sqrt(pos[t]), t))[:most_terms]
    model = Model({t: weight[t] for t in good}, frozenset(), 0.0, (1.0, 0.0, 0.0))

    def seen(t: str | None) -> set[str]:
        f = fold(t)
        return {p for at in {a for a, _ in matcher.get().matches(f)} for p in Matcher.phrases(f, at) if " " in p}

    matcher = _Lazy(model)
    odd = _counts(rows, seen).filter((F.col("neg") >= 2) & (F.col("neg") * n_pos > 2 * F.col("pos") * n_neg)).orderBy(F.desc("neg"), "term").limit(most_terms)
    model = model._replace(exceptions=frozenset(r.term for r in odd.collect()))

    lazy = _Lazy(model)

    def make():
        def f(b: pa.RecordBatch):
            x = [lazy.get().features(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["toxic"], *(pa.array([r[i] for r in x], pa.float64()) for i in range(3))], ["toxic", "a", "b", "c"])

        return f

    data = map_rows(rows.select("toxic", "text"), make, "toxic int, a double, b double, c double").toPandas()  # train_rows at most
    y, x = data["toxic"].to_numpy(float), np.column_stack([np.ones(len(data)), data[["a", "b", "c"]].to_numpy()])
    order = np.lexsort((x[:, 3], x[:, 2], x[:, 1], y))
    x, y, w = x[order], y[order], np.zeros(4)
    for _ in range(30):  # Newton steps of ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(4), x.T @ (y - p) - 1e-2 * w)
    # the cut of best F1 on the training rows becomes the threshold
    z = x @ w
    zs = np.unique(z)
    cuts = np.concatenate([[zs[0] - 1], (zs[1:] + zs[:-1]) / 2])
    if len(cuts) > 2000:
        cuts = np.quantile(cuts, np.linspace(0, 1, 2000))
    tp = np.array([y[z > c].sum() for c in cuts])
    f1 = 2 * tp / (np.array([(z > c).sum() for c in cuts]) + y.sum())
    shift = math.log(THRESHOLD / (1 - THRESHOLD)) - cuts[int(f1.argmax())]
    return model._replace(bias=float(w[0] + shift), slopes=tuple(float(v) for v in w[1:]))


class _Lazy:
    """A matcher that is built where it is used; only the model travels."""

    def __init__(self, model: Model):
        self.model, self.made = model, None

    def __reduce__(self):
        return _Lazy, (self.model,)

    def get(self) -> Matcher:
        if self.made is None:
            self.made = Matcher(self.model)
        return self.made


def score_toxicity(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every row."""
    lazy = _Lazy(model)

    def make():
        def f(b: pa.RecordBatch):
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([lazy.get().score(t) for t in b["text"].to_pylist()], pa.float64())], ["doc_id", "score"])

        return f

    return map_rows(pick(documents, doc_id="long", text="string"), make, "doc_id long, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(F.pmod(crc_id("doc_id"), F.lit(3)) == 1, F.lit(False))
    return score_toxicity(documents, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
