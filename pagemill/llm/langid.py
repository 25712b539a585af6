"""Language identification by a linear-chain conditional random field over words.

A word's features are its byte n-grams, those at its ends marked as affixes, and the word itself (the lexicon), hashed
into one table of weights per language. Transitions between the languages of neighbouring words are learned with the weights, from
windows of labelled documents strung together so that languages switch. Forward-backward gives each word's
probabilities; a document's are their mean. The chain runs over a whole batch at once: blocks of words advance
in lockstep by their transfer matrices, and a document's first word forgets what came before.

Learning reads at most ``per_language`` documents (about, by a hash of doc_id) of each language outside the held-out third,
``WINDOWS`` windows of each; prediction covers every word of every text. The model's size is fixed.

Defined results: null texts and texts without a letter are ``und`` with score 0. Null languages teach nothing; if no language is known, every text
is ``und``. Every row gives a row, repeated ones too; extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_id, map_rows, map_texts, pick

PER_LANGUAGE, WINDOWS, WORDS = 500, 4, 8
BITS = 16
PART = 200_000  #: characters that are labelled at a time, or one text
NONE = 1 << BITS  #: the row of features that a place doesn't have; its weights stay 0
LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  #: (2**BITS + 1, languages)
    moves: np.ndarray  #: log potentials of neighbouring languages


def normal(text: str | None) -> bytes:
    """Lower-case words of letters, between single spaces."""
    return b" ".join((text or "").lower().encode().translate(LETTERS).split())


def features(words: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words between single spaces: n-gram features of each place, features of whole words, first place of each word."""
    a = np.frombuffer(b" " + words + b" ", dtype=np.uint8)
    space = a == 32
    at = np.arange(len(a))
    last = np.maximum.accumulate(np.where(space, at, 0))
    # letters since the space before; at a space, of the word that it ends, itself counted
    since = at - np.concatenate([[0], last[:-1]])
    code = np.zeros(len(a), dtype=np.uint32)
    grams = np.full((len(a), 3), NONE, dtype=np.int32)
    x = a.astype(np.uint32)
    for n in range(1, 5):
        code[n - 1 :] |= x[: len(a) - n + 1] << np.uint32(8 * (n - 1))
        if n > 1:
            h = (code * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - BITS)
            grams[:, n - 2] = np.where(since + 1 >= n, h, NONE)
    starts = np.flatnonzero(space)[:-1] + 1
    powers = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, dtype=np.uint64))
    whole = np.add.reduceat(a.astype(np.uint64) * powers[np.minimum(since, 63)], starts)
    return grams, (whole >> np.uint64(64 - BITS)).astype(np.int32), starts


def emissions(words: bytes, weights: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """Scores (words, languages), made in parts of bounded size."""
    out, at = [], 0
    while at < len(words):
        to = len(words) if len(words) - at <= most else words.find(b" ", at + most)
        to = len(words) if to < 0 else to
        grams, whole, starts = features(words[at:to])
        e = weights[grams[:, 0]]
        e += weights[grams[:, 1]]
        e += weights[grams[:, 2]]
        out.append(np.add.reduceat(e, starts, axis=0) + weights[whole])
        at = to + 1
    return np.concatenate(out)


def marginals(scores: np.ndarray, first: np.ndarray, moves: np.ndarray, block: int = 64) -> np.ndarray:
    """Probabilities of each word's language; ``first`` marks words that begin a text."""
    p = np.multiply(*chains(scores, first, moves, block))
    return p / p.sum(axis=1, keepdims=True)


def chains(scores: np.ndarray, first: np.ndarray, moves: np.ndarray, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward values of each word, each up to a factor."""
    n, k = scores.shape
    nb = -(-n // block)
    e = np.ones((nb * block, k))
    e[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
    reset = np.ones(nb * block, dtype=bool)
    reset[:n] = first
    e, reset, t, start = e.reshape(nb, block, k), reset.reshape(nb, block), np.exp(moves - moves.max()), np.full(k, 1 / k)
    through = np.tile(np.eye(k), (nb, 1, 1))
    for s in range(block):
        mass, over = through.sum(axis=2, keepdims=True), reset[:, s]
        through = through @ t
        through[over] = mass[over] * start
        through *= e[:, s, None, :]
        through /= through.max(axis=(1, 2), keepdims=True)
    into, out = np.empty((nb, k)), np.empty((nb, k))
    a = start
    for b in range(nb):
        into[b] = a
        a = a @ through[b]
        a = a / a.sum()
    z = np.ones(k)
    for b in range(nb - 1, -1, -1):
        out[b] = z
        z = through[b] @ z
        z = z / z.sum()
    alpha, beta, a = np.empty((nb, block, k)), np.empty((nb, block, k)), into
    for s in range(block):
        a = np.where(reset[:, s, None], start, a @ t) * e[:, s]
        a /= a.sum(axis=1, keepdims=True)
        alpha[:, s] = a
    z = out
    for s in range(block - 1, -1, -1):
        beta[:, s] = z
        z = np.where(reset[:, s, None], 1.0, (z * e[:, s]) @ t.T)
        z /= z.sum(axis=1, keepdims=True)
    return alpha.reshape(-1, k)[:n], beta.reshape(-1, k)[:n]


def fit(windows: list[tuple[bytes, int]], languages: list[str], rounds: int = 25, rate: float = 0.4, decay: float = 1e-4) -> Model:
    """Maximum likelihood by adaptive gradient steps. windows: words between spaces, with the language's number."""
    k = len(languages)
    order = np.random.Generator(np.random.PCG64(5)).permutation(len(windows))
    windows = [windows[i] for i in order]
    y = np.concatenate([np.full(w.count(b" ") + 1, l) for w, l in windows])
    grams, whole, starts = features(b" ".join(w for w, _ in windows))
    lens = np.diff(np.append(starts, len(grams)))
    grams = grams[starts[0] :]
    # three windows make a text, so that languages switch inside
    first = np.zeros(len(y), dtype=bool)
    sizes = np.cumsum([0] + [w.count(b" ") + 1 for w, _ in windows[:-1]])
    first[sizes[::3]] = True
    weights, moves = np.zeros((NONE + 1, k)), np.zeros((k, k))
    gw, gm = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    hot, inner = np.eye(k)[y], ~first[1:]
    seen = np.zeros((k, k))
    np.add.at(seen, (y[:-1][inner], y[1:][inner]), 1)
    for _ in range(rounds):
        s = np.add.reduceat(weights[grams].sum(axis=1), np.concatenate([[0], np.cumsum(lens)[:-1]]), axis=0) + weights[whole]
        alpha, beta = chains(s, first, moves)
        p = alpha * beta
        g = p / p.sum(axis=1, keepdims=True) - hot
        at = np.repeat(g, lens, axis=0)
        grad = np.stack([sum(np.bincount(grams[:, j], weights=at[:, c], minlength=NONE + 1) for j in range(3)) + np.bincount(whole, weights=g[:, c], minlength=NONE + 1) for c in range(k)], axis=1) + decay * weights * len(y) / 100
        grad[NONE] = 0
        gw += grad**2
        weights -= rate * grad / np.sqrt(gw)
        # expected moves: how likely each pair of neighbours is under the chain
        pair = alpha[:-1, :, None] * np.exp(moves)[None] * (np.exp(s[1:] - s[1:].max(axis=1, keepdims=True)) * beta[1:])[:, None, :]
        pair = (pair / pair.sum(axis=(1, 2), keepdims=True))[inner].sum(axis=0)
        grad = pair - seen + decay * moves
        gm += grad**2
        moves -= rate * 0.5 * grad / np.sqrt(gm)
    return Model(languages, weights.astype(np.float32), moves)


def learn(documents: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    rows = pick(documents, doc_id="long", text="string", lang="string").filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").filter(F.pmod(crc_id("doc_id"), F.lit(3)) != 1)
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    # about per_language documents of each: those whose hash falls below a share of all hashes
    share = F.create_map(*[x for l in languages for x in (F.lit(l), F.lit(min(1.0, per_language / counts[l])))])
    few = rows.filter((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)) < share[F.col("lang")])

    def make():
        def f(b: pa.RecordBatch):
            lang, out = [], []
            for i, t, l in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["lang"].to_pylist()):
                ws = normal(t).split()
                for w in range(WINDOWS if ws else 0):
                    at = xxhash.xxh3_64_intdigest(f"{i} {w}") % max(1, len(ws) - WORDS + 1)
                    lang.append(l), out.append(b" ".join(x[:40] for x in ws[at : at + WORDS]))
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(out, pa.binary())], ["lang", "words"])

        return f

    got = map_rows(few, make, "lang string, words binary").collect()  # bounded: per_language * WINDOWS windows of short words
    windows = sorted((bytes(r.words), languages.index(r.lang)) for r in got)
    return fit(windows, languages) if windows else None


def predict(texts: list[str | None], model: Model | None) -> tuple[list[str], list[float], list[list[float]]]:
    """Language, score and all languages' probabilities of each text."""
    if model is None:
        return [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    words = [normal(t) for t in texts]
    words = [w if w and any(c.isalpha() for c in (t if not w[:1].isascii() or not w.isascii() else "a")) else b"" for w, t in zip(words, texts)]
    some = [i for i, w in enumerate(words) if w]
    lang, score, probs = [UNKNOWN] * len(texts), [0.0] * len(texts), [[0.0] * len(model.languages) for _ in texts]
    if some:
        sizes = np.array([words[i].count(b" ") + 1 for i in some])
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        first = np.zeros(sizes.sum(), dtype=bool)
        first[begin] = True
        p = np.add.reduceat(marginals(emissions(b" ".join(words[i] for i in some), model.weights), first, model.moves), begin, axis=0) / sizes[:, None]
        for i, row in zip(some, p):
            c = int(row.argmax())
            lang[i], score[i], probs[i] = model.languages[c], float(min(1.0, row[c])), row.tolist()
    return lang, score, probs


def label_words(text: str | None, model: Model) -> list[tuple[str, str]]:
    """(word, language) of each word of a text that may switch languages."""
    w = normal(text)
    if not w:
        return []
    n = w.count(b" ") + 1
    p = marginals(emissions(w, model.weights), np.arange(n) == 0, model.moves)
    return [(x.decode(), model.languages[c]) for x, c in zip(w.split(), p.argmax(axis=1))]


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """All rows and columns, with lang_pred and score; columns of these names go."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        def f(texts: list[str | None]) -> pa.Array:
            at, langs, scores = 0, [], []
            while at < len(texts):  # parts of bounded size, as the scores take a hundred times the texts
                to, size = at, 0
                while to < len(texts) and size < PART:
                    size += len(texts[to] or "")
                    to += 1
                l, s, _ = predict(texts[at:to], held.value)
                langs += l
                scores += s
                at = to
            return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

        return f

    source = documents.drop("lang_pred", "score")
    found = map_texts(source, "_found", make, "struct<lang_pred: string, score: double>")
    return found.select(*(F.col(f"`{c}`") for c in source.columns), "_found.lang_pred", "_found.score")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(pick(documents, doc_id="long", text="string"), learn(documents))
    return found.select("doc_id", F.coalesce(F.pmod(crc_id("doc_id"), F.lit(3)) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
