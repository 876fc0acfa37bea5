"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic
function of the character grams of its words; the document's is their
noisy-or, 1 - prod(1 - p). The weights are trained on document labels alone,
by proximal gradient steps on the noisy-or likelihood, from a bounded sample
of labelled rows. Scoring is one pass over all whole texts without a
shuffle; the sentence probabilities then locate the offending sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append, col, field, prepare, release, stage, utf8
from .language_id import remainder

TRAIN_ROWS, TRAIN_BYTES, LEAST_DOCS, LEAST_ODDS, MAX_GRAMS = 3000, 256 << 20, 4, 2.0, 50_000
ROUNDS, RATE, RIDGE, LASSO, START, NOISE = 400, 0.05, 1e-4, 2e-3, -4.0, 0.01
GRAMS, WORDS_HELD, PIECE = (4, 5), 200_000, 1 << 22
_TABLE = bytes(0x2E if c in b".!?\n" else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_SENTENCE = re.compile(rb"[^.!?\n]+")


def tokens(text: bytes) -> list[bytes]:
    """Lower-case words (A-Z), with b"." wherever a sentence ends."""
    return text.translate(_TABLE).replace(b".", b" . ").split()


def grams(word: bytes) -> set[bytes]:
    """The word and its character grams, with marks for its ends."""
    marked = "^" + word.decode("utf-8", "replace") + "$"
    out = {marked[i:i + n] for n in GRAMS for i in range(len(marked) - n + 1)}
    out.add(marked)
    return {x.encode() for x in out}


class WordScores(dict):
    """Sum of the gram weights of each word met; nan for a sentence end."""

    def __init__(self, weights: dict[bytes, float]):
        super().__init__({b".": np.nan})
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        get = self.weights.get
        got = sum(get(g, 0.0) for g in grams(word))
        if len(self) >= WORDS_HELD:
            self.clear()
            self[b"."] = np.nan
        if len(word) <= 64:
            self[word] = got
        return got


class Model:
    """Gram weights and bias. A sentence without a learned gram has
    probability 0, so a long harmless text doesn't add up to a toxic one."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.bias, self.scores = bias, WordScores(weights)

    def sentences(self, text: bytes) -> np.ndarray:
        """Probability of each sentence that has words, in order."""
        parts, at = [], 0
        while at < len(text):  # a piece ends where a sentence does, if one does
            end = min(len(text), at + PIECE)
            while end < len(text) and text[end - 1] not in b".!?\n":
                end += 1
            toks = tokens(text[at:end])
            parts.append(np.fromiter(map(self.scores.__getitem__, toks), float, len(toks)))
            at = end
        s = np.concatenate(parts) if parts else np.empty(0)
        end = np.isnan(s)
        words = np.flatnonzero(~end)
        if not len(words):
            return np.empty(0)
        number = np.cumsum(end)[words]
        first = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1])
        z = np.add.reduceat(s[words], first)
        known = np.add.reduceat(np.abs(s[words]), first) > 0
        return np.where(known, 1 / (1 + np.exp(-np.clip(z + self.bias, -40, 40))), 0.0)

    def document(self, p: np.ndarray) -> float:
        """Noisy-or of the sentences' probabilities."""
        return abs(float(np.expm1(np.log1p(-np.minimum(p, 1 - 1e-15)).sum()))) if len(p) else 0.0


def spans(text: bytes, p: np.ndarray, least: float) -> list[dict]:
    """Code-point spans of the sentences of probability ``least`` or more."""
    out, k = [], 0
    for m in _SENTENCE.finditer(text):
        if m[0].translate(_TABLE).split():
            if p[k] >= least:
                start = len(text[:m.start()].decode("utf-8", "replace"))
                out.append({"start": start, "end": start + len(m[0].decode("utf-8", "replace")), "p": float(p[k])})
            k += 1
    return out


def train(docs: DataFrame, labels: DataFrame, eligible: Column, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
          rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    """A model from about ``rows`` labelled documents of each label, fewer if
    those would be more than ``most_bytes`` in all (chosen by a hash of the id
    among the eligible ones, whatever their length; whole texts, each
    different text once). Grams count that are in LEAST_DOCS toxic texts
    of the sample or more, at log odds of LEAST_ODDS or more, at most MAX_GRAMS
    of them; the fit prunes them. Ids with several labels count as toxic if any says so; null labels
    don't count. Without both labels, the model finds nothing toxic."""
    prepare(docs.sparkSession)
    marks = labels.filter(col(label).isNotNull() & col(doc_id).isNotNull()).groupBy(col(doc_id).alias("__id")).agg(F.max((col(label) > 0).cast("int")).alias("y"))
    pool = docs.filter(eligible & col(text).isNotNull()).select(col(doc_id).alias("__id"), utf8(text).alias("t"))
    sized = pool.groupBy("__id").agg(F.sum(F.octet_length("t")).alias("size"))
    marks = stage(marks.join(sized, "__id"), "toxic-labels")
    sizes = {r.y: (r["count"], r["size"] or 1) for r in marks.groupBy("y").agg(F.count("*").alias("count"), F.sum("size").alias("size")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        release(marks)
        return Model({}, START)
    share = F.create_map(*[F.lit(x) for y, (n, size) in sizes.items() for x in (y, min(1.0, rows / n, most_bytes / size))])
    wanted = marks.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < F.element_at(share, F.col("y")) * (1 << 30))
    sample = pool.join(F.broadcast(wanted.select("__id", "y")), "__id").groupBy(F.md5("t").alias("h")).agg(F.first("t").alias("t"), F.max("y").alias("y"))
    sample = stage(sample.select("t", "y"), "toxic-sample")
    release(marks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            df = gram_counts(b.column(0).to_pylist(), b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.binary()), pa.array([x[0] for x in df.values()], pa.int64()), pa.array([x[1] for x in df.values()], pa.int64())], names=["g", "clean", "toxic"])

    n = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    odds = F.log((F.col("toxic") + 0.5) / (n.get(1, 0) + 1)) - F.log((F.col("clean") + 0.5) / (n.get(0, 0) + 1))
    chosen = (sample.mapInArrow(count, "g binary, clean long, toxic long").groupBy("g").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
              .filter((F.col("toxic") >= LEAST_DOCS) & (odds >= LEAST_ODDS)).orderBy(F.desc(F.col("toxic") * odds), "g").limit(MAX_GRAMS).collect())
    number = {bytes(r.g): i for i, r in enumerate(chosen)}

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [sentence_grams(t, number) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([[len(x) for x in g] for g in bags], pa.list_(pa.int32())), pa.array([[i for x in g for i in x] for g in bags], pa.list_(pa.int32()))], names=["y", "sizes", "ids"])

    bags = sample.mapInArrow(bag, "y int, sizes array<int>, ids array<int>").toPandas()
    out = fit(list(number), bags["y"].to_numpy(float), list(bags["sizes"]), list(bags["ids"]))
    release(sample)
    return out


def gram_counts(texts: list[bytes], y: list[int]) -> dict[bytes, list[int]]:
    """Number of texts of each label (0, 1) that hold a gram."""
    df: dict[bytes, list[int]] = {}
    for t, label in zip(texts, y, strict=True):
        own: set[bytes] = set()
        for w in set(tokens(t)) - {b"."}:
            own |= grams(w)
        for g in own:
            df.setdefault(g, [0, 0])[label] += 1
    return df


def sentence_grams(text: bytes, number: dict[bytes, int]) -> list[list[int]]:
    """Numbers of the chosen grams in each sentence that has any."""
    out: list[list[int]] = [[]]
    for w in tokens(text):
        if w == b".":
            out.append([])
        else:
            out[-1] += [number[g] for g in grams(w) if g in number]
    return [x for x in out if x]


def fit(names: list[bytes], y: np.ndarray, sizes: list, ids: list) -> Model:
    """Noisy-or likelihood of the labels (with a little label noise) by Adam
    steps with a soft threshold, which leaves few grams with a weight.
    sizes, ids: per document, its sentences' numbers of grams, and the grams."""
    lengths = np.concatenate([np.asarray(x, np.int64) for x in sizes]) if len(sizes) else np.empty(0, np.int64)
    if not len(lengths) or not 0 < y.sum() < len(y):
        return Model({}, START)
    doc_ = np.repeat(np.arange(len(y)), [len(x) for x in sizes])
    row_, f_ = np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.asarray(x, np.int64) for x in ids])
    w, b = np.full(len(names), 0.1), START
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    weight = np.where(y > 0, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))
    for step in range(1, ROUNDS + 1):
        z = np.clip(np.bincount(row_, w[f_], len(lengths)) + b, -40, 40)
        s = 1 / (1 + np.exp(-z))
        q = np.bincount(doc_, -np.logaddexp(0, z), len(y))
        p = NOISE + (1 - 2 * NOISE) * -np.expm1(q)
        dq = np.where(y > 0, 1 / p, -1 / (1 - p)) * (1 - 2 * NOISE) * np.exp(q) * weight / len(y)
        dz = -dq[doc_] * s
        grad = np.append(np.bincount(f_, dz[row_], len(w)) + RIDGE * w, dz.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - LASSO, 0)
    return Model({g: float(x) for g, x in zip(names, w, strict=True) if x}, float(b))


def score(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with score (0 to 1), predicted (1 from 0.5 on) and offending
    (code-point spans of the sentences of probability ``least`` or more) of
    each whole text, of any length. Null texts and texts without words score
    0; so does every text if the model learned nothing. Each row by itself,
    also one that repeats; an empty table gives an empty result."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model.scores.weights, model.bias))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def factory():
        m = Model(*held.value)

        def f(ts):
            scores, found = [], []
            for t in ts.to_pylist():
                p = m.sentences(t)
                scores.append(m.document(p))
                found.append(spans(t, p, least) if len(p) and p.max() >= least else [])
            return [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(found, kind)]
        return f

    fields = [field("score", "double"), field("predicted", "int"), field("offending", "array<struct<start:bigint,end:bigint,p:double>>")]
    return append(docs, [utf8(text)], fields, factory)


def fit_and_score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
                  rows: int = TRAIN_ROWS) -> DataFrame:
    """Train on labelled rows whose id's remainder modulo 5 isn't 0, and score
    every row; ``held_out`` marks the others."""
    held_out = remainder(doc_id, 5) == 0
    model = train(docs, labels, ~held_out, text, doc_id, label, rows)
    return score(docs.withColumn("held_out", held_out), model, text)
