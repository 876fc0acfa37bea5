"""Language identification: multinomial naive Bayes over hashed character
n-grams.

Counts of hashed n-grams per language come from a bounded sample of the
labelled rows (``rows_per_lang`` a language, chosen by a hash of the id), so
training costs the same at every size. The smoothed log-probability matrix
(buckets x languages) is broadcast; its size is bounded by ``MATRIX_BYTES``.
Each Arrow batch is scored as sparse rows: the bucket numbers of its texts
gather matrix rows, which are summed text by text in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append, col, field, prepare, utf8

SIZES, BUCKETS, SMOOTHING, PIECE = (1, 2, 3), 1 << 15, 0.5, 1 << 18
MATRIX_BYTES, GATHERED = 128 << 20, 1 << 22
UNDETERMINED = "und"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32)


def pieces(points: np.ndarray, size: int = PIECE) -> Iterator[tuple[np.ndarray, int]]:
    """(code points, starts): a text in pieces of at most ``size`` starts,
    each with the points after them that its last n-grams need."""
    for at in range(0, len(points), size):
        part = points[at:at + size + SIZES[-1] - 1]
        yield part, min(size, len(points) - at)


def buckets(parts: list[tuple[np.ndarray, int]]) -> list[np.ndarray]:
    """For each n, the bucket of the n-gram at each place of the joined
    pieces; BUCKETS where no n-gram of that piece starts."""
    points = np.concatenate([p for p, _ in parts]).astype(np.uint64)
    ends = np.cumsum([len(p) for p, _ in parts])
    over = np.array([len(p) - s for p, s in parts])  # places at a piece's end that belong to the next piece
    out, h = [], np.zeros(len(points), np.uint64)
    for n in SIZES:
        k = len(points) - n + 1
        if k <= 0:
            out.append(np.full(len(points), BUCKETS, np.int64))
            continue
        h = (h[:k] + points[n - 1:] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        b = np.full(len(points), BUCKETS, np.int64)
        b[:k] = h >> np.uint64(64 - 15)
        for j in range(max(n - 1, 0)):
            b[ends - 1 - j] = BUCKETS
        for j in range(SIZES[-1] - 1):
            b[ends[over > j] - 1 - j] = BUCKETS
        out.append(b)
    return out


def _joined(texts: Iterator[tuple[int, str]], limit: int):
    """Groups of (text number, piece, starts) of about ``limit`` points."""
    held, size = [], 0
    for i, t in texts:
        for part, starts in pieces(code_points(t), min(PIECE, limit)):
            held.append((i, part, starts))
            size += len(part)
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


class Model:
    """Log-probabilities (buckets + 1, languages); the last row is zero."""

    def __init__(self, langs: list[str], counts: np.ndarray, prior: np.ndarray):
        self.langs = langs
        log = np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * BUCKETS))
        self.matrix = np.vstack([log - (log.mean(1, keepdims=True) if langs else 0), np.zeros((1, len(langs)))])
        self.prior = np.log(prior / prior.sum())

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and posterior probability of each text."""
        n = len(texts)
        lang, score = [UNDETERMINED] * n, [0.0] * n
        live = [i for i, t in enumerate(texts) if t and self.langs and any(map(str.isalpha, t))]
        total = np.tile(self.prior, (n, 1))
        for group in _joined(((i, texts[i]) for i in live), max(4096, GATHERED // len(SIZES) // max(1, len(self.langs)))):
            starts = np.cumsum([0] + [len(p) for _, p, _ in group])[:-1]
            at = np.array([i for i, _, _ in group])
            for b in buckets([(p, s) for _, p, s in group]):
                np.add.at(total, at, np.add.reduceat(self.matrix[b], starts))
        for i in live:
            k = int(np.argmax(total[i]))
            lang[i], score[i] = self.langs[k], float(1 / np.exp(total[i] - total[i][k]).sum())
        return lang, score


def train(docs: DataFrame, eligible: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
          rows_per_lang: int = 5000) -> Model:
    """A model from the ``eligible`` rows with text and language. About
    ``rows_per_lang`` rows of each language are used (all, if it has fewer);
    the priors are counted over all of them. More languages than the matrix
    has room for (``MATRIX_BYTES``: 512) raise a ValueError."""
    prepare(docs.sparkSession)
    rows = docs.filter(eligible & col(text).isNotNull() & col(lang).isNotNull()).select(col(lang).cast("string").alias("lang"), col(doc_id).cast("string").alias("id"), col(text).cast("string").alias("t"))
    sizes = rows.groupBy("lang").count()
    most = MATRIX_BYTES // (8 * BUCKETS)
    held = sizes.limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"more than {most} languages: the matrix would pass {MATRIX_BYTES} bytes")
    if not held:
        return Model([], np.zeros((BUCKETS, 0)), np.ones(0))
    share = F.create_map(*[F.lit(x) for r in held for x in (r.lang, min(1.0, rows_per_lang / r["count"]))])
    sample = rows.filter(F.pmod(F.xxhash64("id", F.length("t")), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(0).to_pylist()
            texts = b.column(1).to_pylist()
            for g in set(langs):
                for group in _joined(((i, texts[i]) for i, x in enumerate(langs) if x == g), GATHERED):
                    for ids in buckets([(p, s) for _, p, s in group]):
                        sums[g] = sums.get(g, 0) + np.bincount(ids, minlength=BUCKETS + 1)[:BUCKETS]
        for g, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(at)), pa.array(at), pa.array(c[at])], names=["lang", "bucket", "n"])

    summed = sample.select("lang", "t").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = sorted(r.lang for r in held)
    counts = np.zeros((BUCKETS, len(langs)))
    got = summed.toPandas()  # at most BUCKETS rows a language
    counts[got["bucket"].to_numpy(np.int64), np.searchsorted(langs, got["lang"].to_numpy(str))] = got["n"]
    size = {r.lang: r["count"] for r in held}
    return Model(langs, counts, np.array([size[g] for g in langs], float))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (the posterior, 0 to 1) of each whole
    text; ``und`` and 0 for null texts, texts without a letter and a model
    that learned no language. Only the text decides: equally likely languages
    go to the first by name, repeated rows get the same answer, texts of any
    length are read whole, an empty table gives an empty result."""
    held = docs.sparkSession.sparkContext.broadcast((model.langs, model.matrix, model.prior))

    def factory():
        m = Model.__new__(Model)
        m.langs, m.matrix, m.prior = held.value

        def f(ts):
            texts = [t.decode("utf-8", "replace") for t in ts.to_pylist()]
            lang, score = m.predict(texts)
            return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
        return f

    return append(docs, [utf8(text)], [field("lang_pred", "string"), field("score", "double")], factory)


def remainder(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col(doc_id).cast("string"), F.lit(""))) % mod


def fit_and_identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
                     rows_per_lang: int = 5000) -> DataFrame:
    """Train on the rows whose id's remainder modulo 4 isn't 2, and identify
    every row; ``held_out`` marks the others."""
    held_out = remainder(doc_id, 4) == 2
    model = train(docs, ~held_out, text, lang, doc_id, rows_per_lang)
    return identify(docs.withColumn("held_out", held_out), model, text)
