"""Importance resampling towards a target text collection (hashed features).

Words of a batch of texts are found by an Aho-Corasick automaton over its
distinct words, each bounded by a delimiter on both sides, so a match is a
whole word. A word's payload is its CRC-32 and its length: the scan emits the
payloads in text order, and the CRC of a run of words follows from those of
its adjacent parts (a CRC is linear: that of a joined text needs the parts'
CRCs and the second's length), so no run is ever spelled out or hashed again.

Bucket counts of source and target are sums of fixed-size arrays; the gains
(one a bucket) are the only thing that reaches the driver and is broadcast.
The draw is Gumbel top-k: log weights plus seeded noise, ranked by a range
partitioning whose partition sizes give every row its place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import append, col, field, prepare, stage, utf8

_BLANK = 0x20
#: A-Z lower-cased; bytes that are no part of a word become the delimiter.
CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else _BLANK for b in range(256))
SCALE, SPAN = 1000, 4294967296


def _byte_step() -> np.ndarray:
    """(4, 256): the CRC register after one zero byte, by byte of the register."""
    rows = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rows = np.where(rows & 1, (rows >> 1) ^ np.uint32(0xEDB88320), rows >> 1)
    single = [(np.arange(256, dtype=np.uint32) << (8 * k)) >> 8 for k in range(4)]
    return np.stack([rows, *single[1:]])


def _apply(step: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return step[0][crc & 255] ^ step[1][crc >> 8 & 255] ^ step[2][crc >> 16 & 255] ^ step[3][crc >> 24]


class Joiner:
    """CRC-32 of joined texts, from those of the parts, for arrays at once."""

    def __init__(self):
        self.steps = [_byte_step()]  # by 1, 2, 4, ... zero bytes

    def join(self, left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
        """CRC-32 of each left text followed by the right one of ``size`` bytes."""
        out, size = left.astype(np.uint32), size.astype(np.int64)
        for k in range(int(size.max(initial=0)).bit_length()):
            if k == len(self.steps):
                self.steps.append(np.stack([_apply(self.steps[-1], part) for part in self.steps[-1]]))
            on = (size >> k & 1).astype(bool)
            out[on] = _apply(self.steps[k], out[on])
        return out ^ right.astype(np.uint32)


class Scanner:
    """Payloads (CRC, bytes) of the words of texts, in text order."""

    def scan(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(crc, size, number of words of each text)."""
        clean = [t.translate(CLEAN) for t in texts]
        words: dict[bytes, int] = {}
        for t in clean:
            words.update(dict.fromkeys(t.split(), 0))
        if not words:
            return np.empty(0, np.uint32), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
        automaton = ahocorasick.Automaton()
        for i, w in enumerate(words):
            automaton.add_word(f" {w.decode('latin-1')} ", i)
        automaton.make_automaton()
        crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        found = [np.fromiter((i for _, i in automaton.iter(f" {t.decode('latin-1')} ")), np.int64) for t in clean]
        at = np.concatenate(found)
        return crc[at], size[at], np.array([len(x) for x in found])


def run_buckets(crc: np.ndarray, size: np.ndarray, counts: np.ndarray, longest: int, buckets: int,
                joiner: Joiner) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each run length, (bucket, text number) of all runs of that many
    consecutive words of a text, joined by one blank."""
    text = np.repeat(np.arange(len(counts)), counts)
    blank = np.uint32(zlib.crc32(b" "))
    after = joiner.join(np.full(len(crc), blank), crc, size) if longest > 1 else None  # of " word"
    run = crc
    for n in range(1, longest + 1):
        if n > 1:
            run = joiner.join(run[:-1], after[n - 1:], size[n - 1:] + 1) if len(run) else run
        own = text[:len(run)] == text[n - 1:n - 1 + len(run)]
        yield (run[own] % np.uint32(buckets)).astype(np.int64), text[:len(run)][own]


def bucket_counts(docs: DataFrame, buckets: int, longest: int = 1, text: str = "text") -> DataFrame:
    """(bucket, n): features of all texts by bucket, summed in each task first."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, scanner, joiner = np.zeros(buckets, np.int64), Scanner(), Joiner()
        for b in batches:
            for at, _ in run_buckets(*scanner.scan(b.column(0).to_pylist()), longest, buckets, joiner):
                total += np.bincount(at, minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["bucket", "n"])

    return docs.select(utf8(text).alias("t")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed target to source frequency, by bucket."""
    s, t, k = source.astype(float), target.astype(float), float(len(source))
    return np.floor(SCALE * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def _counted(docs: DataFrame, buckets: int, longest: int, text: str) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for r in bucket_counts(docs, buckets, longest, text).collect():  # at most `buckets` rows
        out[r["bucket"]] = r["n"]
    return out


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = 1, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_features and weight (the sum of its features' gains)."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def factory():
        own, scanner, joiner = held.value, Scanner(), Joiner()

        def f(ts):
            crc, size, counts = scanner.scan(ts.to_pylist())
            features, weight = np.zeros(len(ts), np.int64), np.zeros(len(ts), np.int64)
            for at, text_no in run_buckets(crc, size, counts, longest, len(own), joiner):
                features += np.bincount(text_no, minlength=len(ts))
                np.add.at(weight, text_no, own[at])
            return [pa.array(counts, pa.int64()), pa.array(features, pa.int64()), pa.array(weight, pa.int64())]
        return f

    return append(docs, [utf8(text)], [field(c, "bigint") for c in ("n_words", "n_features", "weight")], factory)


def noise(doc_id: str, seed: int) -> Column:
    """Gumbel noise in thousandths, from the id; a null id counts as the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(float(SPAN))))).cast("bigint")


def place(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place (from 1) in ``order``: ranges are sorted
    apart, and the sizes of the ranges before give where each begins."""
    spark = rows.sparkSession
    part = "__part" + "_" * max((len(c) for c in rows.columns), default=0)
    dealt = stage(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = sorted((r[0], r[1]) for r in dealt.groupBy(part).count().collect())  # one row a range
    starts, before = [], 0
    for p, n in sizes:
        starts.append((p, before))
        before += n
    first = spark.createDataFrame(starts, f"{part} int, {part}first long")
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return dealt.join(F.broadcast(first), part).withColumn(name, (own + F.col(f"{part}first")).cast("bigint")).drop(part, f"{part}first")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, buckets: int = 10000, longest: int = 1, least_words: int = 20,
             seed: int = 2024, text: str = "text", doc_id: str = "doc_id", target_text: str = "text") -> DataFrame:
    """Every row of ``docs`` as (doc_id, n_words, n_features, weight, score,
    rank): ``percent`` of the rows with ``least_words`` words or more are drawn,
    those of the highest scores, ties to the smaller id (null ids last, rows of
    one id and score by fewer features); rank is null for the others.

    Each row is a document, also one that repeats; its columns beside id and
    text are not carried. Null and empty texts have no features and weight 0.
    An empty target leaves the smoothed counts; an empty table gives an empty
    result. Texts of any length are scanned whole."""
    gain = gains(_counted(docs, buckets, longest, text), _counted(target, buckets, longest, target_text))
    rows = weigh(docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")), gain, longest)
    scored = stage(rows.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise("doc_id", seed)).alias("score")), "weights")
    live = F.col("n_words") >= least_words
    drawn = scored.filter(live).count() * percent // 100
    placed = place(scored.filter(live), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()])
    return placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(scored.filter(~live).withColumn("rank", F.lit(None).cast("bigint")))
