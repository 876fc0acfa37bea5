"""Katz backoff language model: training and scoring of whole texts.

An n-gram is a pair (context, word): the context is the id of the n-1 words
before, so every level is counted, stored and looked up by the same code.
Level 1 numbers the words, level n numbers the n-grams by the level below.

Texts are cut once into blocks of whole documents (about ``BLOCK_BYTES``),
stored as numbers into the block's own word list. A block asks for each of its
distinct n-grams once, so a frequent n-gram costs one request a block however
often it occurs. Requests are dealt to buckets by context; a context with more
than ``SPLIT`` occurrences is salted by the next word, so no bucket gathers
one context. Their number follows the number of tokens, so a bucket's arrays
are bounded. Each bucket travels as packed sorted arrays.

Training, level by level: counts are merged by bucket into a table (one row a
bucket: contexts, words, counts); the counts of counts give the Good-Turing
discounts; the discounted mass and the lower-order mass of each context's
seen words give its backoff weight, so that its probabilities sum to 1. Both
tables are stored by bucket below ``spark.checkpoint.dir``. Scoring joins the
requests of each block to them, level by level, and evaluates each token from
level 1 up: the discounted estimate where the n-gram was seen, the backoff
weight times the lower level's where only the context was, the lower level's
where it wasn't.

Good-Turing discounts apply to counts up to the largest cutoff (at most
``CUTOFF``) for which they lie between 0 and 1. A context none of whose counts
are discounted is counted as seen once more, which is the mass it backs off
with. Words are known by 64-bit hashes.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field as data_field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, prepare, release, stage, utf8
from .language_id import remainder

BLOCK_BYTES, BUCKET_TOKENS, SPLIT, CUTOFF = 4 << 20, 1 << 21, 1 << 22, 5
START, FIRST_ID, END = 1, 2, b""
BASE_ADD = 0.1

_ASK = "bucket long, kind int, block long, a binary, b binary, n binary, x binary, y binary"
_GRAMS = "bucket long, a binary, b binary, n binary, low binary, size long, hist array<long>"


# ------------------------------------------------------------- packed arrays

def pack(values: np.ndarray) -> bytes:
    """Unsigned integers (or floats, by their bits) as compressed byte planes."""
    a = np.ascontiguousarray(values if values.dtype == np.float64 else values.astype(np.uint64))
    planes = a.view(np.uint8).reshape(-1, 8).T
    used = np.flatnonzero(planes.any(1))
    low, high = (int(used[0]), int(used[-1]) + 1) if len(used) else (0, 0)
    return struct.pack("<QBB", len(a), low, high) + zstandard.ZstdCompressor(level=1).compress(planes[low:high].tobytes())


def unpack(data: bytes, dtype=np.int64) -> np.ndarray:
    n, low, high = struct.unpack_from("<QBB", data)
    planes = np.zeros((8, n), np.uint8)
    if n and high:
        planes[low:high] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[10:], max_output_size=n * (high - low)), np.uint8).reshape(high - low, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a.astype(np.uint64), prepend=np.uint64(0)))


def unpack_sorted(data: bytes, dtype=np.int64) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64).view(dtype)


def pack_few(a: np.ndarray) -> bytes:
    """Floats of few distinct values."""
    values, at = np.unique(a, return_inverse=True)
    head = pack(at)
    return struct.pack("<Q", len(head)) + head + pack(values)


def unpack_few(data: bytes) -> np.ndarray:
    n = struct.unpack_from("<Q", data)[0]
    return unpack(data[8 + n:], np.float64)[unpack(data[8:8 + n])]


def mix(a: np.ndarray) -> np.ndarray:
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of pairs of unsigned 64-bit numbers by (a, b), the number of the
    distinct pair at each place of that order, and where each begins."""
    if len(a) and (top := int(a.max())) and (width := int(b.max()) + 1) * (top + 1) < 1 << 63:
        key = a * np.uint64(width) + b
    else:
        key = b if not len(a) or not int(a.max()) else None
    order = np.argsort(key, kind="stable") if key is not None else np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = key[order][1:] != key[order][:-1] if key is not None else (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


# ------------------------------------------------------------------ the model

@dataclass
class Level:
    """One order's figures and tables. ``buckets`` is also the number of
    context buckets, numbered from there on."""
    buckets: int
    discounts: np.ndarray | None = None
    grams: DataFrame | None = None
    contexts: DataFrame | None = None

    def plain(self) -> Level:
        return Level(self.buckets, self.discounts)


@dataclass
class Model:
    order: int
    train_docs: int = 0
    train_tokens: int = 0
    words: int = 0
    unknown: float = 1.0
    extra: int = 0  # virtual occurrences at level 1
    levels: list[Level] = data_field(default_factory=list)

    def plain(self) -> Model:
        return Model(self.order, self.train_docs, self.train_tokens, self.words, self.unknown, self.extra, [x.plain() for x in self.levels])


def good_turing(counts_of_counts: list[int]) -> np.ndarray:
    """d[r] for r = 0..k from n[1..CUTOFF+1]; [1] if no cutoff gives discounts in (0, 1)."""
    n = [0, *counts_of_counts]
    for k in range(min(CUTOFF, len(n) - 2), 1, -1):
        if all(n[1:k + 2]):
            over = (k + 1) * n[k + 1] / n[1]
            d = [1.0] + [((r + 1) * n[r + 1] / (r * n[r]) - over) / (1 - over) if over < 1 else 1.0 for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d[1:]):
                return np.array(d)
    return np.ones(1)


def discounted(d: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(n < len(d), d[np.minimum(n, len(d) - 1)], 1.0) * n


# --------------------------------------------------------------------- blocks

class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def blocks_of(docs: DataFrame, learns: Column, text: str, doc_id: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents in blocks: ids, whether each one is learnt from, tokens each,
    the tokens as numbers into the block's word hashes."""
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), *[T.StructField(c, T.BinaryType()) for c in ("learns", "sizes", "tokens", "words")],
                           *[T.StructField(c, T.LongType()) for c in ("train_docs", "train_tokens", "n_tokens")], T.StructField("found", T.ArrayType(T.BinaryType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, []

        def flush() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            flags, sizes = np.concatenate([h[1] for h in held]), np.array([n for h in held for n in h[2]])
            words = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
            row = [pa.array([part << 32 | number]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *[pa.array([x], pa.binary()) for x in (pack(flags), pack(sizes), pack(np.array(tokens)), pack(words))],
                   *[pa.array([int(x)]) for x in (flags.sum(), sizes[flags].sum(), sizes.sum())], pa.array([[]], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(row, names=schema.names)

        numbers, tokens, size = _Numbers(), [], 0
        for b in batches:
            at, here = 0, []
            flags = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, t in enumerate(b.column(2).to_pylist()):
                before = len(tokens)
                tokens.extend(map(numbers.__getitem__, t.lower().split()))
                tokens.append(numbers[END])
                here.append(len(tokens) - before)
                size += len(t) + 1
                if size >= block_bytes or i == b.num_rows - 1:
                    held.append((b.column(0).slice(at, i + 1 - at), flags[at:i + 1], here))
                    at, here = i + 1, []
                if size >= block_bytes:
                    yield flush()
                    number, held = number + 1, []
                    numbers, tokens, size = _Numbers(), [], 0
        if held:
            yield flush()

    src = docs.select(col(doc_id).alias("id"), F.coalesce(learns, F.lit(False)).alias("learns"), utf8(text).alias("t"))
    return stage(src.mapInArrow(run, schema), "katz-blocks")


class Block:
    """A block replayed up to the level its answers reach."""

    def __init__(self, row: dict, model: Model):
        self.model, self.found = model, row["found"]
        self.sizes, self.tokens, self.hashes = unpack(row["sizes"]), unpack(row["tokens"]), unpack(row["words"], np.uint64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.learns = np.repeat(unpack(row["learns"]).astype(bool), self.sizes)
        self.level = 0
        for _ in range(len(self.found) // 4):
            self._climb()

    def keys(self) -> tuple:
        """What the next level asks for: (context, word, bucket) of each
        distinct key in bucket order, and its number at each token (-1: none)."""
        n, buckets = self.level + 1, self.model.levels[self.level].buckets
        if n == 1:
            order, group, first = pairs(np.zeros(len(self.hashes), np.uint64), self.hashes)
            a, b = np.zeros(len(first), np.uint64), self.hashes[order][first]
            bucket = (mix(b) % np.uint64(buckets)).astype(np.int64)
            local = np.empty(len(order), np.int64)
            local[order] = group
            number = local[self.tokens]
        else:
            self._contexts()
            live = np.flatnonzero((self.before > 0) & (self.word > 0))
            a, b, seen = self.context[live].astype(np.uint64), self.word[live].astype(np.uint64), self.before[live]
            order, group, first = pairs(a, b)
            a, b, seen = (x[order][first] for x in (a, b, seen))
            salt = mix(b) % (seen // SPLIT + 1).astype(np.uint64)
            bucket = (mix(a + salt * np.uint64(0xBF58476D1CE4E5B9)) % np.uint64(buckets)).astype(np.int64)
            number = np.full(len(self.tokens), -1, np.int64)
            number[live[order]] = group
        dealt = np.argsort(bucket, kind="stable")
        place = np.empty(len(dealt) + 1, np.int64)
        place[dealt], place[-1] = np.arange(len(dealt)), -1
        return a[dealt], b[dealt], bucket[dealt], place[number]

    def _contexts(self) -> None:
        """Id and training occurrences of the context of each token."""
        self.context, self.before = np.empty_like(self.tokens), np.empty_like(self.tokens)
        self.context[1:], self.before[1:] = self.gram[:-1], self.count[:-1]
        first = self.level == 1
        self.context[self.starts], self.before[self.starts] = START if first else 0, self.model.train_docs if first else 0

    def context_keys(self) -> tuple:
        """The distinct seen contexts in bucket order, their buckets, the number at each token."""
        level = self.model.levels[self.level]
        live = np.flatnonzero(self.before > 0)
        values, group = np.unique(self.context[live], return_inverse=True)
        bucket = level.buckets + (mix(values) % np.uint64(level.buckets)).astype(np.int64)
        dealt = np.argsort(bucket, kind="stable")
        place = np.empty(len(dealt), np.int64)
        place[dealt] = np.arange(len(dealt))
        number = np.full(len(self.tokens), -1, np.int64)
        number[live] = place[group]
        return values[dealt], bucket[dealt], number

    def _climb(self) -> None:
        """Evaluate each token at the next level from the answers."""
        counts, grams, extras, weights = self.found[4 * self.level:4 * self.level + 4]
        number = self.keys()[3]
        level, model = self.model.levels[self.level], self.model
        count = np.append(unpack(counts), 0)[number]
        gram = np.append(unpack(grams), 0)[number] if self.level + 1 < model.order else np.zeros_like(count)
        if self.level == 0:
            seen = discounted(level.discounts, count) / max(1, model.train_tokens + model.extra)
            self.p, self.word, self.known = np.where(count > 0, seen, model.unknown), gram, count  # ids of the words
        elif level.discounts is not None:
            at = self.context_keys()[2]
            extra, weight = np.append(unpack(extras), 0)[at], np.append(unpack(weights, np.float64), 1.0)[at]
            seen = discounted(level.discounts, count) / np.maximum(self.before + extra, 1)
            self.p = np.where(count > 0, seen, weight * self.p)
        self.count, self.gram = count, gram
        self.level += 1


def _segments(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
        if hi > lo:
            yield int(bucket[lo]), slice(lo, hi)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split(" ") for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def _each(df: DataFrame, make: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """``make(row)`` -> rows, for each row, in Arrow."""
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                if made := make(row):
                    yield _rows(made, schema)
    return df.mapInArrow(run, schema)


def _dealt(df: DataFrame, by: str, parts: int) -> DataFrame:
    """Rows dealt by a column, to as many tasks as it has ``parts`` where
    those are more than the session's shuffle partitions (of which small ones
    are joined), so a task's share doesn't grow with the corpus."""
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, by) if parts > own else df.repartition(by)


def _by_bucket(df: DataFrame, buckets: int, merge: Callable[[int, list[dict]], tuple], schema: str) -> DataFrame:
    """``merge(bucket, rows)`` -> one row, for all rows of each bucket."""
    def run(batches):
        now, held = None, []
        for b in batches:
            for row in b.to_pylist():
                if held and row["bucket"] != now:
                    yield _rows([merge(now, held)], schema)
                    held = []
                now = row["bucket"]
                held.append(row)
        if held:
            yield _rows([merge(now, held)], schema)
    return _dealt(df, "bucket", buckets).sortWithinPartitions("bucket").mapInArrow(run, schema)


# ------------------------------------------------------------------- training

def _count(blocks: DataFrame, model: Model) -> DataFrame:
    """The next level's n-grams of the documents learnt from, with counts and
    the lower level's probability."""
    plain = model.plain()

    def ask(row: dict) -> list[tuple]:
        block = Block(row, plain)
        a, b, bucket, number = block.keys()
        mine = block.learns & (number >= 0)
        n = np.bincount(number[mine], minlength=len(a))
        low = np.zeros(len(a))
        if block.level:
            low[number[mine]] = block.p[mine]
        on = n > 0
        a, b, bucket, n, low = a[on], b[on], bucket[on], n[on], low[on]
        return [(k, 0, row["block"], pack_sorted(a[s]), pack(b[s]), pack(n[s]), pack_few(low[s]), None) for k, s in _segments(bucket)]

    def merge(bucket: int, rows: list[dict]) -> tuple:
        a = np.concatenate([unpack_sorted(r["a"], np.uint64) for r in rows])
        b = np.concatenate([unpack(r["b"], np.uint64) for r in rows])
        n = np.concatenate([unpack(r["n"]) for r in rows])
        low = np.concatenate([unpack_few(r["x"]) for r in rows])
        order, _, first = pairs(a, b)
        n = np.add.reduceat(n[order], first)
        at = order[first]
        return (bucket, pack_sorted(a[at]), pack(b[at]), pack(n), pack_few(low[at]), len(at), np.bincount(n[n <= CUTOFF + 1], minlength=CUTOFF + 2)[1:].tolist())

    return stage(_by_bucket(_each(blocks, ask, _ASK), plain.levels[-1].buckets, merge, _GRAMS), "katz-grams")


def _weigh(grams: DataFrame, buckets: int, discounts: np.ndarray) -> DataFrame:
    """Each context's virtual occurrences and backoff weight."""
    def part(row: dict) -> list[tuple]:
        a, n, low = unpack_sorted(row["a"]), unpack(row["n"]), unpack_few(row["low"])
        first = np.flatnonzero(np.diff(a, prepend=-1))
        a, total, mass, left = a[first], np.add.reduceat(n, first), np.add.reduceat(low, first), np.add.reduceat(n - discounted(discounts, n), first)
        bucket = buckets + (mix(a) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        a, total, mass, left, bucket = (x[order] for x in (a, total, mass, left, bucket))
        return [(k, 0, None, pack_sorted(a[s]), None, pack(total[s]), pack(mass[s]), pack(left[s])) for k, s in _segments(bucket)]

    def merge(bucket: int, rows: list[dict]) -> tuple:
        a = np.concatenate([unpack_sorted(r["a"]) for r in rows])
        values, at = np.unique(a, return_inverse=True)
        total, mass, left = np.zeros(len(values), np.int64), np.zeros(len(values)), np.zeros(len(values))
        for out, c, kind in ((total, "n", np.int64), (mass, "x", np.float64), (left, "y", np.float64)):
            np.add.at(out, at, np.concatenate([unpack(r[c], kind) for r in rows]))
        extra = (left <= 0).astype(np.int64)
        weight = (left + extra) / (total + extra) / np.maximum(1 - mass, np.finfo(float).tiny)
        return (bucket, 0, None, pack_sorted(values), None, pack(extra), pack(weight), None)

    return stage(_by_bucket(_each(grams, part, _ASK), buckets, merge, _ASK), "katz-contexts")


def _fit(blocks: DataFrame, order: int) -> tuple[Model, DataFrame]:
    """(model, the blocks with the answers of the levels below the last)."""
    docs, tokens, everything = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("train_docs", "train_tokens", "n_tokens")]).first()
    model = Model(order, docs, tokens)
    for n in range(1, order + 1):
        level = Level(max(1, -(-everything // (BUCKET_TOKENS * (4 if n == 1 else 1)))))
        model.levels.append(level)
        level.grams = _count(blocks, model)
        size, *hist = level.grams.agg(F.coalesce(F.sum("size"), F.lit(0)), *[F.coalesce(F.sum(F.col("hist")[i]), F.lit(0)) for i in range(CUTOFF + 1)]).first()
        level.discounts = good_turing(hist)
        if n == 1:
            left = sum((1 - d) * r * hist[r - 1] for r, d in enumerate(level.discounts) if r)
            model.words, model.extra = size, int(left <= 0)
            model.unknown = (left + model.extra) / (tokens + model.extra)
        else:
            level.contexts = _weigh(level.grams, level.buckets, level.discounts)
        if n < order:
            blocks = look_up(blocks, model, n)
    return model, blocks


def train(docs: DataFrame, order: int = 2, learns: Column | None = None, text: str = "text", doc_id: str = "doc_id",
          block_bytes: int = BLOCK_BYTES) -> Model:
    """A model of the rows for which ``learns`` holds (all, without it)."""
    prepare(docs.sparkSession)
    rows = docs.filter(learns) if learns is not None else docs
    model, blocks = _fit(blocks_of(rows, F.lit(True), text, doc_id, block_bytes), order)
    release(blocks)
    return model


# -------------------------------------------------------------------- scoring

def _answers(blocks: DataFrame, model: Model, n: int) -> DataFrame:
    """What the tables of level ``n`` say to the requests of the blocks."""
    plain, level, top = model.plain(), model.levels[n - 1], n == model.order
    buckets = level.buckets

    def ask(row: dict) -> list[tuple]:
        block = Block(row, plain)
        a, b, bucket, _ = block.keys()
        out = [(k, 1, row["block"], pack_sorted(a[s]), pack(b[s]), None, None, None) for k, s in _segments(bucket)]
        if block.level:
            a, bucket, _ = block.context_keys()
            out += [(k, 1, row["block"], pack_sorted(a[s]), None, None, None, None) for k, s in _segments(bucket)]
        return out

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = _Table(np.empty(0, np.uint64), None, np.empty(0, np.int64), np.empty(0))
        now, held = None, empty
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                k = r["bucket"]
                if k != now:
                    now, held = k, empty
                if r["kind"] == 0:
                    b, x = (unpack(r[c], t) if r[c] is not None else None for c, t in (("b", np.uint64), ("x", np.float64)))
                    held = _Table(unpack_sorted(r["a"], np.uint64), b, unpack(r["n"]), x)
                    continue
                at = held.find(unpack_sorted(r["a"], np.uint64), unpack(r["b"], np.uint64) if r["b"] is not None else None)
                count = np.append(held.values[0], 0)[at]
                if k < buckets:   # an n-gram's count and, for the next level, its id
                    out.append((r["block"], 1, k, pack(count), None if top else pack(np.where(at >= 0, FIRST_ID + at * buckets + k, 0))))
                else:             # a context's virtual occurrences and its weight
                    out.append((r["block"], 2, k, pack(count), pack(np.append(held.values[1], 1.0)[at])))
            if out:
                yield _rows(out, "block long, kind int, bucket long, n binary, x binary")

    tables = level.grams.select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("block"), "a", "b", "n", *[F.lit(None).cast("binary").alias(c) for c in "xy"])
    if level.contexts is not None:
        tables = tables.unionByName(level.contexts)
    asked = tables.unionByName(_each(blocks, ask, _ASK))
    answers = stage(_dealt(asked, "bucket", 2 * buckets).sortWithinPartitions("bucket", "kind").mapInArrow(answer, "block long, kind int, bucket long, n binary, x binary"), "katz-answers")

    return answers


def _assembled(blocks: DataFrame, answers: DataFrame, finish: Callable[[dict, pa.Array], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """``finish(block, its document ids)`` for each block, whose ``found`` then
    holds the answers as well, in the order in which the block asks."""
    both = blocks.withColumn("kind", F.lit(0)).unionByName(answers, allowMissingColumns=True)
    names = [c for c in blocks.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, parts = None, None, []

        def whole() -> pa.RecordBatch:
            for kind, kinds in ((1, (np.int64, np.int64)), (2, (np.int64, np.float64))):
                for c, dtype in zip("nx", kinds, strict=True):
                    own["found"].append(pack(np.concatenate([np.empty(0, dtype)] + [unpack(p[c], dtype) for p in parts if p["kind"] == kind and p[c] is not None])))
            parts.clear()
            return finish(own, ids)

        for b in batches:
            every = b.column(b.schema.names.index("ids"))
            for i, r in enumerate(b.drop_columns(["ids"]).to_pylist()):
                if r["kind"] == 0:
                    if own is not None:
                        yield whole()
                    own, ids = {c: r[c] for c in names}, every.slice(i, 1)
                else:
                    parts.append({c: r[c] for c in ("kind", "n", "x")})
        if own is not None:
            yield whole()

    return _dealt(both, "block", blocks.count() // 4).sortWithinPartitions("block", "kind", "bucket").mapInArrow(run, schema)


def look_up(blocks: DataFrame, model: Model, n: int) -> DataFrame:
    """``blocks``, which hold the answers below level ``n``, with those of level n."""
    answers, schema = _answers(blocks, model, n), blocks.schema
    kinds = {"found": pa.list_(pa.binary()), **{c: pa.int64() for c in ("block", "train_docs", "train_tokens", "n_tokens")}}

    def keep(row: dict, ids: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids if c == "ids" else pa.array([row[c]], kinds.get(c, pa.binary())) for c in schema.names], names=schema.names)

    out = stage(_assembled(blocks, answers, keep, schema), "katz-blocks")
    release(answers, blocks)
    return out


class _Table:
    """The sorted pairs of one bucket, with their values."""

    def __init__(self, a: np.ndarray, b: np.ndarray | None, *values: np.ndarray):
        self.a, self.b, self.values = a, b, values
        top, self.width = (int(a[-1]) if len(a) else 0), (int(b.max()) + 1 if b is not None and len(b) else 1)
        self.keys = a if b is None else b if not top else a * np.uint64(self.width) + b if (top + 1) * self.width < 1 << 64 else None

    def find(self, a: np.ndarray, b: np.ndarray | None) -> np.ndarray:
        """Place of each pair; -1: none."""
        if not len(self.a):
            return np.full(len(a), -1, np.int64)
        if self.keys is None:
            return self._merge(a, b)
        asked, ok = a, a <= self.a[-1]
        if b is not None:
            ok &= b < np.uint64(min(self.width, 2**64 - 1)) if self.a[-1] else True
            asked = a * np.uint64(self.width) + b if self.a[-1] else b
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return np.where(ok & (self.keys[at] == asked), at, -1)

    def _merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`find` where pairs don't fit one number: sort both together."""
        n = len(self.a)
        order, group, _ = pairs(np.concatenate([self.a, a]), np.concatenate([self.b, b]))
        at = np.empty(len(order), np.int64)
        at[order] = group
        place = np.full(int(group[-1]) + 1, -1, np.int64)
        place[at[:n]] = np.arange(n)
        return place[at[n:]]


def _scores(blocks: DataFrame, model: Model) -> DataFrame:
    """One row a document, from blocks that hold the answers below the last level."""
    plain, kind = model.plain(), blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("learnt", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")],
                           *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]])

    def evaluate(row: dict, ids: pa.Array) -> pa.RecordBatch:
        block = Block(row, plain)
        base = np.log10((block.known + BASE_ADD) / (plain.train_tokens + BASE_ADD * (plain.words + 1)))
        sums = [np.add.reduceat(x, block.starts) for x in ((block.known > 0).astype(np.int64), base, np.log10(block.p))]
        return pa.RecordBatch.from_arrays([ids.flatten(), pa.array(block.learns[block.starts]), pa.array(block.sizes), pa.array(sums[0]), pa.array(np.full(len(block.sizes), plain.train_tokens)),
                                           pa.array(sums[1]), pa.array(sums[2])], names=schema.names)

    return _assembled(blocks, _answers(blocks, model, plain.order), evaluate, schema)


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``score`` is the model's log10 probability of the whole text: its words,
    A-Z lower-cased, and one end; ``base_score`` the add-``BASE_ADD`` unigram one.
    Null and empty texts are the end alone. Each row is a document, also one
    that repeats or has no id; its other columns are not carried. A model of an
    empty table gives every text the probability 1; an empty table gives an
    empty result. A document is never cut: one longer than a block is a block."""
    prepare(docs.sparkSession)
    blocks = blocks_of(docs, F.lit(False), text, doc_id, block_bytes)
    for n in range(1, model.order):
        blocks = look_up(blocks, model, n)
    return _scores(blocks, model).drop("learnt")


def fit_and_score(docs: DataFrame, order: int = 2, text: str = "text", doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Train on the rows whose id's remainder modulo 10 isn't 0 and score every
    row, as `score` does, from one set of blocks; ``held_out`` marks the others."""
    prepare(docs.sparkSession)
    model, blocks = _fit(blocks_of(docs, remainder(doc_id, 10) != 0, text, doc_id, block_bytes), order)
    out = _scores(blocks, model)
    for level in model.levels:          # all answers are written
        release(*[t for t in (level.grams, level.contexts) if t is not None])
    return out.withColumn("held_out", ~F.col("learnt")).drop("learnt")
