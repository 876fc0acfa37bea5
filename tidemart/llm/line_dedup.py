"""Line dedup: a sharded minimal perfect hash over distinct line hashes.

Line keys are hashed to 128 bits and counted per document (partial counts in
each task, one shuffle on the hash). The hashes that reach the document count
are dealt to shards; each shard becomes a minimal perfect hash with a compact
fingerprint array and a count array. Documents probe the arrays: from a
broadcast while the whole index is below ``broadcast_bytes``; beyond that,
probes are routed to the shards (salted, so a line of a third of all
documents is no single task) and each shard's arrays are read once per task.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append, col, field, prepare, stage, utf8

WS = b" \t\n\x0b\x0c\r"
GAMMA, SHARD_KEYS, ENTRY_BYTES, FLUSH = 1.5, 100_000, 16, 400_000


def line_keys(lines: list[bytes]) -> list[bytes]:
    """Keys of lines: white space stripped at both ends, A-Z lower-cased."""
    return [x.strip(WS).lower() for x in lines]


def key_hashes(keys: list[bytes]) -> np.ndarray:
    """(n, 2) unsigned 64-bit halves of the keys' 128-bit hashes."""
    return np.frombuffer(b"".join([xxhash.xxh128_digest(k) for k in keys]), ">u8").astype(np.uint64).reshape(-1, 2)


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    h = (keys + np.uint64(level * 0x5851F42D4C957F2D % 2**64)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return (h % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys: in each level the keys
    that are alone in their slot take it; the others go to the next level."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        base = 0
        while len(keys) and len(self.levels) < 40:
            size = -(-max(64, int(len(keys) * GAMMA)) // 64) * 64
            s = _slots(keys, len(self.levels), size)
            bits = np.bincount(s, minlength=size) == 1
            words = np.packbits(bits, bitorder="little").view("<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            self.levels.append((size, words, base + np.cumsum(ones) - ones))
            base += int(ones.sum())
            keys = keys[~bits[s]]
        self.rest = {int(k): base + i for i, k in enumerate(keys)}
        self.n = base + len(keys)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; for a key outside the set, any index or -1."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, words, ranks) in enumerate(self.levels):
            s = _slots(keys[todo], level, size)
            w, b = words[s >> 6], (s & 63).astype(np.uint64)
            hit = (w >> b) & np.uint64(1) == 1
            below = np.bitwise_count(w & ((np.uint64(1) << b) - np.uint64(1)))
            out[todo[hit]] = (ranks[s >> 6] + below)[hit]
            todo = todo[~hit]
        for i in todo if self.rest else ():
            out[i] = self.rest.get(int(keys[i]), -1)
        return out


class Shard:
    """Arrays of one shard: fingerprints (the hash's other half) and counts."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, n: np.ndarray):
        self.mph = PerfectHash(lo)
        at = self.mph.lookup(lo)
        self.prints, self.counts = np.empty(len(lo), np.uint64), np.empty(len(lo), np.int64)
        self.prints[at], self.counts[at] = hi, n

    def dumps(self) -> bytes:
        """Plain arrays, which a worker without this module can read too."""
        return pickle.dumps((self.mph.levels, self.mph.rest, self.mph.n, self.prints, self.counts))

    @staticmethod
    def loads(data: bytes) -> Shard:
        out = Shard(*[np.empty(0, np.uint64)] * 3)
        out.mph.levels, out.mph.rest, out.mph.n, out.prints, out.counts = pickle.loads(data)
        return out

    def probe(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The count of each hash; 0 where the shard doesn't hold it."""
        if not self.mph.n:
            return np.zeros(len(hi), np.int64)
        at = self.mph.lookup(lo)
        return np.where((at >= 0) & (self.prints[at] == hi), self.counts[at], 0)


def key_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(hi, lo, n): each distinct non-empty line key's hash and the number of
    documents (rows) that hold it. Counts are summed in the task first."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            rows, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(rows["hi"].view(np.int64)), pa.array(rows["lo"].view(np.int64)), pa.array(n)], names=["hi", "lo", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                keys = {k for k in line_keys(text.split(b"\n")) if k}
                if keys:
                    h = np.ascontiguousarray(key_hashes(list(keys)))
                    held.append(np.unique(h.view([("hi", np.uint64), ("lo", np.uint64)]).ravel()))
                    size += len(held[-1])
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    out = docs.select(utf8(text).alias("t")).mapInArrow(run, "hi long, lo long, n long")
    return out.groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def build_index(counts: DataFrame, min_docs: int) -> tuple[DataFrame, int, int]:
    """(index rows (shard, arrays), number of shards, bytes of all arrays) of
    the line hashes found in at least ``min_docs`` documents. The number of
    shards follows the number of hashes, so a shard's arrays are bounded."""
    hot = stage(counts.filter(F.col("n") >= min_docs), "hot-lines")
    keys = hot.count()
    shards = max(1, -(-keys // SHARD_KEYS))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        hi, lo = (rows[c].to_numpy(np.int64).view(np.uint64) for c in ("hi", "lo"))
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "arrays": [Shard(hi, lo, rows["n"].to_numpy(np.int64)).dumps()]})

    rows = hot.withColumn("shard", F.pmod(F.col("hi"), F.lit(shards)))
    return stage(rows.groupBy("shard").applyInPandas(build, "shard long, arrays binary"), "line-index"), shards, keys * ENTRY_BYTES


def _probe_all(index: dict[int, Shard], shards: int, hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashes), np.int64)
    to = np.mod(hashes[:, 0].view(np.int64), shards)
    for s in np.unique(to):
        if int(s) in index:
            at = to == s
            out[at] = index[int(s)].probe(hashes[at, 0], hashes[at, 1])
    return out


def _dropped(lines: list[bytes], verdict) -> tuple[int, int, bytes]:
    keys = line_keys(lines)
    bad = verdict(keys)
    kept = [x for x, k, d in zip(lines, keys, bad, strict=True) if not (d and k)]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def _results(texts, verdicts) -> list[pa.Array]:
    rows = [_dropped(t.split(b"\n"), v) for t, v in zip(texts, verdicts, strict=True)]
    n, d, k = zip(*rows, strict=True)
    return [pa.array(k, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())]


def dedup_lines(docs: DataFrame, min_docs: int = 10, text: str = "text", doc_id: str = "doc_id",
                broadcast_bytes: int = 64 << 20, salts: int = 16) -> DataFrame:
    """``docs`` without the lines whose key is in ``min_docs`` documents or
    more; adds ``n_lines`` (before) and ``n_dropped``, replaces the text.

    Each row is a document, also one that repeats. Null and empty texts are
    one empty line, which stays; lines without a key always stay; a text that
    loses all lines becomes empty. An empty table gives an empty result."""
    prepare(docs.sparkSession)
    index, shards, size = build_index(key_counts(docs, text), min_docs)
    fields = [field(text, "string"), field("n_lines", "bigint"), field("n_dropped", "bigint")]
    if size <= broadcast_bytes:
        held = docs.sparkSession.sparkContext.broadcast({r.shard: r.arrays for r in index.toLocalIterator()})

        def factory():
            arrays = {s: Shard.loads(x) for s, x in held.value.items()}

            def verdict(keys):
                return _probe_all(arrays, shards, key_hashes(keys)) > 0
            return lambda ts: _results(ts.to_pylist(), [verdict] * len(ts))

        return append(docs, [utf8(text)], fields, factory)
    hits = _routed(docs, index, shards, text, doc_id, salts)
    found = docs.withColumn("__key", _row_key(text, doc_id)).join(hits, "__key", "left").drop("__key")

    def probing():
        def f(ts, hs):
            sets = [frozenset(h or ()) for h in hs.to_pylist()]
            return _results(ts.to_pylist(), [lambda keys, s=s: [s and xxhash.xxh128_digest(k) in s for k in keys] for s in sets])
        return f

    return append(found, [utf8(text), F.col("__hits")], fields, probing, drop=("__hits",))


def _row_key(text: str, doc_id: str) -> Column:
    """Key of a row: rows without an id or of one id differ by their texts. Two
    rows of one key would share their hits, which are indexed lines of either."""
    return F.xxhash64(col(doc_id), utf8(text))


def _routed(docs: DataFrame, index: DataFrame, shards: int, text: str, doc_id: str, salts: int) -> DataFrame:
    """(__key, __hits): the hashes of the indexed lines of each row key, found
    by sending each document's line hashes to their shard."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, salt, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                keys = list({k for k in line_keys(t.split(b"\n")) if k})
                if keys:
                    h = key_hashes(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(np.mod(h[:, 0].view(np.int64), shards)), pa.array([salt] * len(keys), pa.int64()), pa.array([1] * len(keys), pa.int32()),
                                                      pa.array([key] * len(keys), pa.int64()), pa.array([xxhash.xxh128_digest(k) for k in keys], pa.binary())], names=["shard", "salt", "kind", "key", "data"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, arrays = None, None
        for b in batches:
            keys, hits = [], []
            for s, kind, key, data in zip(*(b.column(c).to_pylist() for c in ("shard", "kind", "key", "data")), strict=True):
                if kind == 0:
                    now, arrays = s, Shard.loads(data)
                elif s == now:
                    h = np.frombuffer(data, ">u8").astype(np.uint64).reshape(1, 2)
                    if arrays.probe(h[:, 0], h[:, 1])[0]:
                        keys.append(key)
                        hits.append(data)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hits, pa.binary())], names=["__key", "hit"])

    schema = "shard long, salt long, kind int, key long, data binary"
    probes = docs.select(_row_key(text, doc_id).alias("key"), F.pmod(_row_key(text, doc_id), F.lit(salts)).alias("salt"), utf8(text).alias("t")).mapInArrow(explode, schema)
    arrays = index.select("shard", F.explode(F.array(*[F.lit(x).cast("long") for x in range(salts)])).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("key"), F.col("arrays").alias("data"))
    dealt = probes.unionByName(arrays).repartition("shard", "salt").sortWithinPartitions("salt", "shard", "kind")
    return dealt.mapInArrow(probe, "__key long, hit binary").groupBy("__key").agg(F.collect_set("hit").alias("__hits"))
