"""SimHash near-dedup on a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight byte positions. Fingerprints at ``max_bits``
(3) or fewer differing bits share at least 8 - 3 = 5 positional bytes, so, in
one of the two halves, at least three of the four: the index therefore keeps
a posting list per triple of positions within a half and their bytes (eight
entries a fingerprint). Within a list the shared positional bytes of each
pair are tallied, pairs reaching the guaranteed count are kept, and their
bits verified. A list longer than ``split`` is dealt again by two more
positions out of the other five (ten entries each), after which only three
free bytes are left; a list that is still long is searched by flipping up to
``max_bits`` of those 24 bits, in time linear in its length. Lists give a
spanning forest of their links, never all pairs, and components follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, col, field, prepare, stage, utf8
from .components import components

SLICE, SPLIT, BLOCK = 1 << 16, 4096, 512
TRIPLES = [c for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for c in combinations(half, 3)]


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash over the word shingles of a text (A-Z lower-cased)."""
    ws = text.lower().split()
    if not ws:
        return 0
    flat = b" ".join(ws)
    size = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(size + 1) - 1
    k = min(shingle, len(ws))
    begin, end = (ends - size)[: len(ws) - k + 1].tolist(), ends[k - 1:].tolist()
    ones, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(begin), SLICE):
        hs = np.array([h(flat[a:b], 42) for a, b in zip(begin[at:at + SLICE], end[at:at + SLICE], strict=True)], "<u8")
        ones += np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(begin), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a (signed) long column ``name``."""
    prepare(docs.sparkSession)

    def factory():
        return lambda ts: [pa.array(np.array([fingerprint(t, shingle) for t in ts.to_pylist()], np.uint64).view(np.int64))]

    return append(docs, [utf8(text)], [field(name, "bigint")], factory)


def _bytes(fps: np.ndarray) -> np.ndarray:
    return fps.astype("<i8").view(np.uint8).reshape(-1, 8)


class Forest:
    """Union-find over the places 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def tie(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = self.root(i), self.root(j)
            if i != j:
                self.up[max(i, j)] = min(i, j)


def list_links(fps: np.ndarray, max_bits: int, shared: int) -> np.ndarray:
    """(n, 2) fingerprints: a spanning forest of the links within a list."""
    n, forest, tally = len(fps), Forest(len(fps)), _bytes(fps)
    bits = fps.view(np.uint64)
    for at in range(0, n, BLOCK):
        mine = slice(at, min(n, at + BLOCK))
        same = np.zeros((mine.stop - at, n - at), np.uint8)
        for p in range(8):
            same += tally[mine, p, None] == tally[None, at:, p]
        a, b = np.nonzero(same >= shared)
        ok = b > a
        a, b = a[ok] + at, b[ok] + at
        ok = np.bitwise_count(bits[a] ^ bits[b]) <= max_bits
        forest.tie(a[ok], b[ok])
    return _forest_edges(fps, forest)


def long_list_links(fps: np.ndarray, positions: tuple[int, ...], max_bits: int) -> np.ndarray:
    """The same for a long list whose free bytes are at ``positions``, by
    looking up each fingerprint with up to ``max_bits`` free bits flipped."""
    fps = np.sort(fps.view(np.uint64))
    forest, masks = Forest(len(fps)), [np.uint64(1) << np.uint64(8 * p + b) for p in positions for b in range(8)]
    for k in range(1, max_bits + 1):
        for c in combinations(masks, k):
            other = fps ^ np.bitwise_or.reduce(np.array(c))
            i = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
            at = np.flatnonzero((fps[i] == other) & (i > np.arange(len(fps))))
            if len(at):
                forest.tie(at, i[at])
    return _forest_edges(fps.view(np.int64), forest)


def _forest_edges(fps: np.ndarray, forest: Forest) -> np.ndarray:
    at = np.flatnonzero(forest.up != np.arange(len(fps)))
    return np.stack([fps[at], fps[[forest.root(int(i)) for i in at]]], 1) if len(at) else np.empty((0, 2), np.int64)


def _keys(fps: np.ndarray, positions: tuple[int, ...], number: int) -> np.ndarray:
    key = np.full(len(fps), number, np.int64)
    for p in positions:
        key = key << 8 | _bytes(fps)[:, p]
    return key


def _lists(batches: Iterator[pa.RecordBatch]):
    """(key, fingerprints) of each list, from rows sorted by key."""
    held_k, held_f = np.empty(0, np.int64), np.empty(0, np.int64)
    for b in batches:
        k = np.concatenate([held_k, b.column(0).to_numpy()])
        f = np.concatenate([held_f, b.column(1).to_numpy()])
        starts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
        sizes = np.diff(starts)
        for i in np.flatnonzero(sizes > 1):  # the last list may go on in the next batch
            yield int(k[starts[i]]), f[starts[i]:starts[i + 1]]
        held_k, held_f = k[starts[-1]:], f[starts[-1]:]
    if len(held_k) > 1:
        yield int(held_k[0]), held_f


def links(fps: DataFrame, max_bits: int = 3, split: int = SPLIT) -> DataFrame:
    """(u, v): links between the distinct fingerprints in column ``fp`` that
    connect whatever pairs at ``max_bits`` (at most 3) or fewer bits connect."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the index guarantees shared bytes for 0 to 3 differing bits")
    shared = 8 - max_bits

    def post(batches):
        for b in batches:
            f = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_keys(f, t, i) for i, t in enumerate(TRIPLES)])), pa.array(np.tile(f, len(TRIPLES)))], names=["k", "fp"])

    postings = fps.select("fp").mapInArrow(post, "k long, fp long")

    def short(batches):
        # links of lists up to `split`; of longer ones the members, to be dealt again
        for key, f in _lists(batches):
            if len(f) <= split:
                out, kind = list_links(f, max_bits, shared), 0
            else:
                out, kind = np.stack([np.full(len(f), key), f], 1), 1
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), kind, np.int32)), pa.array(np.ascontiguousarray(out[:, 0])), pa.array(np.ascontiguousarray(out[:, 1]))], names=["kind", "u", "v"])

    first = stage(postings.repartition("k").sortWithinPartitions("k").mapInArrow(short, "kind int, u long, v long"), "simhash-lists")

    def again(batches):
        for b in batches:
            key, f = b.column(0).to_numpy(), b.column(1).to_numpy()
            for t, triple in enumerate(TRIPLES):
                mine = f[key >> 24 == t]
                if len(mine):
                    rest = [p for p in range(8) if p not in triple]
                    pairs = list(combinations(rest, 2))
                    # the triple, the pair, and the five bytes: 3 + 4 + 40 bits
                    ks = [_keys(mine, triple + pair, t * 16 + i) for i, pair in enumerate(pairs)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ks)), pa.array(np.tile(mine, len(pairs)))], names=["k", "fp"])

    def finer(batches):
        for key, f in _lists(batches):
            triple = TRIPLES[key >> 44]
            rest = [p for p in range(8) if p not in triple]
            pair = list(combinations(rest, 2))[key >> 40 & 15]
            if len(f) <= split:
                out = list_links(f, max_bits, shared)
            else:
                out = long_list_links(f, tuple(p for p in rest if p not in pair), max_bits)
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, 0])), pa.array(np.ascontiguousarray(out[:, 1]))], names=["u", "v"])

    long_lists = first.filter("kind = 1").select("u", "v").mapInArrow(again, "k long, fp long")
    second = long_lists.repartition("k").sortWithinPartitions("k").mapInArrow(finer, "u long, v long")
    return first.filter("kind = 0").select("u", "v").unionByName(second)


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, text: str = "text", doc_id: str = "doc_id",
                    split: int = SPLIT) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    Null and empty texts and those without words have fingerprint zero and
    are linked like any other; equal fingerprints are one node, so repeated
    rows cost one posting. component_id is the least id reachable (null ids
    count only where all are null). An empty table gives an empty result."""
    fps = stage(fingerprints(docs.select(col(doc_id).alias("doc_id"), col(text).alias("__text")), shingle, "__text").drop("__text"), "fingerprints")
    owner = _owners(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), max_bits, split)
    least = owner.groupBy("root").agg(F.min("least").alias("component_id"))
    label = owner.join(least, "root").select("fp", "component_id")
    return fps.join(label, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _owners(nodes: DataFrame, max_bits: int, split: int) -> DataFrame:
    """``nodes`` (fp, least) with the root fingerprint of their component."""
    roots = components(links(nodes, max_bits, split), "simhash-components")
    owner = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return stage(owner, "simhash-owners")


def representatives(docs: DataFrame, shingle: int = 3, max_bits: int = 3, text: str = "text", doc_id: str = "doc_id",
                    split: int = SPLIT) -> DataFrame:
    """One whole row of ``docs`` for each group of near duplicates: the one of
    the least id (nulls last), and of several such rows the one of the least
    row hash. A group is known by its root fingerprint, so null ids and rows
    of one id with different texts lose nothing to each other. Rows equal in
    every column meet in one task, where one of them stays."""
    rest = F.to_json(F.struct(*[col(c) for c in docs.columns if c.lower() != text.lower()]))
    keyed = docs.withColumn("__k", F.unhex(F.sha2(F.concat(F.sha2(utf8(text), 256), F.when(col(text).isNull(), "n").otherwise("t"), rest).cast("binary"), 256)))
    fps = stage(fingerprints(keyed.select(col(doc_id).alias("__id"), "__k", col(text).alias("__text")), shingle, "__text").drop("__text"), "fingerprints")
    order = F.struct(F.col("__id").isNull().alias("no_id"), F.col("__id").alias("id"), F.col("__k").alias("k"))
    owner = _owners(fps.groupBy("fp").agg(F.min(order).alias("least")), max_bits, split)
    stay = owner.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.k").alias("__k"))
    return keyed.join(stay, "__k", "left_semi").dropDuplicates(["__k"]).drop("__k")
