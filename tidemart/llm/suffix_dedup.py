"""Suffix-array dedup: bytes of repeated strings, found by sorted suffixes.

Every string of ``length`` (50) bytes that also starts in a document of a
smaller id is removed, byte by byte. A window's anchor is the place of the
least hash among the 24-byte strings in it, so equal windows have equal
anchors at equal places and only suffixes around equal anchors need sorting:

1. Anchors. Each batch of texts gives its anchors' hashes, packed by bucket;
   a batch that holds one in several documents knows already that it is
   shared, and sends it once, so a very common passage stays small.
2. Suffixes. The shared anchors return to their documents, which cut out the
   text around them. Texts around an anchor that are equal within a batch
   are sent once, for the least id; the others are decided on the spot.
3. Sorting. Per bucket, the suffixes around each anchor are put in order
   deep-shallow: multikey quicksort by eight-byte characters down to a
   shallow depth, then a blind trie for each group that is still together.
   Neighbours with ``length`` common bytes are one string; those of larger
   ids than its least are removed.
4. The decided spans return to the documents.

Text moves twice (steps 2 and 4); everything else is packed arrays. Each
step is written to the shared checkpoint folder before the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, field, prepare, release, stage, utf8

GRAM, PIECE, SHALLOW, LAST = 24, 1 << 16, 16, 2**63 - 1
GROUP_BYTES, BUCKET_BYTES = 64 << 20, 16 << 20
_M = np.uint64(0x9E3779B97F4A7C15)


def _hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place (24 = 16 + 8, by doubling)."""
    h = (data.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    power, eight = int(_M), None
    for n in (1, 2, 4, 8):
        h = h[:-n] * np.uint64(power) + h[n:]
        power = power * power % 2**64
        if n == 4:
            eight = h
    # h: of 16 bytes; power: multiplier for 16 places; its root, for 8
    root = pow(int(_M), 8, 2**64)
    h = h[: len(eight) - 16] * np.uint64(root) + eight[16:]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text number, hash, anchor, first, last): for each run of windows of
    one anchor, the window starts and the anchor's place in its text."""
    out = []
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        if not held:
            return
        data = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
        sizes = np.array([len(x) for _, _, x in held])
        begin = np.cumsum(sizes) - sizes
        h = _hashes(data)
        span = length - GRAM + 1  # grams in a window
        bits = np.uint64(max(1, int(len(h)).bit_length()))
        key = h >> bits << bits | np.arange(len(h), dtype=np.uint64)
        least, have = key, 1
        while have * 2 <= span:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if span > have:
            least = np.minimum(least[: len(least) - (span - have)], least[span - have:])
        at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        part = np.repeat(np.arange(len(held)), sizes)[: len(at)]
        ok = np.arange(len(at)) + length <= (begin + sizes)[part]
        s = np.flatnonzero(ok)
        if not len(s):
            return
        new = np.concatenate([[True], (at[s][1:] != at[s][:-1]) | (part[s][1:] != part[s][:-1])])
        first = s[new]
        last = s[np.concatenate([new[1:], [True]])]
        p = part[first]
        off = np.array([o for _, o, _ in held])[p] - begin[p]
        out.append((np.array([i for i, _, _ in held])[p], h[at[first]], at[first] + off, first + off, last + off))

    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), PIECE):
            x = t[a:a + PIECE + length - 1]
            if len(x) >= length:
                held.append((i, a, x))
                size += len(x)
                if size >= 4 * PIECE:
                    flush()
                    held, size = [], 0
    flush()
    if not out:
        return tuple(np.empty(0, np.uint64 if k == 1 else np.int64) for k in range(5))
    return tuple(np.concatenate([x[k] for x in out]) for k in range(5))


# ------------------------------------------------------- deep-shallow sorting

def suffix_groups(data: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): suffixes in order within each ``group``, and whether
    each has ``depth`` bytes in common with the one before it. Suffixes alone
    in a prefix are left out. data must reach depth bytes beyond each start."""
    order = np.argsort(group, kind="stable")
    group = group[order]
    for d in range(0, SHALLOW, 8):  # multikey quicksort, a character being eight bytes
        if not len(order):
            return order, np.empty(0, bool)
        word = np.zeros(len(order), np.uint64)
        for k in range(8):
            word = word << np.uint64(8) | data[starts[order] + (d + k)]
        o = np.lexsort((word, group))
        order, group, word = order[o], group[o], word[o]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (word[1:] != word[:-1])])
        sizes = np.diff(np.append(np.flatnonzero(new), len(new)))
        group = np.repeat(np.arange(len(sizes)), sizes)
        many = np.repeat(sizes > 1, sizes)
        order, group = order[many], group[many]
    if not len(order):
        return order, np.empty(0, bool)
    sizes = np.diff(np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(group)))
    begin = np.cumsum(sizes) - sizes
    same = np.zeros(len(order), bool)
    two = begin[sizes == 2]  # a blind trie of two is one comparison
    a, b = starts[order[two]], starts[order[two + 1]]
    least = np.zeros(len(two), np.int16)  # first difference of the two
    for d in range(SHALLOW, depth):
        least = np.where(least == 0, data[a + d].astype(np.int16) - data[b + d], least)
    same[two + 1] = least == 0
    turn = two[least > 0]
    order[turn], order[turn + 1] = order[turn + 1], order[turn]
    for g, n in zip(begin[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        mine = order[g:g + n].tolist()
        texts = [data[starts[i] + SHALLOW:starts[i] + depth].tobytes() for i in mine]
        k = g
        for leaf in BlindTrie(texts).leaves():
            for j, x in enumerate(leaf):
                order[k], same[k] = mine[x], j > 0
                k += 1
    return order, same


class BlindTrie:
    """Trie that looks at branching bytes only. A string goes down blindly to
    some leaf, is compared with it once, and branches off where they differ."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.root = texts, [0]  # a leaf: the numbers of equal strings; a branch: (depth, {byte: child})
        for i in range(1, len(texts)):
            self.add(i)

    def add(self, i: int) -> None:
        t, path, node = self.texts[i], [], self.root
        while isinstance(node, tuple):
            path.append(node)
            child = node[1].get(t[node[0]])
            node = child if child is not None else next(iter(node[1].values()))
        other = self.texts[node[0]]
        if t == other:
            node.append(i)
            return
        x = int.from_bytes(t, "big") ^ int.from_bytes(other, "big")
        at = len(t) - (x.bit_length() + 7) // 8  # the first differing byte
        parent = None
        node = self.root
        while isinstance(node, tuple) and node[0] < at:
            parent, node = node, node[1][t[node[0]]]
        if isinstance(node, tuple) and node[0] == at:
            node[1][t[at]] = [i]
            return
        branch = (at, {t[at]: [i], other[at]: node})
        if parent is None:
            self.root = branch
        else:
            parent[1][t[parent[0]]] = branch

    def leaves(self) -> Iterator[list[int]]:
        todo = [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                yield node


# ------------------------------------------------------------------ the steps

def _pack(*arrays: np.ndarray) -> list[bytes]:
    return [zstandard.compress(np.ascontiguousarray(a).tobytes(), 1) for a in arrays]


def _unpack(held: list[tuple], kinds: list) -> tuple[np.ndarray, ...]:
    """The arrays of packed rows, joined column by column."""
    return tuple(np.concatenate([np.frombuffer(zstandard.decompress(x[k]), t) for x in held]) if held else np.empty(0, t) for k, t in enumerate(kinds))


def _by(key: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(value, places) of each value of a small key."""
    order = np.argsort(key, kind="stable")
    bounds = np.searchsorted(key[order], np.arange(n + 1))
    for k in range(n):
        if bounds[k] < bounds[k + 1]:
            yield k, order[bounds[k]:bounds[k + 1]]


def _doc_group(ids: np.ndarray, groups: int) -> np.ndarray:
    return np.mod(ids, groups)


def _row_hash(ids: np.ndarray, ths: np.ndarray) -> np.ndarray:
    return (ids.view(np.uint64) * _M) ^ (ths.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _batch(names: list[str], kinds: list, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


_SHARED = (["bucket", "kind", "a", "b", "c", "d"], [pa.int64(), pa.int32(), *[pa.binary()] * 4])
_LISTS = (["g", "docs", "ths", "hs"], [pa.int64(), *[pa.binary()] * 3])
ROWS, HELD = 1 << 16, 1 << 20  # rows sorted at once (their number is packed in 16 bits); entries held for packing


def _ordered(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(ids, text hashes, texts) of slices of the batches, in order of id."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            ids, ths = part.column(first).to_numpy(), part.column(first + 1).to_numpy()
            o = np.lexsort((ths, ids))
            texts = part.column(first + 2).to_pylist()
            yield ids[o], ths[o], [texts[i] for i in o.tolist()]


class Packer:
    """Entries by group of documents, packed into rows when many are held."""

    def __init__(self, groups: int, names: list[str], kinds: list):
        self.groups, self.names, self.kinds, self.held, self.size = groups, names, kinds, [], 0

    def add(self, docs: np.ndarray, *rest: np.ndarray) -> None:
        self.held.append((docs, *rest))
        self.size += len(docs)

    def rows(self) -> list[tuple]:
        if not self.size:
            return []
        arrays = [np.concatenate([x[k] for x in self.held]) for k in range(len(self.held[0]))]
        self.held, self.size = [], 0
        order = np.argsort(arrays[0], kind="stable")
        arrays = [a[order] for a in arrays]
        return [(g, *_pack(*[a[o] for a in arrays])) for g, o in _by(_doc_group(arrays[0], self.groups), self.groups)]

    def batches(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.size >= HELD or last:
            if rows := self.rows():
                yield _batch(self.names, self.kinds, rows)


def _shared_anchors(docs: DataFrame, length: int, buckets: int, groups: int) -> DataFrame:
    """(g, docs, ths, hs): anchors found in several documents, by group of
    documents. Their hashes have 48 bits here; the sort decides what is equal."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ths, texts in _ordered(batches, 0):
            text, h, *_ = anchors(texts, length)
            if not len(h):
                continue
            key = np.sort(h >> np.uint64(16) << np.uint64(16) | text.astype(np.uint64))
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
            h, text = key >> np.uint64(16), (key & np.uint64(ROWS - 1)).astype(np.int64)
            doc = ids[text]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            first = np.flatnonzero(new)
            sizes = np.diff(np.append(first, len(h)))
            known = np.repeat(doc[first] != doc[first + sizes - 1], sizes)
            # of anchors known to be shared, one entry is enough for the other batches
            entry = np.flatnonzero(~known | new)
            entry = entry[np.argsort(text[entry].astype(np.uint16), kind="stable")]
            rows = []
            for k, at in _by((h[entry] % np.uint64(buckets)).astype(np.int64), buckets):
                at = entry[at]
                rows.append((k, 0, *_pack(h[at], np.diff(doc[at], prepend=0), ths[text[at]], known[at].astype(np.uint8))))
            told = Packer(groups, *_LISTS)
            told.add(doc[known], ths[text[known]], h[known])
            yield _batch(*_SHARED, rows + [(g, 1, *x, b"") for g, *x in told.rows()])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, told = None, [], Packer(groups, *_LISTS)

        def close():
            h, _, th, known = _unpack(held, [np.uint64, np.int64, np.int64, np.uint8])
            d = np.concatenate([np.cumsum(np.frombuffer(zstandard.decompress(x[1]), np.int64)) for x in held])
            o = np.argsort(h)
            h, d, th, known = h[o], d[o], th[o], known[o]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            sizes = np.diff(np.append(first, len(h)))
            # entries of one id alone share nothing
            several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
            tell = np.repeat(several, sizes) & (known == 0)
            told.add(d[tell], th[tell], h[tell])

        for batch in batches:
            done = []
            for bucket, kind, *x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 1:
                    done.append((bucket, *x[:3]))
                    continue
                if bucket != now and held:
                    close()
                    held = []
                now = bucket
                held.append(x)
            if done:
                yield _batch(*_LISTS, done)
            yield from told.batches()
        if held:
            close()
        yield from told.batches(last=True)

    rows = docs.select("id", "th", "b").mapInArrow(gather, "bucket long, kind int, a binary, b binary, c binary, d binary")
    return rows.repartition("bucket").sortWithinPartitions("kind", "bucket").mapInArrow(match, "g long, docs binary, ths binary, hs binary")


def _with_lists(docs: DataFrame, lists: DataFrame, groups: int) -> DataFrame:
    """Rows of ``lists`` (g and binary columns) and documents, dealt by group
    of documents, a group's lists before its documents."""
    extra = [c for c in lists.columns if c != "g"]
    left = lists.select("g", F.lit(0).alias("kind"), *[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns], *extra)
    right = docs.select(F.pmod("id", F.lit(groups)).alias("g"), F.lit(1).alias("kind"), *docs.columns, *[F.lit(None).cast("binary").alias(c) for c in extra])
    return left.unionByName(right).repartition("g").sortWithinPartitions("g", "kind")


def _streamed(batches: Iterator[pa.RecordBatch], kinds: list, lists: int):
    """(documents of a batch as a RecordBatch, the lists of their group)."""
    now, parts, ready = None, [], None
    for b in batches:
        g, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = np.flatnonzero((g[1:] != g[:-1]) | (kind[1:] != kind[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(g)], strict=True):
            if lo == hi:
                continue
            part = b.slice(lo, hi - lo)
            if g[lo] != now:
                now, parts, ready = g[lo], [], None
            if kind[lo] == 0:
                parts += zip(*(part.column(part.num_columns - lists + k).to_pylist() for k in range(lists)), strict=True)
            else:
                if ready is None:
                    ready = _unpack(parts, kinds)
                    o = np.lexsort(tuple(reversed(ready)))
                    ready, parts = tuple(x[o] for x in ready), []
                yield part, ready


_CUT = (["bucket", "kind", "h", "doc", "th", "lead", "n", "ctx", "starts"],
        [pa.int64(), pa.int32(), *[pa.binary()] * 7])
_SPANS = (["g", "docs", "ths", "starts", "ends"], [pa.int64(), *[pa.binary()] * 4])


def _texts(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The texts at ``starts`` as rows of bytes, with zeros after their ends."""
    wide = -(-int(sizes.max()) // 8) * 8
    rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data + bytes(wide), np.uint8), wide)[starts]
    rows[np.arange(wide) >= sizes[:, None]] = 0
    return rows


def _equal(cut: np.ndarray, lead: np.ndarray, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): rows with equal texts and anchors at equal places stand
    together, by id; new marks the first of each group. A hash brings them
    together, the bytes decide."""
    key = h + lead.astype(np.uint64)
    for word in cut.view(np.uint64).T:
        key = (key ^ word) * _M
        key ^= key >> np.uint64(32)
    o = np.lexsort((doc, key))
    new = np.concatenate([[True], (key[o[1:]] != key[o[:-1]]) | (lead[o[1:]] != lead[o[:-1]]) | (cut[o[1:]] != cut[o[:-1]]).any(1)])
    return o, new


def _suffixes(docs: DataFrame, lists: DataFrame, length: int, buckets: int, groups: int) -> DataFrame:
    """The texts around shared anchors, packed by bucket (kind 0), and spans
    that a batch could decide itself (kind 1: bucket is the group; h, doc, th
    and lead are its documents, their text hashes, starts and ends)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = Packer(groups, *_SPANS)
        for part, (ld, lt, lh) in _streamed(batches, [np.int64, np.int64, np.uint64], 3):
            if not len(ld):
                continue
            known = np.sort(lh ^ _row_hash(ld, lt))  # only a filter: what is cut out is compared
            for ids, ths, texts in _ordered([part], 2):
                text, h, p, first, last = anchors(texts, length)
                if not len(h):
                    continue
                key = (h >> np.uint64(16)) ^ _row_hash(ids, ths)[text]
                at = np.flatnonzero(known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key)
                if not len(at):
                    continue
                begin = np.cumsum([0] + [len(t) for t in texts])
                text, h, first, lead, n = text[at], h[at], first[at], (p - first)[at], (last - first)[at] + 1
                cut = _texts(b"".join(texts), begin[text] + first, n + length - 1)
                doc = ids[text]
                # texts equal around an anchor: those of larger ids than the least are decided
                o, new = _equal(cut, lead, doc, h)
                least = np.repeat(doc[o[new]], np.diff(np.append(np.flatnonzero(new), len(o))))
                gone = o[doc[o] > least]
                told.add(doc[gone], ths[text[gone]], first[gone], first[gone] + n[gone] + length - 1)
                o = np.sort(o[doc[o] == least])  # back in order of the documents
                rows = []
                for k, some in _by((h[o] % np.uint64(buckets)).astype(np.int64), buckets):
                    some = o[some]
                    whole = np.arange(cut.shape[1]) < (n[some] + length - 1)[:, None]
                    rows.append((k, 0, *_pack(h[some], doc[some], ths[text[some]], lead[some].astype(np.uint8), n[some].astype(np.uint8), cut[some][whole], first[some])))
                rows += [(g, 1, *x, *[b""] * 3) for g, *x in (told.rows() if told.size >= HELD else ())]
                yield _batch(*_CUT, rows)
        if rows := told.rows():
            yield _batch(*_CUT, [(g, 1, *x, *[b""] * 3) for g, *x in rows])

    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("kind", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in _CUT[0][2:]]])
    return _with_lists(docs.select("id", "th", "b"), lists, groups).mapInArrow(run, schema)


def _resolved(cut: DataFrame, length: int, groups: int) -> DataFrame:
    """(g, docs, starts, ends): removed spans, packed by group of documents."""
    def close(held: list[tuple], told: Packer) -> None:
        h, d, th, lead, n, data, starts = _unpack(held, [np.uint64, np.int64, np.int64, np.uint8, np.uint8, np.uint8, np.int64])
        size = n.astype(np.int64) + length - 1
        base = np.cumsum(size) - size
        cut = _texts(data.tobytes(), base, size)

        def decide(rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
            """Remove the windows first..last (within the row's text)."""
            told.add(d[rows], th[rows], starts[rows] + first, starts[rows] + last + length)

        # equal texts around an anchor: all but those of the least id go
        o, new = _equal(cut, lead, d, h)
        least = np.repeat(d[o[new]], np.diff(np.append(np.flatnonzero(new), len(o))))
        gone = o[d[o] > least]
        decide(gone, np.zeros(len(gone), np.int64), n[gone].astype(np.int64) - 1)
        # the rest: sort the suffixes around anchors that several rows hold
        rows = o[d[o] == least]
        _, number, times = np.unique(h[rows], return_inverse=True, return_counts=True)
        rows, number = rows[times[number] > 1], number[times[number] > 1]
        if len(rows):
            c = n[rows].astype(np.int64)
            row = np.repeat(np.arange(len(rows)), c)
            j = np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)
            group = number[row].astype(np.int64) * 256 + (lead[rows][row].astype(np.int64) - j)
            order, same = suffix_groups(data, base[rows][row] + j, group, length)
            if len(order):
                doc = d[rows][row[order]]
                first = np.flatnonzero(~same)
                sizes = np.diff(np.append(first, len(order)))
                later = doc > np.repeat(np.minimum.reduceat(doc, first), sizes)
                w = np.sort(order[later])  # windows are numbered by row, then place
                if len(w):
                    new = np.concatenate([[True], (np.diff(w) != 1) | (row[w[1:]] != row[w[:-1]])])
                    end = np.concatenate([new[1:], [True]])
                    decide(rows[row[w[new]]], j[w[new]], j[w[end]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, told = None, [], Packer(groups, *_SPANS)
        for b in batches:
            done = []
            for bucket, kind, *x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 1:
                    done.append((bucket, *x[:4]))
                    continue
                if bucket != now and held:
                    close(held, told)
                    held = []
                now = bucket
                held.append(x)
            if done:
                yield _batch(*_SPANS, done)
            yield from told.batches()
        if held:
            close(held, told)
        yield from told.batches(last=True)

    dealt = cut.repartition("bucket").sortWithinPartitions("kind", "bucket")
    return dealt.mapInArrow(run, "g long, docs binary, ths binary, starts binary, ends binary")


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def remove_repeats(docs: DataFrame, length: int = 50, text: str = "text", doc_id: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, spans) of each row: the bytes left,
    and the maximal removed runs as [start, end) byte offsets.

    Texts are UTF-8 bytes, whole; matches never cross documents; null counts
    as empty and nothing is removed from texts under ``length`` bytes. Rows of
    one id don't remove each other's strings (each row has a number of its
    own); rows without an id likewise, and they count as larger than any id.
    ``buckets`` sets how finely anchors are dealt (unless given, one for each
    ``BUCKET_BYTES`` of texts, at least twice the session's shuffle
    partitions). An empty table gives an empty result."""
    if length < GRAM + 1 or length > GRAM + 127:
        raise ValueError(f"length must be between {GRAM + 1} and {GRAM + 127}")
    spark = docs.sparkSession
    prepare(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = col(doc_id).cast("long")
    size, nulls, first, last = docs.agg(F.coalesce(F.sum(F.octet_length(utf8(text))), F.lit(0)), F.count_if(key.isNull()), F.min(key), F.max(key)).first()
    groups = _prime(max(2, partitions, size // GROUP_BYTES))
    buckets = buckets or max(2 * partitions, size // BUCKET_BYTES)
    # null ids come after all others, so those move down by one if the largest is taken
    order = key - 1 if nulls and last == LAST and first > -LAST - 1 else key
    base = docs.select(col(doc_id).alias("doc_id"), F.coalesce(order, F.lit(LAST)).alias("id"), F.lit(0).cast("long").alias("th"), utf8(text).alias("b"))
    if docs.groupBy(col(doc_id)).count().filter("count > 1").limit(1).count():
        # rows of one id are told apart by a number each, which a written table keeps
        base = stage(base.withColumn("th", F.monotonically_increasing_id()), "suffix-rows")
    lists = stage(_shared_anchors(base, length, buckets, groups), "suffix-anchors")
    cut = stage(_suffixes(base, lists, length, buckets, groups), "suffix-texts")
    release(lists)
    found = stage(_resolved(cut, length, groups), "suffix-spans")
    release(cut)
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = T.StructType([base.schema["doc_id"], *T._parse_datatype_string("kept binary, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (ld, lt, la, lz) in _streamed(batches, [np.int64] * 4, 4):
            ids, ths, texts = part.column(3).to_numpy(), part.column(4).to_pylist(), part.column(5).to_pylist()
            kept, n, removed, spans = [], [], [], []
            lo, hi = np.searchsorted(ld, ids), np.searchsorted(ld, ids, side="right")
            for t, th, a, z in zip(texts, ths, lo.tolist(), hi.tolist(), strict=True):
                own: list[list[int]] = []
                a, z = (a + int(np.searchsorted(lt[a:z], th, side)) for side in ("left", "right"))
                for s, e in zip(la[a:z].tolist(), lz[a:z].tolist(), strict=True):
                    if own and s <= own[-1][1]:
                        own[-1][1] = max(e, own[-1][1])
                    else:
                        own.append([s, e])
                at, rest = 0, []
                for s, e in own:
                    rest.append(t[at:s])
                    at = e
                rest.append(t[at:])
                kept.append(b"".join(rest))
                n.append(len(t))
                removed.append(sum(e - s for s, e in own))
                spans.append([{"start": s, "end": e} for s, e in own])
            yield pa.RecordBatch.from_arrays([part.column(2), pa.array(kept, pa.binary()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kinds)], names=schema.names)

    return _with_lists(base, found, groups).mapInArrow(run, schema)
