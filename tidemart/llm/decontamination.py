"""Benchmark decontamination on a distributed positional inverted index.

The index is sharded by document and transient: a segment (the documents of
one Arrow batch) holds in memory, for each term of the test phrases at hand,
the posting list of its word positions, and goes with its batch; nothing of it
is stored, and each run and chunk reads the texts and indexes them anew. A
phrase is looked up from its rarest term: that list, shifted by the term's
place in the phrase, is intersected with the shifted lists of the other
terms, rarest first. Proximity matching (``slop`` > 0) lets neighbouring
phrase words stand up to ``slop`` words further apart, in order. Segments
never meet in a shuffle. The test phrases are broadcast in chunks of items
of bounded size; of several chunks, each is one written pass over the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, col, field, prepare, release, stage, utf8

CHUNK_BYTES, PIECE = 8 << 20, 1 << 22
_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes(c if c in _WORD else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Words of a text: runs of digits, letters a-z and non-ASCII bytes."""
    return text.translate(_TABLE).split()


def windows(item: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    """All runs of ``size`` words; a shorter item is one run, an empty none."""
    if not item:
        return []
    return [tuple(item[i:i + size]) for i in range(max(1, len(item) - size + 1))]


class Phrases:
    """Distinct test phrases as term numbers, with the items they are from."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        self.terms: dict[bytes, int] = {}
        of: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            for w in windows(words(text), size):
                of.setdefault(tuple(self.terms.setdefault(x, len(self.terms)) for x in w), set()).add(item)
        self.phrases = [(p, sorted(i)) for p, i in of.items()]


class Segment:
    """Positional index of some documents. Positions run through all of them
    with a gap between two, so no phrase reaches from one to the next."""

    def __init__(self, texts: list[bytes], terms: dict[bytes, int], gap: int):
        get, parts, lengths = terms.get, [], []
        for t in texts:
            ids = _term_ids(t, get)
            parts += [ids, np.full(gap, -1, np.int32)]
            lengths.append(len(ids))
        self.lengths = np.array(lengths, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + gap)])[:-1]
        ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
        at = np.flatnonzero(ids >= 0)
        order = np.argsort(ids[at], kind="stable")
        self.positions = at[order]
        self.bounds = np.searchsorted(ids[at][order], np.arange(len(terms) + 1))

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.bounds[term]:self.bounds[term + 1]]

    def phrase(self, p: tuple[int, ...]) -> np.ndarray:
        """First positions of the phrase's exact occurrences."""
        by = sorted(range(len(p)), key=lambda k: self.bounds[p[k] + 1] - self.bounds[p[k]])
        found = self.postings(p[by[0]]) - by[0]
        for k in by[1:]:
            if not len(found):
                break
            found = found[_member(found + k, self.postings(p[k]))]
        return found

    def near(self, p: tuple[int, ...], slop: int) -> list[np.ndarray]:
        """Positions of the phrase's words in its proximity occurrences."""
        rare = min((self.postings(t) for t in p), key=len)
        reach = (len(p) - 1) * (1 + slop)
        if not len(rare):
            return []
        steps = []
        for k, t in enumerate(p):
            at = self.postings(t)
            i = np.searchsorted(rare, at)  # only what lies within reach of the rarest word
            d = np.minimum(np.abs(rare[np.minimum(i, len(rare) - 1)] - at), np.abs(rare[np.maximum(i - 1, 0)] - at))
            at = at[d <= reach]
            if k and len(at):
                j = np.searchsorted(steps[-1], at) - 1  # the last place of the word before it
                at = at[(j >= 0) & (at - steps[-1][np.maximum(j, 0)] <= 1 + slop)] if len(steps[-1]) else at[:0]
            steps.append(at)
        for k in range(len(p) - 2, -1, -1):  # and back: only places that some occurrence goes on from
            j = np.searchsorted(steps[k + 1], steps[k], side="right")
            ok = (j < len(steps[k + 1]))
            if len(steps[k + 1]):
                ok &= steps[k + 1][np.minimum(j, len(steps[k + 1]) - 1)] - steps[k] <= 1 + slop
            steps[k] = steps[k][ok]
        return steps if len(steps[-1]) else []


def _member(x: np.ndarray, sorted_list: np.ndarray) -> np.ndarray:
    if not len(sorted_list):
        return np.zeros(len(x), bool)
    i = np.searchsorted(sorted_list, x)
    return sorted_list[np.minimum(i, len(sorted_list) - 1)] == x


def _term_ids(text: bytes, get) -> np.ndarray:
    """Term number of each word (-1: not a test term), piece by piece."""
    out, at = [], 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):  # a piece ends after a byte that is in no word, or with the text
            while end < len(text) and _TABLE[text[end - 1]] != 0x20:
                end += 1
        ws = words(text[at:end])
        out.append(np.fromiter((get(w, -1) for w in ws), np.int32, len(ws)))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.int32)


def match(segment: Segment, phrases: Phrases, slop: int = 0) -> tuple[np.ndarray, list[set]]:
    """(marked positions' sorted starts and ends by document, items by document)."""
    n = len(segment.lengths)
    items: list[set] = [set() for _ in range(n)]
    begin, end = [], []
    for p, of in phrases.phrases:
        if slop:
            steps = segment.near(p, slop)
            first = np.concatenate(steps) if steps else np.empty(0, np.int64)
            length = 1
        else:
            first, length = segment.phrase(p), len(p)
        if len(first):
            begin.append(first)
            end.append(first + length)
            for d in np.unique(np.searchsorted(segment.starts, first, side="right") - 1):
                items[d].update(of)
    if not begin:
        return np.empty((0, 2), np.int64), items
    b, e = np.concatenate(begin), np.concatenate(end)
    order = np.argsort(b, kind="stable")
    b, top = b[order], np.maximum.accumulate(e[order])
    new = np.concatenate([[True], b[1:] > top[:-1]])
    return np.stack([b[new], top[np.concatenate([new[1:], [True]])]], 1), items


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 0, text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` with n_words, hit_spans (maximal runs of hit words: first word
    from 0, end) and items (ids of items with occurring windows, sorted).

    Null texts have no words. Items of null id or without words take no part;
    rows of one id are one item. ``slop`` > 0: a window also occurs with up to
    that many other words between neighbours; then only its words are hit.
    Texts of any length are read whole; each row is a document, also one that
    repeats; without items nothing is hit; an empty table gives an empty result.

    Items go in chunks of about ``chunk_bytes``, each broadcast by itself. Of
    several chunks, each is a pass written to the shared folder before the
    next is read, so the driver and the tasks hold one chunk at a time."""
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    given = items.filter(col(item_id).isNotNull()).select(col(item_id).cast("string").alias("i"), utf8(item_text).alias("t"))
    total = given.agg(F.sum(F.length("t") + F.length("i"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    fields = [field("n_words", "bigint"), field("hit_spans", "array<struct<start:bigint,end:bigint>>"), field("items", "array<string>")]
    out = docs.withColumns({"hit_spans": F.lit(None).cast(fields[1].dataType), "items": F.lit(None).cast(fields[2].dataType)})
    before = None
    for k in range(chunks):
        last = k == chunks - 1
        part = given if chunks == 1 else given.filter(F.pmod(F.xxhash64("i", "t"), F.lit(chunks)) == k)
        rows = [(r.i, bytes(r.t)) for r in part.toLocalIterator()]
        if not rows and not (last and before is None):
            continue
        held = spark.sparkContext.broadcast(rows)

        def factory(held=held):
            phrases = Phrases(held.value, size)

            def f(ts, spans, found):
                texts = ts.to_pylist()
                seg = Segment(texts, phrases.terms, gap=(size + 1) * (1 + slop) + 1)
                marked, new = match(seg, phrases, slop)
                doc = np.searchsorted(seg.starts, marked[:, 0], side="right") - 1 if len(marked) else marked[:, 0]
                own: list[list] = [[(s["start"], s["end"]) for s in x or ()] for x in spans.to_pylist()]
                for d, (a, b) in zip(doc.tolist(), marked.tolist(), strict=True):
                    own[d].append((a - int(seg.starts[d]), b - int(seg.starts[d])))
                own = [_merged(x) for x in own]
                ids = [sorted(n.union(o or ())) for n, o in zip(new, found.to_pylist(), strict=True)]
                return [pa.array(seg.lengths), pa.array([[{"start": a, "end": b} for a, b in x] for x in own], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(ids, pa.list_(pa.string()))]
            return f

        out = append(out, [utf8(text), F.col("hit_spans"), F.col("items")], fields, factory)
        if chunks > 1:
            out = stage(out, "decontamination-pass")
            held.destroy()
            if before is not None:
                release(before)
            before = out
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
