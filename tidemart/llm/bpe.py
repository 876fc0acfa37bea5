"""BPE encoding and decoding by per-prefix dynamic programming.

For a text piece, ``last[i]`` is the last token of the encoding of its first
i bytes, which is unique. An automaton over the vocabulary (a trie whose
suffix links give, at each byte, all tokens that end there) lists the
candidates; a candidate t is that token when it may follow the last token of
the prefix before it, i.e. when merging would keep the pair as it is. The
back-pointers from the piece's end give the exact ids, in time linear in the
piece's length, however long it is.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import append, cached, col, field, prepare, utf8

#: How the byte-level vocabularies cut a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE, LONGEST, PAIRS = 200_000, 48, 500_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: the
    printable Latin-1 characters for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in own}
    out.update({chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in own)})
    return out


class Pieces(dict):
    """Ids of pieces met before, as native 32-bit integers in bytes. Two
    generations of bounded size: what was met lately survives a clearing."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.old = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = array("I", self.vocabulary.piece(piece.encode())).tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got


class Vocabulary:
    """A byte-level BPE vocabulary: tokens, merge ranks, added tokens."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        letters = byte_letters()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in self.added}
        ids = {b: i for i, b in self.bytes.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = (bytes(letters[c] for c in x) for x in (m.split(" ") if isinstance(m, str) else m))
            pair, token = (ids[a], ids[b]), ids[a + b]
            self.merged.setdefault(pair, rank)
            self.made.setdefault(token, (rank, *pair))
        self.bytes.update({i: c.encode() for c, i in self.added.items()})
        self.ids = ids
        self.split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.find = regex.compile(PIECES).findall
        self.automaton = ahocorasick.Automaton()
        for b, i in ids.items():
            if len(b) == 1 or i in self.made and self._stable(*self.made[i]):
                self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.size = {i: len(b) for i, b in self.bytes.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces = Pieces(self)

    def _stable(self, rank: int, a: int, b: int) -> bool:
        """Whether a token's own parts meet by its merge: else no text gives it."""
        return self._boundary(a, b, rank)

    def _boundary(self, a: int, b: int, limit: int | None = None) -> bool:
        """Whether merging leaves the boundary between tokens a and b alone
        (till rank ``limit``). Merges are undone from the latest back, on the
        side where it is; of the same rank, the right one was made later. An
        undone state existed until the merge that was undone; a pair across
        the boundary that ranks before it would have been merged instead."""
        merged, made, top = self.merged, self.made, limit if limit is not None else 1 << 60
        while True:
            if merged.get((a, b), 1 << 60) < top:
                return False
            ra, rb = made[a][0] if a in made else -1, made[b][0] if b in made else -1
            if ra < 0 and rb < 0:
                return True
            if rb >= ra:
                top, b = rb + 1, made[b][1]
            else:
                top, a = ra, made[a][2]

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece, by the dynamic programme over its prefixes."""
        last, size, pairs = [-1] * (len(data) + 1), self.size, self.pairs
        for at, t in self.automaton.iter(data.decode("latin-1")):
            if last[at + 1] >= 0:
                continue
            start = at + 1 - size[t]
            if start:
                before = last[start]
                if before < 0:
                    continue
                ok = pairs.get((before, t))
                if ok is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    ok = pairs[before, t] = self._boundary(before, t)
                if not ok:
                    continue
            last[at + 1] = t
        out, at = [], len(data)
        while at:
            t = last[at]
            out.append(t)
            at -= size[t]
        out.reverse()
        return out

    def encode(self, text: str) -> array:
        """Ids of a whole text; added tokens' strings in it are their ids."""
        out = array("I")
        for x in self.split.split(text) if self.split else [text]:
            if x in self.added:
                out.append(self.added[x])
            elif x:
                out.frombytes(b"".join(map(self.pieces.__getitem__, self.find(x))))
        return out

    def decode(self, ids) -> str:
        """The text of ids, added tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _vocabulary(file: bytes) -> Vocabulary:
    return cached(("bpe", hashlib.sha256(file).hexdigest()), lambda: Vocabulary(file))


def encode(docs: DataFrame, vocabulary: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256 (and, if asked
    for, the token ids as ``ids``) for each row's whole text.

    ``vocabulary`` is the path of a byte-level BPE file; the driver reads it
    and broadcasts it (a vocabulary is a few MB, whatever the corpus). Null
    and empty texts have no ids; texts of any length are encoded whole; each
    row by itself, also one that repeats; an empty table gives an empty result."""
    prepare(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = [field("n_tokens", "bigint"), field("ids_sha256", "string"), field("decoded_sha256", "string")] + [field("ids", "array<int>")] * keep_ids

    def factory():
        v = _vocabulary(held.value)

        def f(ts):
            n, hashes, decoded, all_ids = [], [], [], []
            for t in ts.to_pylist():
                ids = v.encode(t.decode("utf-8", "replace"))
                n.append(len(ids))
                hashes.append(hashlib.sha256(_little(ids)).hexdigest())
                decoded.append(hashlib.sha256(v.decode(ids).encode()).hexdigest())
                if keep_ids:
                    all_ids.append(ids)
            out = [pa.array(n, pa.int64()), pa.array(hashes), pa.array(decoded)]
            if keep_ids:
                flat = array("i")
                ends = [0]
                for ids in all_ids:
                    flat.frombytes(ids.tobytes())
                    ends.append(len(flat))
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat.tobytes())])))
            return out
        return f

    return append(docs, [utf8(text)], fields, factory)


def _little(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def decode(rows: DataFrame, vocabulary: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with the text of the token ids in column ``ids``. A null list
    gives a null text, an empty one the empty text; an id that the vocabulary
    lacks (or null) becomes U+FFFD, as bytes do that aren't UTF-8. Each row by
    itself; an empty table gives an empty result."""
    prepare(rows.sparkSession)
    with open(vocabulary, "rb") as f:
        held = rows.sparkSession.sparkContext.broadcast(f.read())

    def factory():
        v = _vocabulary(held.value)
        unknown = "\ufffd".encode()
        return lambda xs: [pa.array([None if x is None else b"".join(v.bytes.get(i, unknown) for i in x).decode("utf-8", "replace") for x in xs.to_pylist()], pa.string())]

    return append(rows, [col(ids)], [field(text, "string")], factory)
