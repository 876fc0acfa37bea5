"""Audit of how far the sources of a language differ in their words.

Terms are counted by one CountVectorizer whose terms are qualified by the
language of the document: as a document has one language, its ``minDF`` acts
on each language by itself, as one vectoriser a language would, and the number
of passes doesn't grow with the number of languages. The
sparse document vectors are summed by (language, source), which are the
group vectors; a language's vector is the sum of its groups'.

Shares are integers (billionths, add-two smoothing), so all figures are
exact. Pairs of sources are evaluated on their sparse vectors: a joint term
adds its own divergence; the terms that one or neither source has follow from
histograms of equal counts, since the other side's share is then constant.

The vocabulary passes through the driver and is broadcast, as the vectoriser
does; so it is bounded: beyond ``most_terms`` terms, all languages together,
the same sums come from grouping and joining the terms themselves. No term is
ever cut (each language's vocabulary size is the largest integer).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, prepare, stage

MOST_TERMS, LARGEST, SMOOTHING, SHARE_UNIT, SPLIT, FLUSH, CHUNK, PIECE = 4_000_000, 2**31 - 1, 2, 1_000_000_000, "\x00", 1_000_000, 100_000, 8192
#: A-Z lower-cased; bytes that are no part of a term become blanks.
CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text: runs of letters, A-Z lower-cased."""
    return text.translate(CLEAN).split()


def term_sums(rows: DataFrame, min_docs: int, most_terms: int = MOST_TERMS) -> tuple[DataFrame, DataFrame]:
    """(lang, source, key, n): occurrences in each group of the terms found in
    ``min_docs`` or more documents of the language; and (key, term), what the
    keys stand for. ``rows``: lang, source, text."""
    return _vectorised(rows, min_docs, most_terms) or _joined(bag_of(rows), min_docs)


def bag_of(rows: DataFrame, qualified: bool = False, distinct: bool = False) -> DataFrame:
    """(lang, source, terms) of each row; ``qualified`` by the language, or
    each term once, if asked for."""
    def run(batches):
        for b in batches:
            at, flat, ends = 0, [], [0]
            langs = b.column(0).to_pylist()
            for i, text in enumerate(b.column(2)):
                found = terms(text.as_py())
                found = list(set(found)) if distinct else found
                if qualified:
                    prefix = langs[i].encode() + b"\x00"
                    found = [prefix + t for t in found]
                flat += found
                ends.append(len(flat))
                if len(flat) >= CHUNK or i == b.num_rows - 1:
                    words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.binary()).cast(pa.string()))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, i + 1 - at), b.column(1).slice(at, i + 1 - at), words], names=["lang", "source", "terms"])
                    at, flat, ends = i + 1, [], [0]

    return _texts(rows).mapInArrow(run, "lang string, source string, terms array<string>")


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select("lang", "source", F.col("text").cast("binary").alias("text"))


def term_lists(texts: list[bytes], prefix: bytes) -> pa.ListArray:
    """The terms of each text, in order, behind ``prefix``: the Arrow array of
    all of them is laid out from the bytes at once."""
    clean = np.frombuffer(b" ".join([*texts, b""]).translate(CLEAN), np.uint8)
    inside = clean != 0x20
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    offsets = np.concatenate([[0], np.cumsum(sizes + len(prefix))])
    out = np.empty(offsets[-1], np.uint8)
    for j, x in enumerate(prefix):
        out[offsets[:-1] + j] = x
    out[np.arange(int(sizes.sum())) + len(prefix) * np.repeat(np.arange(1, len(sizes) + 1), sizes)] = clean[inside]
    words = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out))
    ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), words)


def qualified_bags(rows: DataFrame) -> DataFrame:
    """`bag_of` with every occurrence, qualified; rows of a language together."""
    def run(batches):
        for b in batches:
            of: dict[str, list[int]] = {}
            for i, lang in enumerate(b.column(0).to_pylist()):
                of.setdefault(lang, []).append(i)
            texts = b.column(2).to_pylist()
            for lang, at in of.items():
                held, size = [], 0
                for k, i in enumerate(at):
                    held.append(i)
                    size += len(texts[i])
                    if size >= CHUNK * 10 or k == len(at) - 1:
                        lists = term_lists([texts[i] for i in held], lang.encode() + b"\x00")
                        yield pa.RecordBatch.from_arrays([*[b.column(j).take(pa.array(held, pa.int64())) for j in (0, 1)], lists], names=["lang", "source", "terms"])
                        held, size = [], 0

    return _texts(rows).mapInArrow(run, "lang string, source string, terms array<string>")


def _vectorised(rows: DataFrame, min_docs: int, most_terms: int) -> tuple[DataFrame, DataFrame] | None:
    """None if there are more than ``most_terms`` terms: the vectoriser is
    allowed one more, so its cut would show, and is never used."""
    spark = rows.sparkSession
    # which terms are kept depends on documents, not occurrences: the fit sees a document's terms once
    vectoriser = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=min(most_terms + 1, LARGEST))
    model = vectoriser.fit(bag_of(rows, True, distinct=True))
    if len(model.vocabulary) > most_terms:
        return None
    vectors = model.transform(qualified_bags(rows)).select("lang", "source", F.unwrap_udt("vector").alias("v"))
    names = spark.createDataFrame([(i, w.rpartition(SPLIT)[2]) for i, w in enumerate(model.vocabulary)], "key int, term string")
    return _summed(vectors.select("lang", "source", "v.indices", "v.values"), len(model.vocabulary)), names


def _summed(vectors: DataFrame, size: int) -> DataFrame:
    """Sparse vectors (lang, source, indices, values) added up by group:
    (lang, source, key, n). Each task adds up its own first, ``FLUSH`` cells at
    most; sums travel as packed pieces of ``PIECE`` indices, so a group's
    vector is added up in as many tasks as it has pieces."""
    def partial(batches):
        groups: dict[tuple, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        cells = 0

        def compact():
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

        def packed(keys, n):
            names, piece = list(groups), keys // size * (size // PIECE + 1) + keys % size // PIECE
            cuts = np.flatnonzero(np.diff(piece, prepend=-1))
            of = [names[g] for g in keys[cuts] // size]
            ends = [*cuts[1:], len(keys)]
            index = (keys % size).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([g[0] for g in of], pa.string()), pa.array([g[1] for g in of], pa.string()), pa.array(index[cuts] // PIECE, pa.int32()),
                                               pa.array([index[a:z].tobytes() for a, z in zip(cuts, ends, strict=True)], pa.binary()),
                                               pa.array([n[a:z].tobytes() for a, z in zip(cuts, ends, strict=True)], pa.binary())], names=["lang", "source", "piece", "i", "n"])

        for b in batches:
            of = [groups.setdefault(g, len(groups)) for g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            lists = b.column(2)
            codes = np.repeat(np.array(of, np.int64), np.diff(lists.offsets.to_numpy()))
            held.append((codes * size + lists.flatten().to_numpy(), b.column(3).flatten().to_numpy()))
            cells += len(codes)
            if cells >= FLUSH:
                held = [compact()]
                cells = len(held[0][0])
                if cells >= FLUSH // 2:
                    yield packed(*held[0])
                    groups, held, cells = {}, [], 0
        if cells:
            yield packed(*compact())

    def total(batches):
        now, index, counts = None, [], []

        def summed():
            values, at = np.unique(np.concatenate(index), return_inverse=True)
            n = np.zeros(len(values), np.int64)
            np.add.at(n, at, np.concatenate(counts))
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(values), pa.string()), pa.array([now[1]] * len(values), pa.string()), pa.array(values), pa.array(n)], names=["lang", "source", "key", "n"])

        for b in batches:
            for lang, source, piece, i, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if index and (lang, source, piece) != now:
                    yield summed()
                    index, counts = [], []
                now = (lang, source, piece)
                index.append(np.frombuffer(i, np.int32))
                counts.append(np.frombuffer(n, np.int64))
        if index:
            yield summed()

    parts = vectors.mapInArrow(partial, "lang string, source string, piece int, i binary, n binary")
    dealt = parts.repartition("lang", "source", "piece").sortWithinPartitions("lang", "source", "piece")
    return dealt.mapInArrow(total, "lang string, source string, key int, n long")


def _joined(bag: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    def cells(words: Column, in_docs: int) -> DataFrame:
        return bag.select("lang", "source", F.explode(words).alias("term"), F.lit(in_docs).alias("d"))

    both = cells(F.col("terms"), 0).unionAll(cells(F.array_distinct("terms"), 1))
    sums = stage(both.groupBy("lang", "source", "term").agg(F.sum("d").alias("d"), F.sum(1 - F.col("d")).alias("n")), "term-sums")
    kept = sums.groupBy("lang", "term").agg(F.sum("d").alias("d")).filter(F.col("d") >= min_docs).select("lang", "term")
    own = sums.join(kept, ["lang", "term"]).select("lang", "source", F.col("term").alias("key"), "n")
    return own, kept.select(F.col("term").alias("key"), "term").distinct()


def share(n: Column, total: Column, size: Column) -> Column:
    """1 + the smoothed share of a count in billionths, rounded down: in LONG
    where the product fits, else in DECIMAL."""
    whole = total + SMOOTHING * size
    short = F.call_function("div", F.lit(SHARE_UNIT).cast("bigint") * (n + SMOOTHING), whole)
    wide = F.call_function("div", F.lit(SHARE_UNIT).cast("decimal(20,0)") * (n + SMOOTHING).cast("decimal(18,0)"), whole.cast("decimal(20,0)"))
    return F.lit(1).cast("bigint") + F.when(n < 1 << 33, short).otherwise(wide)


def gap(p: Column, q: Column) -> Column:
    """The triangular divergence of two shares, rounded down."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, most_terms: int = MOST_TERMS,
          text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) group.

    ``pair``: the divergence from each other source of the language, largest
    first. ``term``: the ``top`` terms the group has more often than its
    language. Nulls in the three columns count as the empty text (a language
    or source like any other); groups without terms take part; repeated rows
    are documents of their own; ties go by the item's bytes; a language
    without terms gives pairs of value 0; an empty table an empty result.
    Other columns of ``docs`` are ignored."""
    prepare(docs.sparkSession)
    rows = docs.select(*[F.coalesce(col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    sums, names = term_sums(rows, min_docs, most_terms)
    sums = stage(sums, "group-terms")
    whole = sums.groupBy("lang", "key").agg(F.sum("n").alias("n"))
    sizes = whole.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("total"))
    totals = sums.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    zero = F.lit(0).cast("bigint")
    groups = (rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
              .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("n", "v", "total")]))
    groups = stage(groups.withColumn("none", F.when(F.col("v") > 0, share(zero, F.col("n"), F.col("v")))), "groups")
    cells = sums.withColumnRenamed("n", "count").join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("n"), F.col("v")))
    cells = stage(cells.select("lang", "source", "key", "p", "none", "v", "total"), "cells")
    return _pairs(cells.select("lang", "source", "key", "p", "none"), groups).unionByName(_terms(cells, whole, names, top))


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """A pair's sum over all terms is: neither source has any (v times the
    divergence of the two empty shares), corrected by each source's terms as
    if the other lacked them, corrected again by the joint terms."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("none2"))
    bars = cells.groupBy("lang", "source", "p", "none").agg(F.count("*").alias("m"))
    alone = (bars.join(other, "lang").filter(F.col("source") != F.col("item"))
             .groupBy("lang", "source", "item").agg(F.sum(F.col("m") * (gap(F.col("p"), F.col("none2")) - gap(F.col("none"), F.col("none2")))).alias("x")))
    a = cells.alias("a")
    b = cells.select("lang", "key", F.col("source").alias("item"), F.col("p").alias("q"), F.col("none").alias("none2")).alias("b")
    joint = (a.join(b, ["lang", "key"]).filter(F.col("source") < F.col("item"))
             .groupBy("lang", "source", "item").agg(F.sum(gap(F.col("p"), F.col("q")) - gap(F.col("p"), F.col("none2")) - gap(F.col("none"), F.col("q")) + gap(F.col("none"), F.col("none2"))).alias("x")))
    empty = (groups.select("lang", "source", "v", "none").join(other, "lang").filter(F.col("source") != F.col("item"))
             .select("lang", "source", "item", F.coalesce(F.col("v") * gap(F.col("none"), F.col("none2")), F.lit(0).cast("bigint")).alias("x")))

    def turned(df: DataFrame) -> DataFrame:
        return df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "x")

    value = empty.unionByName(alone).unionByName(turned(alone)).unionByName(joint).unionByName(turned(joint)).groupBy("lang", "source", "item").agg(F.sum("x").alias("value"))
    return _ranked(value, "pair", None)


def _terms(cells: DataFrame, whole: DataFrame, names: DataFrame, top: int) -> DataFrame:
    joined = cells.join(whole.withColumnRenamed("n", "n_lang"), ["lang", "key"])
    q = share(F.col("n_lang"), F.col("total"), F.col("v"))
    found = joined.withColumn("q", q).filter(F.col("p") > F.col("q")).select("lang", "source", "key", gap(F.col("p"), F.col("q")).alias("value"))
    return _ranked(found.join(names, "key").select("lang", "source", F.col("term").alias("item"), "value"), "term", top)


def _ranked(rows: DataFrame, part: str, top: int | None) -> DataFrame:
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    out = rows.withColumn("rank", F.row_number().over(by))
    out = out.filter(F.col("rank") <= top) if top else out
    return out.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("bigint").alias("value"), "rank")

