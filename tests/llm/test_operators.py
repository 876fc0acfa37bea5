"""Each operator against a brute-force version on small frames that hold
nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemart.llm import ann, bpe, chat, components, decontamination, divergence, katz, language_id, licenses, line_dedup, resampling, simhash, suffix_dedup, toxicity
from tidemart.llm.queries import VOCABULARY

WORDS = ["alpha", "Beta", "gamma", "DELTA", "eps", "zeta", "éta", "Öl", "x1", "the", "of", "日本", "ß"]


def texts(seed: int, n: int = 40) -> list:
    rng = random.Random(seed)
    out = [None, "", " ", "\n\n", "a", "\x00\x01", "🙂" * 30, "word " * 3000, "x" * 5000]
    for _ in range(n):
        out.append("".join(rng.choice(WORDS) + rng.choice([" ", " ", "  ", ", ", ".\n", "\t"]) for _ in range(rng.randint(1, 80))))
    return out + out[-5:] + [t[:-7] + "tail." for t in out[-3:]]


def frame(spark, rows, clash=()):
    """Documents with ids that aren't in order, one of them repeated, in several partitions."""
    ids = [(7 * i) % 1009 for i in range(len(rows))]
    df = spark.createDataFrame(list(zip(ids, rows, strict=True)) + [(ids[-1], rows[-1])], "doc_id long, text string").repartition(3)
    for c in clash:
        df = df.withColumn(c, F.lit("kept?"))
    return df, list(zip(ids, rows, strict=True)) + [(ids[-1], rows[-1])]


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


# ------------------------------------------------------------------------ bpe

def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer
    own, lib = bpe.Vocabulary(open(VOCABULARY, "rb").read()), Tokenizer.from_file(VOCABULARY)
    rng = random.Random(5)
    cases = [t or "" for t in texts(1)] + ["<|endoftext|>a<|endoftext|><|endoftext|> ", "don't I'll 'S", "a" * 9001, " " * 999, "\r\n 　x", "ab" * 2000 + "é" * 500]
    cases += ["".join(rng.choices("aehnrst o'0!é\n", k=rng.randint(1, 60))) for _ in range(1500)]
    for t in cases:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert list(own.encode(t)) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False) == t


def test_bpe_pieces_survive_a_full_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    v, w = (bpe.Vocabulary(open(VOCABULARY, "rb").read()) for _ in range(2))
    t = " ".join(t or "" for t in texts(2))
    assert v.encode(t) == v.encode(t) == w.encode(t)
    assert v.decode(v.encode(t)) == t


def test_bpe_frame(spark):
    df, rows = frame(spark, texts(3), ("n_tokens", "IDS", "extra"))
    out = bpe.encode(df, VOCABULARY, keep_ids=True)
    assert "extra" in out.columns and out.columns.count("n_tokens") == 1
    got = bpe.decode(out, VOCABULARY, text="again").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.again == (r.text or "") and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode(empty(spark), VOCABULARY).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [64, 10**9, None, -1])], "k int, ids array<int>")
    one = bpe.Vocabulary(open(VOCABULARY, "rb").read()).decode([64])
    assert [r.text for r in bpe.decode(odd, VOCABULARY).orderBy("k").collect()] == [None, "", one + "\ufffd" * 3]


# ---------------------------------------------------------------- language ID

def test_language_id(spark):
    rng = random.Random(4)
    syllables = {"aa": ["ba", "ka", "da"], "bb": ["re", "ti", "no"], "cc": ["ñu", "çé", "lö"]}
    rows = [(i, " ".join("".join(rng.choices(syllables[g], k=3)) for _ in range(rng.randint(3, 30))), g) for i, g in enumerate(rng.choices(sorted(syllables), k=400))]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !?", None), (1003, "baka", None), (None, "tino reti", "bb"), (1004, "ba" * 300_000, "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in language_id.fit_and_identify(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == g for i, t, g in rows[:400])
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(400))
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0
    assert got[1003].lang_pred == "aa" and got[1004].lang_pred == "aa" and got[None].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got.values())
    # labels of held-out rows are not learned from, nor any label at prediction
    other = df.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "zz").otherwise(F.col("lang")))
    assert {r.doc_id: (r.lang_pred, r.score) for r in language_id.fit_and_identify(other).collect()} == {k: (r.lang_pred, r.score) for k, r in got.items()}
    assert language_id.fit_and_identify(empty(spark)).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.fit_and_identify(unlabelled).collect()} == {"und"}


def test_language_id_batches_do_not_matter():
    m = language_id.Model(["a", "b"], np.random.default_rng(1).integers(0, 9, (language_id.BUCKETS, 2)).astype(float), np.array([1.0, 2.0]))
    many = [t for t in texts(6) if t]
    one = [m.predict([t]) for t in many]
    lang, score = m.predict(many)
    assert lang == [x[0][0] for x in one] and np.allclose(score, [x[1][0] for x in one])
    for t in many:  # every n-gram once, also where a text is in pieces
        whole = np.concatenate(language_id.buckets([(p, s) for p, s in language_id.pieces(language_id.code_points(t))]))
        cut = np.concatenate([b for p, s in language_id.pieces(language_id.code_points(t), 7) for b in language_id.buckets([(p, s)])])
        assert sorted(whole[whole < language_id.BUCKETS]) == sorted(cut[cut < language_id.BUCKETS])


# ------------------------------------------------------------------------ ann

def brute_nearest(rows, k):
    live = [(i, v) for i, v in rows if i is not None and v is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in live:
        if i % 20 == 0:
            near = sorted((-sum(np.array(v) * np.array(w)), j) for j, w in live if j != i)[:k]
            out[i] = [(j, -d) for d, j in near]
    return out


def test_ann_small_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(500)]
    rows += [(1000 + i, rows[20][1]) for i in range(60)] + [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [1.0, None] * 4), (2080, [1.0]), (2100, []), (None, [1.0] * 8), (2120, [float("inf")] + [1.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash")).repartition(4)
    got: dict = {}
    for r in ann.search(df, df.filter("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = brute_nearest(rows, 20)
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [j for j, _ in near] == [j for j, _ in got[q]]
        assert np.allclose([s for _, s in near], [s for _, s in got[q]], atol=1e-12)


def test_ann_recall_with_many_leaves_and_salts(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    monkeypatch.setattr(ann, "SALT_BLOCKS", 2)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 2
    rows = [(i, (centres[rng.integers(12)] + rng.normal(size=8) * 0.3).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.search(df, df.filter("vec_id % 20 = 0"), 10, leaf_rows=30).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute_nearest(rows, 10)
    assert got.keys() == want.keys() and all(len(x) == 10 for x in got.values())
    assert np.mean([len(got[q] & {j for j, _ in near}) / 10 for q, near in want.items()]) >= 0.9


def test_ann_plan_does_not_grow_with_the_leaves(spark, tmp_path):
    """Blocks and salts of the leaves are rows, not literals of the driver's plans; queries are walked in groups of a block."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(2000)], "vec_id long, embedding array<double>")
    plans = [len(ann.search(df, df.filter("vec_id % 20 = 0"), 5, leaf_rows=r)._jdf.queryExecution().optimizedPlan().toString()) for r in (1000, 10)]
    assert plans[1] < 1.1 * plans[0]


def test_ann_merge_leaves_out_what_cannot_enter():
    """What is below the (k + 1)-th score so far does not enter; ties do, by id."""
    rng, best = np.random.default_rng(7), {}
    q, x = rng.integers(-2, 3, (9, 4)).astype(float), rng.integers(-2, 3, (300, 4)).astype(float)
    for s in range(299, -1, -20):
        part = np.arange(max(0, s - 19), s + 1)
        ann._merge(best, np.arange(9), q, x[part], [[int(i)] for i in part], 5)
    for j in range(9):
        assert best[j] == sorted((-d, i) for i, d in enumerate((x * q[j]).sum(1).tolist()))[:6]


def test_ann_few_or_no_vectors(spark):
    none = spark.createDataFrame([(20, None)], "vec_id long, embedding array<float>")
    assert ann.search(none, none).count() == 0
    two = spark.createDataFrame([(20, [1.0, 2.0]), (21, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.search(two, two.filter("vec_id = 20")).collect()] == [(20, 1, 21, 11.0)]


# ------------------------------------------------------------ decontamination

def brute_words(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())


def brute_hits(doc, items, size):
    w, hit, found = brute_words(doc), set(), set()
    for i, t in items:
        for p in [x for x in decontamination.windows(brute_words(t), size)] if i is not None else ():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k:k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found.add(str(i))
    return len(w), hit, sorted(found)


@pytest.mark.parametrize("chunk", [8 << 20, 60])
def test_decontamination(spark, chunk):
    docs = texts(7, 30)
    items = [(1, " ".join(brute_words(docs[12])[i].decode() for i in range(3))), (2, docs[13]), (3, docs[14][10:200]), (3, docs[15][:90]), (4, None), (5, "..."), (10, "no such words at all here"), (None, docs[16]), (6, "word"), (7, docs[13])]
    df, rows = frame(spark, docs, ("items", "n_words"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(df, bench, 5, chunk_bytes=chunk).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, found = brute_hits(r.text, items, 5)
        assert (r.n_words, r["items"]) == (n, found)
        assert hit == {k for s in r.hit_spans for k in range(s.start, s.end)}
        assert all(a.end < b.start for a, b in zip(r.hit_spans, r.hit_spans[1:]))
    assert decontamination.decontaminate(empty(spark), bench).count() == 0
    assert all(r.hit_spans == [] for r in decontamination.decontaminate(df, bench.limit(0)).collect())


def test_decontamination_chunks_are_written_passes(spark, monkeypatch):
    """One chunk at a time in a task, and no more than one pass on disk beside the one written."""
    live, most = [], []
    stage, release = decontamination.stage, decontamination.release
    monkeypatch.setattr(decontamination, "stage", lambda df, name: [stage(df, name), live.append(df), most.append(len(live)), plans.append(df)][0])
    monkeypatch.setattr(decontamination, "release", lambda *dfs: [release(*dfs), live.pop()])
    plans: list = []
    docs = [f"one two three w{i} x{i} y{i}" for i in range(30)]
    bench = spark.createDataFrame([(i, docs[i]) for i in range(0, 30, 3)], "item_id long, text string")
    out = decontamination.decontaminate(frame(spark, docs)[0], bench, 5, chunk_bytes=60)
    assert {r.text: r["items"] for r in out.collect()} == {t: [str(i)] if i % 3 == 0 else [] for i, t in enumerate(docs)}
    assert len(plans) > 1 and max(most) <= 2
    for df in [*plans, out]:
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 1


def test_decontamination_proximity():
    rng = random.Random(9)
    for _ in range(200):
        doc = [rng.choice(b"abcd ") for _ in range(rng.randint(1, 14))]
        doc = bytes(x for c in doc for x in (c, 32))
        ws, p, slop = decontamination.words(doc), [bytes([rng.choice(b"abcd")]) for _ in range(rng.randint(1, 4))], rng.randint(0, 2)
        want = set()

        def follow(path, ws=ws, p=p, slop=slop, want=want):
            if len(path) == len(p):
                want.update(path)
                return
            for k in range(path[-1] + 1, min(len(ws), path[-1] + 2 + slop)):
                if ws[k] == p[len(path)]:
                    follow([*path, k])

        for k in range(len(ws)):
            if ws[k] == p[0]:
                follow([k])
        phrases = decontamination.Phrases([("i", b" ".join(p))], len(p))
        seg = decontamination.Segment([b"zz", doc, b""], phrases.terms, (len(p) + 1) * (1 + slop) + 1)
        marked, items = decontamination.match(seg, phrases, slop)
        assert {int(k - seg.starts[1]) for a, b in marked for k in range(a, b)} == want
        assert items == [set(), {"i"} if want else set(), set()]


# ------------------------------------------------------------------- licenses

def test_licenses(spark):
    rows = ["Foo bar.\nReleased under the MIT License.\nx", "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software", "SPDX-License-Identifier: Apache-2.0\ncode",
            "MIT License\n" + licenses.SENTENCES["mit-grant"][0].replace(", to any", ",\nto any") + "\n\n" + licenses.SENTENCES["mit-notice"][0], None, "", "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.", "mit license terms apply"]
    got = {r.text: (list(r.sentence_ids), list(r.licenses)) for r in licenses.scan(frame(spark, rows, ("licenses",))[0]).collect()}
    assert got[rows[0]] == (["mit-name"], ["MIT"])
    assert got[rows[1]] == ([], []) and got[None] == ([], []) and got[rows[7]] == ([], [])
    assert got[rows[2]] == (["spdx-apache-2.0"], ["Apache-2.0"])
    assert got[rows[3]] == (["mit-title", "mit-grant", "mit-notice"], ["MIT"])
    assert got[rows[6]] == (["ccbync-name"] * 2, ["CC-BY-NC-4.0"])
    # a longer rule uses its sentences up; an incomplete one gives way to a shorter
    assert licenses.match_rules(["bsd-grant", "bsd-endorse"]) == ["BSD-3-Clause"]
    assert licenses.match_rules(["bsd-grant"]) == ["BSD-2-Clause"] and licenses.match_rules(["mit-notice"]) == []
    assert licenses.scan(empty(spark)).count() == 0


def gnu(what, kind, version, mark=":", joint=","):
    return (f"    This {what} is free software{mark} you can redistribute it and/or modify\n    it under the terms of the GNU {kind}General Public License as published by\n    the Free Software Foundation{joint} either version {version} of the License, or\n    (at your option) any later version.\n\n"
            f"    This {what} is distributed in the hope that it will be useful,\n    but WITHOUT ANY WARRANTY; without even the implied warranty of\n    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n    GNU {kind}General Public License for more details.\n")


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

   1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
"""
MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the
Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
NOTICES = [
    ("MIT", "The MIT License (MIT)\n\n" + MIT), ("MIT", "MIT License\n" + MIT),
    ("Apache-2.0", 'Copyright 2020 Somebody\n\nLicensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law'),
    ("Apache-2.0", 'Licensed under the Apache License,\nVersion 2.0 (the\n"License"); you may not use this file except in compliance with the\nLicense. You may obtain a copy of the License at\nhttps://www.apache.org/licenses/LICENSE-2.0\n'),
    ("GPL-2.0-or-later", gnu("program", "", "2", ";", ";")), ("GPL-3.0-or-later", gnu("program", "", "3")),
    ("LGPL-2.1-or-later", gnu("library", "Lesser ", "2.1", ";", ";")), ("LGPL-3.0-or-later", gnu("library", "Lesser ", "3")),
    ("LGPL-3.0-or-later", gnu("program", "Lesser ", "3")), ("AGPL-3.0-or-later", gnu("program", "Affero ", "3")),
    ("BSD-2-Clause", BSD),
    ("BSD-3-Clause", BSD + "   3. Neither the name of the copyright holder nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission.\n"),
    ("BSD-3-Clause", BSD + "   * Neither the name of Google Inc. nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission.\n"),
    ("BSD-3-Clause", BSD + "3. Neither the name of A. B.\nSmith & Co. Ltd. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy"),
]


@pytest.mark.parametrize("prefix", ["", " * ", "# ", "// ", "-- "])
def test_license_notices_as_wrapped_in_files(prefix):
    find = licenses.finder()
    for name, notice in NOTICES:
        text = "\n".join((prefix + line).rstrip() for line in notice.split("\n"))
        ids = find(licenses.sentences(text.encode()))
        assert licenses.match_rules(ids) == [name], (name, ids)
        whole = {"gpl-warranty"} if "GPL" in name else {"mit-grant", "mit-notice"} if name == "MIT" else {"apache-both", "apache-copy"} if name == "Apache-2.0" else set()
        assert whole <= set(ids)


def test_license_sentences_are_whole():
    find = licenses.finder()

    def ids(t):
        return find(licenses.sentences(t.encode()))
    assert ids("Neither the name of X nor that of Y.\n\nnor the names of its contributors may be used") == []
    assert ids("Neither the name of nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.") == []
    assert ids("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0 or not.") == []
    assert ids("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.") == []
    assert ids("This is not\nlicensed under the MIT License.") == [] and ids("MIT License\nAll rights reserved.") == ["mit-title", "reserved"]
    many = "Neither the name of X. " * 20_000
    assert ids(many) == []
    assert all(licenses.finder()([s]) == [i] for s, i in licenses.known_sentences().items())


def test_queries_of_another_dimension(spark):
    """The candidates' dimension counts, also where most queries have another."""
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4 if i in (0, 20, 40) else 3)]) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.query_id for r in ann.search(df, df.filter("vec_id % 20 = 0"), 5).collect()}
    assert got == {60, 80}


# --------------------------------------------------------------- suffix dedup

def brute_repeats(rows, length):
    first: dict = {}
    for i, b in rows:
        for k in range(len(b) - length + 1):
            w = b[k:k + length]
            first[w] = min(first.get(w, 1 << 62), i)
    out: dict = {}
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k:k + length]] < i:
                gone[k:k + length] = b"\1" * length
        out.setdefault(i, []).append((bytes(x for x, g in zip(b, gone, strict=True) if not g), len(b), sum(gone)))
    return {i: sorted(x) for i, x in out.items()}


@pytest.mark.parametrize("length", [50, 30])
def test_suffix_dedup(spark, length):
    rng = random.Random(length)
    base = "".join(rng.choice(["lorem ", "ipsum ", "döl ", "a", "bb ", "zebra\n"]) for _ in range(2000))
    rows = []
    for i in range(120):
        t = ""
        for _ in range(rng.randint(0, 6)):
            a = rng.randrange(len(base))
            t += base[a:a + rng.randint(1, 300)] + "".join(rng.choices("xyz ", k=rng.randint(0, 30)))
        rows.append((rng.randrange(100) if i % 7 else i, t))
    rows += [(500, "ab" * 400), (501, "ab" * 200), (502, "a" * 300), (503, "a" * 49), (504, "a" * 50), (505, None), (506, ""), (507, base * 4), (507, base * 4), (None, base), (508, "q" * 70_000 + base + "q" * 70_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("id", F.lit(2)).repartition(5)
    got: dict = {}
    for r in suffix_dedup.remove_repeats(df, length, buckets=7).collect():
        got.setdefault(r.doc_id if r.doc_id is not None else 1 << 61, []).append((bytes(r.kept), r.n_bytes, r.n_removed))
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    assert {i: sorted(x) for i, x in got.items()} == brute_repeats([(1 << 61 if i is None else i, (t or "").encode()) for i, t in rows], length)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_deep_shallow_order():
    rng = random.Random(11)
    for letters in ("ab", "abcdefgh"):
        data = "".join(rng.choices(letters, k=400)) * 2 + "a" * 200
        data = np.frombuffer(data.encode(), np.uint8)
        starts = np.arange(len(data) - 50)
        order, same = suffix_dedup.suffix_groups(data, starts, starts % 2, 50)
        got = [(int(starts[i] % 2), data[starts[i]:starts[i] + 50].tobytes()) for i in order]
        assert got == sorted(got)
        assert same.tolist() == [False] + [a == b for a, b in zip(got, got[1:])]
        whole = [(int(s % 2), data[s:s + 50].tobytes()) for s in starts]
        twice = {x for x in whole if whole.count(x) > 1}
        assert twice == {x for x, s in zip(got, same, strict=True) if s}


# -------------------------------------------------------------------- simhash

def brute_fingerprint(t):
    ws = [x for x in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode().lower()) if x]
    shingles = [b" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [b" ".join(ws)] if ws else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(fps, bits=3):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= bits:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(fps))]


def test_simhash(spark):
    df, rows = frame(spark, texts(8), ("fp", "__text"))
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = dict(rows)
    ids = sorted(by)
    fps = {i: brute_fingerprint(by[i]) for i in ids}
    roots = brute_components([fps[i] for i in ids])
    least = {i: min(j for j, s in zip(ids, roots, strict=True) if s == r) for i, r in zip(ids, roots, strict=True)}
    for r in got:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == least[r.doc_id]
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("split", [4096, 6])
def test_simhash_links_lose_none(spark, split):
    """Clusters around few fingerprints; with a small split the lists are
    dealt again and then searched by flipped bits."""
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for base in list(fps)[:8]:
        for _ in range(60):
            x = base
            for _ in range(rng.randint(1, 7)):
                x ^= 1 << rng.choice([rng.randrange(64), rng.randrange(20)])
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 3, split)
    root = {r.node: r.root for r in components.components(links).collect()}
    got = [root.get(x, x) for x in signed]
    want = brute_components(fps)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))
    for a, b in links.collect():
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 3 or root[a] == root[b]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, i) for i in range(201, 260)] + [(300, 300), (401, 400), (400, 401)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{i: 200 for i in range(200, 260)}, 400: 400, 401: 400}


# ----------------------------------------------------------------------- chat

def test_chat_round_trip(spark):
    nasty = ["<|end|>\n<|turn:assistant|>\nhi<|end|>\n", "\\l \\\\g \\", "a<b>c", "", None, "\\### Assistant: </turn> ok", "日本 🙂"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)] + [(2, 0, "user", "only asks"), (3, 0, "assistant", "only says"), (3, 1, None, "x"), (3, 1, "to|ol>\n", "y"), (None, 5, "assistant", "z"), (4, None, "system", "s"), (4, 0, "assistant", "r"), (4, 0, "assistant", "r")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("clash")).repartition(3)
    ex = chat.examples(df)
    by: dict = {}
    for r in ex.collect():
        by.setdefault(r.conv_id, []).append(r)
    assert [len(by[c]) for c in (1, 2, 3, 4, None)] == [4, 1, 2, 2, 1]
    digests = {r.conv_id: r for r in chat.digests(ex).collect()}
    for c, own in by.items():
        turns = sorted([(-1 if n is None else n, r or "", t or "") for x, n, r, t in rows if x == c])
        own = sorted(own, key=lambda r: r.example)
        assert chat.read_turns(own[-1].text) == [(r, t) for _, r, t in turns]
        replies = [k for k, (_, r, _) in enumerate(turns) if r == "assistant"]
        for r, k in zip(own, replies, strict=False):  # all turns before as context, the reply alone under the mask
            assert chat.read_turns(r.text) == [(a, b) for _, a, b in turns[:k + 1]]
            assert chat.unescape(r.text[r.loss_start:r.loss_end]) == turns[k][2]
        d, said = digests[c], "".join(turns[k][2] for k in replies)
        assert (d.n_turns, d.loss_chars, d.formatted_chars) == (len(turns), len(said), sum(len(r.text) for r in own))
        assert d.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
    assert chat.digests(chat.examples(df.limit(0))).count() == 0


# ----------------------------------------------------------------- line dedup

def brute_lines(rows, least):
    ws = " \t\n\x0b\x0c\r"
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(ws))
    n: dict = {}
    for _, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            n[k] = n.get(k, 0) + 1
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or n[key(x)] < least]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


@pytest.mark.parametrize("bound", [64 << 20, -1])
def test_line_dedup(spark, bound):
    rng = random.Random(6)
    pool = ["Same line", " same LINE\t", "ÉTÉ", "été", "", "  ", "x", "unique"]
    rows = texts(9) + ["\n".join(rng.choice(pool) + (str(rng.random()) if rng.random() < 0.3 else "") for _ in range(rng.randint(1, 9))) for _ in range(40)] + ["x\nx\nx", "\n".join(["x"] * 2000)]
    df, rows = frame(spark, rows, ("n_lines", "hi", "shard"))
    got = line_dedup.dedup_lines(df, 10, broadcast_bytes=bound, salts=3)
    assert got.columns.count("n_lines") == 1 and "shard" in got.columns
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == brute_lines(rows, 10)
    assert line_dedup.dedup_lines(empty(spark), broadcast_bytes=bound).count() == 0


def test_line_dedup_routed_groups_are_rows(spark, monkeypatch):
    """Rows of null or one repeated id don't share a group of hits, nor a salt."""
    rows = [(None if i % 3 else 5, f"mine {i % 20}\nsecond {i % 20}\nonly {i}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    taken: list = []
    routed = line_dedup._routed
    monkeypatch.setattr(line_dedup, "_routed", lambda *a: [routed(*a), taken.append(routed(*a))][0])
    got = line_dedup.dedup_lines(df, 3, broadcast_bytes=0)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted((r.doc_id or 0, r.text, r.n_dropped) for r in got.collect()) == [(d, t, n) for d, t, _, n in brute_lines([(d or 0, t) for d, t in rows], 3)]
    assert max(len(r["__hits"]) for r in taken[0].collect()) == 2


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**63, 20_000).astype(np.uint64))
    mph = line_dedup.PerfectHash(keys)
    assert sorted(mph.lookup(keys).tolist()) == list(range(len(keys)))
    shard = line_dedup.Shard.loads(line_dedup.Shard(keys + np.uint64(1), keys, np.arange(len(keys))).dumps())
    assert shard.probe(keys + np.uint64(1), keys).tolist() == list(range(len(keys)))
    assert not shard.probe(keys + np.uint64(2), keys).any() and not shard.probe(keys, keys + np.uint64(1)).any()


def test_suffix_dedup_of_rows_without_an_id(spark):
    """Rows without an id, and rows of one id, keep what only they hold: each
    has its own spans. Ids may be the largest and the smallest numbers."""
    rng = random.Random(12)
    text = lambda n: "".join(rng.choices("abcdefghij klmnop", k=n))
    a, shared = text(200), text(120)
    rows = [(1, a), (None, a), (None, text(128)), (2**63 - 1, a + text(60)), (-3, shared)]
    rows += [(None, text(90) + (shared if i % 3 == 0 else text(50))) for i in range(120)] + [(9, text(80) + (shared if i % 2 else "")) for i in range(20)]
    rank = {k: i for i, k in enumerate(sorted({k for k, _ in rows if k is not None}))}
    brute = brute_repeats([(rank.get(k, 10**6), t.encode()) for k, t in rows], 50)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id is None, r.doc_id or 0, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, 50).collect()))
    want = sorted((k is None, k or 0, kept) for k, t in rows for kept in [_without(t.encode(), [x.encode() for j, x in rows if rank.get(j, 10**6) < rank.get(k, 10**6)], 50)])
    assert got == want and brute is not None


def _without(text: bytes, earlier: list[bytes], n: int) -> bytes:
    known = {x[i:i + n] for x in earlier for i in range(len(x) - n + 1)}
    gone = {j for i in range(len(text) - n + 1) if text[i:i + n] in known for j in range(i, i + n)}
    return bytes(c for i, c in enumerate(text) if i not in gone)


# ------------------------------------------------------------------- toxicity

def test_toxicity_learns_from_long_texts(spark):
    """Texts of any length train; the sample is bounded in rows and bytes."""
    rng = random.Random(3)
    plain = ["river", "stone", "green", "walk", "paper", "cloud", "seven", "garden", "window", "listen"]

    def doc(toxic):
        out = [" ".join(rng.choices(plain, k=9)) + "." for _ in range(450)]
        if toxic:
            out[rng.randrange(450)] = "you vilescum grubling."
        return " ".join(out)

    rows = [(i, doc(i % 2), i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    assert min(len(t) for _, t, _ in rows) > 20_000
    got = {r.doc_id: r.predicted for r in toxicity.fit_and_score(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")).collect()}
    assert got == {i: y for i, _, y in rows}


def test_toxicity(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abdegiklmnoprst", k=rng.randint(3, 7))) for _ in range(300)]
    stems = ["zuxo", "qivv", "wyfja"]

    def doc(bad):
        out = [" ".join(rng.choices(words, k=rng.randint(2, 12))) for _ in range(rng.randint(2, 25))]
        if bad:
            out[rng.randrange(len(out))] += " " + rng.choice(stems) + rng.choice(["", "en", "ish", "ar"])
        return ". ".join(out) + "."

    y = [int(rng.random() < 0.3) for _ in range(600)]
    docs = [(i, doc(y[i])) for i in range(600)] + [(1000, None), (1001, ""), (1002, "...\n"), (1003, " ".join(words * 900)), (None, "a b")]
    labels = [(i, y[i]) for i in range(500)] + [(None, 1), (3, None), (7777, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("predicted", F.lit("x")).repartition(4)
    ld = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    got = {r.doc_id: r for r in toxicity.fit_and_score(df, ld).collect()}
    assert len(got) == len(docs)
    for i in range(600):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    unseen = [i for i in range(600) if got[i].held_out or i >= 500]
    assert np.mean([got[i].predicted == y[i] for i in unseen]) >= 0.97
    assert all(got[i].score == 0 and got[i].predicted == 0 for i in (1000, 1001, 1002)) and got[1003].predicted == 0
    for i in unseen:
        for s in got[i].offending:
            if y[i]:
                assert any(x in docs[i][1][s.start:s.end] for x in stems)
    flipped = ld.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {i: r.score for i, r in got.items()} == pytest.approx({r.doc_id: r.score for r in toxicity.fit_and_score(df, flipped).collect()})
    assert toxicity.fit_and_score(empty(spark), ld).count() == 0
    assert {r.score for r in toxicity.fit_and_score(df, ld.limit(0)).collect()} == {0.0}


def test_toxicity_learns_rare_words(spark):
    """Toxic words of which each is in a few of the toxic texts count, whatever their share."""
    rng = random.Random(21)
    def word():
        return "".join(rng.choices("bcdfghklmnprstvwz", k=7))
    plain, bad = [word() for _ in range(60)], [word() for _ in range(80)]
    rows = []
    for i in range(1200):
        toxic = i % 2
        ws = rng.choices(plain, k=12) + ([bad[i // 2 % 80]] if toxic else [])
        rng.shuffle(ws)
        rows.append((i, " ".join(ws) + ".", toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.fit_and_score(docs, labels).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 100 and sum(p == y for p, y in held) / len(held) >= 0.95


def test_toxicity_sample_does_not_depend_on_held_out_labels(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{'awful' if i % 2 else 'lovely'} text number n{i}") for i in range(1000)], "doc_id long, text string")
    taken: list = []
    stage = toxicity.stage
    monkeypatch.setattr(toxicity, "stage", lambda df, name: [stage(df, name), taken.append(sorted(map(tuple, df.collect()))) if name == "toxic-sample" else 0][0])
    for least in (0, 500):  # all held-out labels, or half of them
        labels = spark.createDataFrame([(i, i % 2) for i in range(1000) if i % 5 or i >= least], "doc_id long, toxic int")
        toxicity.train(docs, labels, F.col("doc_id") % 5 != 0, rows=100)
    assert taken[0] == taken[1] and 100 < len(taken[0]) < 300


def test_toxicity_noisy_or_and_pieces(monkeypatch):
    m = toxicity.Model({b"^bad$": 6.0}, -4.0)
    t = b"good one. bad one\nbad bad! fine. " * 50
    p = m.sentences(t)
    assert len(p) == 200 and m.document(p) == pytest.approx(1 - np.prod(1 - p))
    monkeypatch.setattr(toxicity, "PIECE", 17)
    assert m.sentences(t).tolist() == p.tolist()
    assert [t.decode()[s["start"]:s["end"]].strip() for s in toxicity.spans(t, p, 0.5)][:2] == ["bad one", "bad bad"]


# ---------------------------------------------------------------- resampling

def _words(text, ranges="0-9a-z"):
    return re.findall(rf"[{ranges}\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_resample(rows, target, percent, buckets, longest, least, seed):
    def hashed(text):
        w = _words(text)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for counts, texts_ in ((s, [x for _, x in rows]), (t, target)):
        for x in texts_:
            for b in hashed(x):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + float(buckets)) / ((s[b] + 1.0) * (sum(t) + float(buckets))))) for b in range(buckets)]
    out = []
    for i, x in rows:
        f = hashed(x)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([i, len(_words(x)), len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    live = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for k, r in enumerate(live[:len(live) * percent // 100]):
        r[5] = k + 1
    return out


@pytest.mark.parametrize("longest", [1, 3])
def test_resample_equals_brute_force(spark, longest):
    rows = list(enumerate(texts(61))) + [(None, "Beta gamma " * 15), (None, None), (7, "the of the " * 9), (7, "the of the " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("weight", F.lit("own")).withColumn("__part", F.lit(1))
    target = ["alpha Beta gamma the of", "x1 " * 40, None, "日本 ß éta"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(df, bench, 40, 500, longest, 20, 9)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, brute_resample(rows, target, 40, 500, longest, 20, 9)), key=key)


def test_resample_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).count() == 0
    one = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert resampling.resample(one, none, 100).first()["rank"] == 1


def test_joined_crc():
    rng, join = random.Random(3), resampling.Joiner()
    parts = [(rng.randbytes(rng.randint(0, 9)), rng.randbytes(rng.choice([0, 1, 7, 300, 70_000]))) for _ in range(60)]
    got = join.join(np.array([zlib.crc32(a) for a, _ in parts], np.uint32), np.array([zlib.crc32(b) for _, b in parts], np.uint32), np.array([len(b) for _, b in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


# ---------------------------------------------------------------- divergence

def brute_audit(rows, min_docs, top):
    """rows: (lang, source, text)."""
    docs = [(g or "", s or "", _words(x, "a-z")) for g, s, x in rows]
    out = []
    for lang in {g for g, _, _ in docs}:
        seen: dict = {}
        for g, _, w in docs:
            for t in set(w) if g == lang else ():
                seen[t] = seen.get(t, 0) + 1
        kept = [t for t, n in seen.items() if n >= min_docs]
        sources = {s for g, s, _ in docs if g == lang}

        def shares(which, lang=lang, kept=kept):
            c = {t: 0 for t in kept}
            for g, s, w in docs:
                for t in w if g == lang and which(s) else ():
                    if t in c:
                        c[t] += 1
            n = sum(c.values())
            return c, {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        q = shares(lambda s: True)[1]
        p = {s: shares(lambda x, s=s: x == s) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [("pair", o, sum(f(p[s][1][t], p[o][1][t]) for t in kept)) for o in sources if o != s]
            term = [("term", t, f(p[s][1][t], q[t])) for t in kept if p[s][0][t] and p[s][1][t] > q[t]]
            for part, most in ((pair, None), (term, top)):
                ranked = sorted(part, key=lambda r: (-r[2], r[1].encode()))[:most]
                out += [(lang, s, *r, k + 1) for k, r in enumerate(ranked)]
    return out


def test_term_lists():
    ts = [(t or "").encode() for t in texts(5)] + [b"", b"  ", b"x", b"", "Öl ÖL a1b".encode()]
    for prefix in (b"", b"en\x00"):
        got = divergence.term_lists(ts, prefix).to_pylist()
        assert got == [[(prefix + w).decode() for w in divergence.terms(t)] for t in ts]
    assert divergence.term_lists([], b"p").to_pylist() == []


@pytest.mark.parametrize("most_terms", [10**6, 0, 3])
def test_audit_equals_brute_force(spark, most_terms):
    rng = random.Random(8)
    rows = [(rng.choice(["en", "de", None, "a\x00b"]), rng.choice(["s1", "s2", "Ö", None, "s3"]), x) for x in texts(71, 60)]
    rows += [("en", "silent", None), ("lone", "only", "alpha"), ("two", "x", ""), ("two", "y", None)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3).withColumn("term", F.lit("own")).withColumn("n", F.lit(1))
    got = divergence.audit(df, 3, 4, most_terms)
    assert sorted(map(tuple, got.collect())) == sorted(brute_audit(rows, 3, 4))
    assert divergence.audit(df.limit(0), 3, 4, most_terms).count() == 0


# ---------------------------------------------------------------------- Katz

class BruteKatz:
    """The same model by plain dictionaries of word tuples."""

    def __init__(self, learnt, order):
        self.order, self.docs = order, len(learnt)
        self.counts = [dict() for _ in range(order + 1)]
        for w in learnt:
            for n in range(1, order + 1):
                padded = (["<s>"] if n > 1 else []) + w
                for i in range(len(padded) - n + 1):
                    g = tuple(padded[i:i + n])
                    self.counts[n][g] = self.counts[n].get(g, 0) + 1
        self.total = sum(self.counts[1].values())
        self.d = [None] + [katz.good_turing([sum(c == r for c in self.counts[n].values()) for r in range(1, katz.CUTOFF + 2)]) for n in range(1, order + 1)]
        self.next: dict = {}
        for n in range(1, order + 1):
            for g, c in self.counts[n].items():
                self.next.setdefault(g[:-1], {})[g[-1]] = c

    def dis(self, n, c):
        return (self.d[n][c] if c < len(self.d[n]) else 1.0) * c

    def p(self, context, word):
        n = len(context) + 1
        if n == 1:
            left = sum(c - self.dis(1, c) for c in self.counts[1].values())
            extra = left <= 0
            return self.dis(1, self.counts[1][(word,)]) / (self.total + extra) if (word,) in self.counts[1] else (left + extra) / (self.total + extra)
        seen = self.next.get(context)
        if not seen:
            return self.p(context[1:], word)
        left = sum(c - self.dis(n, c) for c in seen.values())
        extra = left <= 0
        size = sum(seen.values()) + extra
        if word in seen:
            return self.dis(n, seen[word]) / size
        return (left + extra) / size / (1 - sum(self.p(context[1:], w) for w in seen)) * self.p(context[1:], word)

    def score(self, w):
        padded = ["<s>", *w]
        return sum(math.log10(self.p(tuple(padded[max(0, i - self.order + 1):i]), padded[i])) for i in range(1, len(padded)))

    def base(self, w):
        return sum(math.log10((self.counts[1].get((x,), 0) + 0.1) / (self.total + 0.1 * (len(self.counts[1]) + 1))) for x in w)


def _tokens(text):
    return [x.decode() for x in (text or "").encode().lower().split()] + ["</s>"]


@pytest.mark.parametrize(("order", "split"), [(1, 1 << 22), (2, 3), (3, 2)])
def test_katz_equals_brute_force(spark, monkeypatch, order, split):
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 900)
    monkeypatch.setattr(katz, "SPLIT", split)
    rows = list(enumerate(texts(81, 60))) + [(None, "alpha beta"), (None, None), (5, "the of the"), (5, "the of the")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("block", F.lit(1)).withColumn("score", F.lit("own"))
    got = katz.fit_and_score(df, order, block_bytes=2000).collect()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    brute = BruteKatz([_tokens(x) for i, x in rows if not held(i)], order)
    want = sorted((i is None, i or 0, held(i), len(w), sum((t,) in brute.counts[1] for t in w), brute.total, brute.base(w), brute.score(w)) for i, w in ((i, _tokens(x)) for i, x in rows))
    have = sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert [h[:6] for h in have] == [w[:6] for w in want]
    assert np.allclose([h[6:] for h in have], [w[6:] for w in want], rtol=1e-9)


def test_katz_probabilities_sum_to_one(spark):
    rng = random.Random(4)
    learnt = [" ".join(rng.choices("abcdefgh", weights=[9, 7, 5, 3, 2, 1, 1, 1], k=rng.randint(1, 12))) for _ in range(60)]
    model = katz.train(spark.createDataFrame([(i, t) for i, t in enumerate(learnt)], "doc_id long, text string"), 2)
    words = [*"abcdefgh", "unseen"]
    for before in ("", "a", "h", "unseen", "a b"):
        # p(text and one word more, without the end) from the scores of longer texts: sum over the next token
        asked = spark.createDataFrame([(0, before)] + [(i + 1, f"{before} {w}") for i, w in enumerate(words)], "doc_id long, text string")
        brute = BruteKatz([_tokens(t) for t in learnt], 2)
        got = {r.doc_id: r.score for r in katz.score(asked, model).collect()}
        last = (before.split() or ["<s>"])[-1]
        assert math.isclose(sum(brute.p((last,), w) for w in [*words, "</s>"]), 1, rel_tol=1e-12)
        for i, w in enumerate(words):
            assert math.isclose(got[i + 1] - got[0], math.log10(brute.p((last,), w) * brute.p((w,), "</s>") / brute.p((last,), "</s>")), rel_tol=1e-9, abs_tol=1e-12)


def test_katz_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = katz.train(none, 2)
    assert katz.fit_and_score(none, 2).count() == 0
    r = katz.score(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), model).collect()
    assert [(x.n_known, x.score, x.base_score) for x in r] == [(0, 0.0, 0.0)] * 2


def test_good_turing_cutoffs():
    assert katz.good_turing([100, 40, 20, 12, 8, 6]).round(4).tolist() == [1.0, *[round((((r + 1) * b / (r * a)) - 0.36) / 0.64, 4) for r, (a, b) in enumerate(zip([100, 40, 20, 12, 8], [40, 20, 12, 8, 6]), 1)]]
    assert katz.good_turing([0, 0, 0, 0, 0, 0]).tolist() == [1.0]
    assert katz.good_turing([5, 5, 5, 5, 5, 5]).tolist() == [1.0]


def test_packed_arrays():
    rng = np.random.default_rng(1)
    for a in (np.empty(0, np.uint64), np.zeros(5, np.uint64), rng.integers(0, 2**64, 999, np.uint64), np.array([0, 2**64 - 1], np.uint64)):
        assert (katz.unpack(katz.pack(a), np.uint64) == a).all() and (katz.unpack_sorted(katz.pack_sorted(np.sort(a)), np.uint64) == np.sort(a)).all()
    f = rng.random(50).round(1)
    assert (katz.unpack_few(katz.pack_few(f)) == f).all() and (katz.unpack(katz.pack(f), np.float64) == f).all()
