"""The registered queries on the given tables, and the pipeline against a
brute-force version of its stages."""

import hashlib
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemart.llm import queries
from tidemart.llm.common import table

from .test_operators import brute_components, brute_fingerprint, brute_hits, brute_lines, brute_nearest, brute_repeats

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twin(spark, sf_dir, name):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    rows = sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in want.fetchall())
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r) for r in got.select(*sorted(got.columns)).collect()) == rows


def test_suffix_dedup_on_the_table(spark, sf_dir):
    rows = [(r.doc_id, (r.text or "").encode()) for r in table(spark, sf_dir, "documents").collect()]
    want = {i: x[0] for i, x in brute_repeats(rows, 50).items()}
    for r in queries.op6_suffix_dedup(spark, sf_dir).collect():
        kept, n, removed = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (n, removed, hashlib.sha256(kept).hexdigest())


def test_bpe_on_the_table(spark, sf_dir):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(queries.VOCABULARY)
    rows = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    for r in queries.op1_bpe(spark, sf_dir).collect():
        ids = np.array(lib.encode(rows[r.doc_id], add_special_tokens=False).ids, "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())


def test_language_accuracy(spark):
    docs = table(spark, SF, "documents").select("doc_id", "lang")
    got = queries.op2_language_id(spark, SF).join(docs, "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.98


def test_ann_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    live = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    got: dict = {}
    for r in queries.op3_ann(spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    part = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = live @ live[q]
        s[q] = -np.inf
        part.append(len(got[ids[q]] & set(ids[np.argsort(-s, kind="stable")[:20]].tolist())) / 20)
    assert np.mean(part) >= 0.9
    assert brute_nearest is not None


def test_toxicity_accuracy(spark):
    labels = table(spark, "/root/testdata/sf0.1", "labels").select("doc_id", "toxic")
    got = queries.op10_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() >= 0.95


def test_pipeline_stages(spark, sf_dir):
    """Each stage on what the one before kept, against brute force."""
    docs = table(spark, sf_dir, "documents")
    bench = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    extra = spark.createDataFrame([(10**6, "12 34", None, None, 5), (10**6 + 1, None, "en", "s", 0), (10**6 + 2, docs.first().text, "en", "s", 1)], docs.schema)
    docs = docs.unionByName(extra)
    before = {r.doc_id: r for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "line_dedup", "simhash", "decontamination", "bpe"]

    def run(name, rows):
        df = steps[name](spark, spark.createDataFrame(list(rows.values()), docs.schema), sf_dir)
        if name != "bpe":
            assert df.dtypes == docs.dtypes
        got = df.collect()
        assert len({r.doc_id for r in got}) == len(got)
        return {r.doc_id: r for r in got}

    kept = run("language_id", before)
    assert set(before) - set(kept) == {10**6, 10**6 + 1} and all(kept[i] == before[i] for i in kept)
    cut = run("line_dedup", kept)
    assert sorted((i, r.text) for i, r in cut.items()) == [(i, t) for i, t, _, _ in brute_lines([(i, r.text) for i, r in kept.items()], 10)]
    assert all(r.n_chars == (len(r.text) if r.text != kept[i].text else kept[i].n_chars) for i, r in cut.items())
    one = run("simhash", cut)
    ids = sorted(cut)
    roots = brute_components([brute_fingerprint(cut[i].text) for i in ids])
    first: dict = {}
    for i, r in zip(ids, roots, strict=True):
        first.setdefault(r, i)
    assert set(one) == set(first.values()) and all(one[i] == cut[i] for i in one)
    clean = run("decontamination", one)
    assert set(clean) == {i for i in one if not brute_hits(one[i].text, bench, 10)[1]}
    out = run("bpe", clean)
    assert set(out) == set(clean)
    assert all(r.decoded_sha256 == hashlib.sha256(clean[i].text.encode()).hexdigest() and len(r.ids) == r.n_tokens for i, r in out.items())


def test_pipeline_simhash_null_and_repeated_ids(spark, sf_dir):
    """Each group keeps exactly one row: least id (nulls last); none is lost to another group's."""
    docs = table(spark, sf_dir, "documents")
    words = [" ".join(hashlib.sha256(f"{i} {j}".encode()).hexdigest()[:6] for j in range(60)) for i in range(12)]
    rows = [(None, words[0]), (None, words[1]), (None, words[1]), (None, words[2]),    # three groups without an id
            (5, words[3]), (None, words[3]),                                             # an id before none
            (7, words[4]), (7, words[5]),                                                # one id, two groups
            (8, words[6]), (9, words[6]), (9, words[7]),                                 # 9 is a copy in one group, clean in another
            (2**63 - 1, words[8]), (None, words[9]), (None, None), (None, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema).repartition(5)
    got = sorted(((r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["simhash"](spark, df, sf_dir).collect()), key=repr)
    roots = brute_components([brute_fingerprint(t or "") for _, t in rows])
    best: dict = {}
    for root, (i, _) in zip(roots, rows, strict=True):
        best[root] = min(best.get(root, (True, 0)), (i is None, i or 0))
    assert len(best) == 11 and len(got) == 11
    assert {t for _, t in got} - {None, ""} == set(words[:10]) and sum(not t for _, t in got) == 1
    assert sorted(((i is None, i or 0) for i, _ in got)) == sorted(best.values())
    assert (5, words[3]) in got and (8, words[6]) in got and (9, words[7]) in got


def test_pipeline_of_no_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, sf_dir)
        assert docs.count() == 0
