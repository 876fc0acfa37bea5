"""The corpus pipeline: five stages over ``documents``, each written as
Parquet and read again by the next.

1. language ID: documents without a determined language go; so do those
   whose language is less likely than ``MIN_LANGUAGE`` by the model.
2. line dedup: lines found in ten or more documents are cut from the texts.
3. SimHash near-dedup: of each group the row of the least id stays.
4. benchmark decontamination: documents with a benchmark passage go.
5. BPE encoding: the token ids of each document, and the digests of the ids
   and of the text decoded from them.

Rows of one doc_id are a document each, and so are rows without one. Stage 3
keeps one row of every group, by id (nulls last), then by a hash of the row;
an id stays more than once where its rows are in different groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.llm import bpe, decontamination, language_id, line_dedup, simhash
from tidemart.llm.common import col, prepare, release, stage, table
from tidemart.llm.queries import BENCHMARK_WORDS, LINE_DOCS, MAX_BITS, SHINGLE_WORDS, VOCABULARY

MIN_LANGUAGE = 0.5


def _as_documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[col(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a determined language, trained on these documents' labels."""
    held_out = language_id.remainder("doc_id", 4) == 2
    model = language_id.train(docs, ~held_out)
    found = language_id.identify(docs.select(F.struct(*[col(c) for c in docs.columns]).alias("d"), col("text").alias("t")), model, "t")
    return found.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE)).select("d.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; n_chars, if there, follows the text."""
    out = line_dedup.dedup_lines(docs, LINE_DOCS)
    for c in docs.columns:
        if c.lower() == "n_chars":
            out = out.withColumn(c, F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(col(c)))
    return _as_documents(out, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return _as_documents(simhash.representatives(docs, SHINGLE_WORDS, MAX_BITS), docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    found = decontamination.decontaminate(docs.select(F.struct(*[col(c) for c in docs.columns]).alias("d"), col("text").alias("t")), table(spark, sf_dir, "benchmark"), BENCHMARK_WORDS, text="t")
    return found.filter(F.size("hit_spans") == 0).select("d.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the token ids."""
    return bpe.encode(docs.select("doc_id", "text"), VOCABULARY, keep_ids=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash", near_duplicates), ("decontamination", clean), ("bpe", tokens)]
ORACLE_SQL = None  # a trained model, XXH64 and BPE merges are beyond SQL: see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES:
        docs, last = stage(step(spark, docs, sf_dir), name), before
        if last is not None:
            release(last)
        before = docs
    return docs
