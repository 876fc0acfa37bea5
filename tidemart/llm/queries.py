"""Registered queries of the operators, one each, over whole tables, and
their DuckDB twins where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, decontamination, divergence, katz, language_id, licenses, line_dedup, resampling, simhash, suffix_dedup, toxicity
from .common import prepare, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

# parameters in production
BENCHMARK_WORDS, LINE_DOCS, SHINGLE_WORDS, MAX_BITS, REPEAT_BYTES, NEAREST = 10, 10, 3, 3, 50, 20
ORDER = 2
DRAWN_PERCENT, FEATURE_BUCKETS, LONGEST_RUN, LEAST_WORDS, SEED = 10, 10000, 1, 20, 2024
TERM_DOCS, TOP_TERMS = 10, 10


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, VOCABULARY).drop("text")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.fit_and_identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 20 = 0"), NEAREST)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), BENCHMARK_WORDS)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s.end - s.start)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).select("doc_id", F.concat_ws(",", "sentence_ids").alias("sentence_ids"), F.concat_ws(",", "licenses").alias("licenses"), (F.size("licenses") > 0).alias("licensed"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs, REPEAT_BYTES).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), SHINGLE_WORDS, MAX_BITS)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    prepare(spark)
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("\\### Assistant: </turn> ok").alias("text"))
    return chat.digests(chat.examples(turns.unionByName(probe)))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, LINE_DOCS).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.fit_and_score(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", F.size("offending").cast("long").alias("n_offending"))


def op11_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return katz.fit_and_score(docs, ORDER).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = resampling.resample(docs, table(spark, sf_dir, "benchmark"), DRAWN_PERCENT, FEATURE_BUCKETS, LONGEST_RUN, LEAST_WORDS, SEED)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"), TERM_DOCS, TOP_TERMS)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_language_id, op3_ann, op4_decontamination, op5_licenses, op6_suffix_dedup, op7_simhash, op8_chat, op9_line_dedup, op10_toxicity,
                                   op11_katz, op12_resampling, op13_divergence)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = {
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT item_id, unnest(CASE WHEN len(w) >= 10 THEN list_transform(range(1, len(w) - 8), lambda k: array_to_string(list_slice(w, k, k + 9), ' ')) ELSE [array_to_string(w, ' ')] END) AS p,
        least(len(w), 10) AS n FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
place AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n),
run AS (SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS p FROM place),
occ AS (SELECT DISTINCT doc_id, k, n, item_id FROM run JOIN win USING (n, p)),
hit AS (SELECT doc_id, count(DISTINCT k + i) AS n_hit FROM (SELECT DISTINCT doc_id, k, n FROM occ) o, range(0, 10) r(i) WHERE i < n GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM occ GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op5_licenses": licenses.duckdb_sql(),
    "op6_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
piece AS (SELECT doc_id, a, x[2 * a + 1 : 2 * a + 2098] AS y, least(n - 49, a + 1000) AS upto FROM (SELECT doc_id, n, x, unnest(range(0, n - 49, 1000)) AS a FROM d WHERE n >= 50)),
win AS (SELECT doc_id, k, y[2 * (k - a) + 1 : 2 * (k - a) + 100] AS s FROM (SELECT doc_id, a, y, unnest(range(a, upto)) AS k FROM piece)),
first AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT doc_id, k FROM win JOIN first USING (s) WHERE doc_id > m),
run AS (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50 THEN 0 ELSE 1 END AS new FROM gone),
num AS (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS r FROM run),
span AS (SELECT doc_id, r, min(k) AS a, max(k) + 50 AS z FROM num GROUP BY doc_id, r),
part AS (SELECT doc_id, r, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span),
kept AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(x[2 * before + 1 : 2 * a], '' ORDER BY a) || coalesce(any_value(x)[2 * max(z) + 1 : 2 * any_value(n)], '') AS x
         FROM part JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op8_chat": """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, t, r, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
      18 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\\\<>]', '', 'g')) AS n FROM c),
s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k) AS upto, count(*) OVER (PARTITION BY conv_id) AS last FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR k = last) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id""",
    "op9_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS xs FROM documents)),
k AS (SELECT doc_id, x, i, translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(hot.key) AS n_dropped, sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot USING (key) GROUP BY doc_id""",
    "op12_resampling": f"""
WITH RECURSIVE polynomial(i, k, c) AS (SELECT i, 0, CAST(i AS BIGINT) FROM range(256) r(i)
    UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM polynomial WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM polynomial WHERE k = 8),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
word AS (SELECT DISTINCT x FROM (SELECT unnest(w) AS x FROM d UNION ALL SELECT unnest(w) FROM b)),
byte AS (SELECT x, list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda k: CAST('0x' || h[k : k + 1] AS BIGINT))) AS bs FROM (SELECT x, hex(encode(x)) AS h FROM word)),
bucket AS (SELECT x, xor(4294967295, list_reduce(bs, lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1]))) % 10000 AS k FROM byte, crc),
dw AS (SELECT doc_id, n, unnest(w) AS x FROM (SELECT row_number() OVER () AS n, doc_id, w FROM d)),
s AS (SELECT k, count(*) AS s FROM dw JOIN bucket USING (x) GROUP BY k), t AS (SELECT k, count(*) AS t FROM (SELECT unnest(w) AS x FROM b) JOIN bucket USING (x) GROUP BY k),
total AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS s_all, (SELECT coalesce(sum(t), 0) FROM t) AS t_all),
gain AS (SELECT k, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * (t_all + 10000.0::DOUBLE)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (k), total),
weighed AS (SELECT doc_id, n, sum(g) AS g FROM dw JOIN bucket USING (x) JOIN gain USING (k) GROUP BY doc_id, n),
scored AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(g, 0) AS BIGINT) AS weight,
           CAST(coalesce(g, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
           FROM (SELECT row_number() OVER () AS n, doc_id, w FROM d) d LEFT JOIN weighed USING (n)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, n_features) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS live FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= live * 10 // 100 THEN r END AS rank FROM placed""",
    "op13_divergence": f"""
WITH d AS (SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT n, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM x GROUP BY lang, term HAVING count(DISTINCT n) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, count(*) AS c FROM x SEMI JOIN kept USING (lang, term) GROUP BY ALL),
cell AS (SELECT grp.lang, grp.source, kept.term, coalesce(c, 0) AS c, sum(coalesce(c, 0)) OVER (PARTITION BY grp.lang, grp.source) AS total, v FROM grp JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN cnt USING (lang, source, term)),
p AS (SELECT lang, source, term, c, CAST(1 + CAST(1000000000 AS HUGEINT) * (c + 2) // (total + 2 * v) AS HUGEINT) AS p FROM cell),
whole AS (SELECT lang, term, c, sum(c) OVER (PARTITION BY lang) AS total, v FROM (SELECT lang, term, sum(c) AS c FROM cnt GROUP BY lang, term) JOIN v USING (lang)),
q AS (SELECT lang, term, CAST(1 + CAST(1000000000 AS HUGEINT) * (c + 2) // (total + 2 * v) AS HUGEINT) AS q FROM whole),
two AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN two ON two.lang = a.lang AND two.source = a.source AND two.item = b.source),
mark AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pair UNION ALL FROM mark))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
}
