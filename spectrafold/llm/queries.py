"""Registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import language, lines, packing, quality, rules, search, secrets, sentencepieces, shards, simhash, topk, whitening, wordpieces

# Folder of the public tokenizer files; every executor's tasks get what they need from the driver.
TOKENIZERS = os.environ.get("SPECTRAFOLD_TOKENIZERS", "/opt/tokenizers")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    return f"{TOKENIZERS}/{name}"


def packing_files() -> tuple[str, str, str]:
    """Tokenizer file, its ranks, and the fixed pattern by which both cut a text into words."""
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return _tokenizer("byte_bpe_50k.json"), _tokenizer("byte_bpe_50k.tiktoken"), pattern


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding them gives the text back."""
    model = _tokenizer("piece_bpe_32k.model")
    ids = sentencepieces.encode(_table(spark, sf_dir, "documents"), model)
    back = sentencepieces.decode(ids, model)
    return back.select("doc_id", "n_tokens", "ids", (F.crc32(F.col("text").cast("binary")) == F.col("text_crc32")).alias("round_trip"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece lengths of every document with the pieces of a public model as vocabulary."""
    vocabulary = wordpieces.vocabulary_of(_tokenizer("piece_bpe_32k.model"))
    return wordpieces.count_tokens(_table(spark, sf_dir, "documents"), vocabulary, prefix=None, mark="▁")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its later matching lines, and which lines went."""
    done = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "text", "n_lines", "n_removed", "removed")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(_table(spark, sf_dir, "documents"), shards=8)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), *packing_files(), with_ids=False)
    return pieces.drop("ids")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(_table(spark, sf_dir, "documents")).drop("dup_gram_chars")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs))


QUERIES = {f.__name__: f for f in (
    op1_sentencepiece, op2_token_counts, op3_topk, op4_line_dedup, op5_simhash, op6_quality, op7_secrets, op8_sharding,
    op9_packing, op10_quality_rules, op11_whitening, op12_search, op13_language)}

ORACLES = {
    "op3_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 100 = 0),
s AS (
  SELECT q.vec_id AS query_id, q.v AS qv, c.vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
""",
    "op12_search": r"""
WITH spelled AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id AS id, text FROM documents
  UNION ALL SELECT 'i', NULL, item_id, text FROM benchmark WHERE item_id IS NOT NULL
), cut AS (
  SELECT side, r, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM spelled
), asked AS (SELECT DISTINCT id AS item_id, unnest(ts) AS term FROM cut WHERE side = 'i'),
docs AS (SELECT r, id AS doc_id, ts, CAST(coalesce(len(ts), 0) AS BIGINT) AS n FROM cut WHERE side = 'd'),
totals AS (SELECT count(*) FILTER (n > 0) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM docs),
tfs AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tfs, totals GROUP BY term, big_n),
impacts AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l))) AS impact
  FROM tfs JOIN docs USING (r) JOIN weights USING (term), totals),
scores AS (SELECT item_id, r, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM impacts JOIN asked USING (term)
  WHERE doc_id IS NOT NULL GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
""",
    "op10_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
words AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
sums AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY r),
grams AS (SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT r, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (VALUES (3), @SIZES@) s(n))),
marked AS (SELECT r, n, i FROM (
  SELECT r, n, i, count(*) OVER (PARTITION BY r, n, g) AS c, row_number() OVER (PARTITION BY r, n, g ORDER BY i) AS k FROM grams)
  WHERE CASE WHEN n = 3 THEN c > 1 ELSE k > 1 END),
inside AS (SELECT DISTINCT r, n, i + unnest(range(0, n)) AS p FROM marked),
cover AS (SELECT r, count(*) FILTER (n = 3) AS n_repeat_words,
    bool_or(chars > CASE n @LIMITS@ END::DOUBLE * word_chars) FILTER (n > 3) AS over FROM (
  SELECT r, n, p, sum(length(word)) OVER (PARTITION BY r, n) AS chars, word_chars FROM inside JOIN words USING (r, p) JOIN sums USING (r)) GROUP BY r),
lines AS (SELECT r, line, p, regexp_matches(line, '[^\x20\x09-\x0D]') AS has FROM (
  SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM d)),
dup AS (SELECT r, count(*) FILTER (k > 1 AND has) AS n_dup_lines, coalesce(sum(length(line)) FILTER (k > 1 AND has), 0) AS dup_line_chars, sum(length(line)) AS line_chars
  FROM (SELECT *, row_number() OVER (PARTITION BY r, line ORDER BY p) AS k FROM lines) GROUP BY r),
base AS (SELECT d.r, doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(over, false) AS over,
    coalesce(dup_line_chars, 0) AS dup_line_chars, coalesce(line_chars, 0) AS line_chars
  FROM d LEFT JOIN sums USING (r) LEFT JOIN cover USING (r) LEFT JOIN dup USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR over OR dup_line_chars > @LINE@::DOUBLE * line_chars) AS kept,
  CAST(dup_line_chars AS BIGINT) AS dup_line_chars, CAST(line_chars AS BIGINT) AS line_chars
FROM base
""".replace("@SIZES@", ", ".join(f"({n})" for n in rules.GRAM_LIMITS)).replace(
        "@LIMITS@", " ".join(f"WHEN {n} THEN {limit}" for n, limit in rules.GRAM_LIMITS.items())).replace("@LINE@", str(rules.LINE_LIMIT)),
}
