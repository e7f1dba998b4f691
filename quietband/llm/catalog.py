"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietband.llm.common import table
from quietband.llm.divergence import source_divergence
from quietband.llm.jaccard_join import jaccard_components
from quietband.llm.lm_scoring import score_texts
from quietband.llm.mixing import mix_sources
from quietband.llm.near_vectors import near_vectors
from quietband.llm.packing import harmonic_pack, tokenized_pieces
from quietband.llm.pii import report_pii
from quietband.llm.quality import score_quality
from quietband.llm.token_files import token_files
from quietband.llm.toxicity import score_toxicity
from quietband.llm.url_rules import match_rules
from quietband.llm.vp_tree import nearest
from quietband.llm.whitening import whiten

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PACK_END_ID = 2
FILE_END_ID = 0
TOXIC_FROM = 0.3
# The rules of op6.
URL_RULES = [
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return harmonic_pack(tokenized_pieces(docs, WORD_TOKENIZER, PACK_END_ID))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op3_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, table(spark, sf_dir, "documents"), BYTE_TOKENIZER, FILE_END_ID)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_rules(table(spark, sf_dir, "pages"), URL_RULES)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def op8_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TOXIC_FROM)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_pii_labelers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_pii(table(spark, sf_dir, "documents"))


def op11_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_harmonic_packing": op1_harmonic_packing,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_vantage_point_search": op3_vantage_point_search,
    "op4_quality_ranking": op4_quality_ranking,
    "op5_token_files": op5_token_files,
    "op6_url_filter": op6_url_filter,
    "op7_mixing": op7_mixing,
    "op8_toxicity_grammar": op8_toxicity_grammar,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_pii_labelers": op10_pii_labelers,
    "op11_attention_scores": op11_attention_scores,
    "op12_source_divergence": op12_source_divergence,
    "op13_whitening": op13_whitening,
}

OP6_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), hosted AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut
), parts AS (
  SELECT page_id,
         translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM hosted
), ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/'
  END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         coalesce(text, '') AS text
  FROM documents
), words AS (
  SELECT row_id, lang, source,
         unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs
), kept AS (
  SELECT lang, term, count(*) AS in_lang FROM words GROUP BY lang, term HAVING count(DISTINCT row_id) >= 30
), langs AS (
  SELECT lang, count(*) AS v, sum(in_lang) AS n FROM kept GROUP BY lang
), grps AS (
  SELECT DISTINCT lang, source FROM docs
), held AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (
  SELECT lang, source, sum(n) AS n FROM held GROUP BY ALL
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(h.n, 0) + 5)) // (coalesce(t.n, 0) + 5 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.in_lang + 5)) // (l.n + 5 * l.v) AS q
  FROM grps g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL
), empty_pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, 0 AS value
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
  WHERE a.lang NOT IN (SELECT lang FROM langs)
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM empty_pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""

ORACLE_SQL = {"op6_url_filter": OP6_SQL, "op12_source_divergence": OP12_SQL}
