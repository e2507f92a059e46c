"""One registered query per operator: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm import (op1_hnsw, op2_winnow, op3_lm, op4_pieces, op5_pack, op6_toxicity, op7_chat, op8_langid,
                         op9_minhash, op10_lines, op11_align, op12_rules, op13_runs)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_hnsw.near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_winnow.fingerprints(_table(spark, sf_dir, "documents"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_lm.score(_table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_pieces.pieces(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_pack.pack(_table(spark, sf_dir, "documents"))


def op6_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_chat.format_chats(op7_chat.with_control_case(_table(spark, sf_dir, "conversations"))).drop("n_tokens", "loss_tokens")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_langid.languages(_table(spark, sf_dir, "documents"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_minhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's text after line dedup."""
    out = op10_lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines").cast("long").alias("n_lines"), F.col("__removed").cast("long").alias("n_removed"),
                      F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_align.alignment(_table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_rules.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_runs.periodic_runs(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_embedding_near_dedup, op2_fingerprints, op3_lm_score, op4_sentencepiece, op5_packing, op6_toxicity_scores,
    op7_chat_format, op8_language_id, op9_minhash_dedup, op10_line_dedup, op11_token_alignment,
    op12_quality_rules, op13_periodic_runs)}

# every pair of equal, non-null labels by double cosine; components by recursion
_OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CASE WHEN label IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e
  FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links,
       c.component_id, c.component_id = v.vec_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = v.vec_id
"""

# 5-word shingle sets, pairs by their shared shingles, components by recursion
_OP9 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5
        THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k
      FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i WHERE 100 * k >= 85 * (na + nb - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, c.component_id = s.doc_id AS kept
FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = s.doc_id
"""

# digests of the turns and of the assistant texts; the formatted length counts 20 characters of marks per turn
_OP7 = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
x AS (SELECT *, length(regexp_replace(role, '([<\\[])(\\\\*)(/?s>|/?INST\\])', '\\1\\\\\\2\\3', 'g'))
             + length(regexp_replace(text, '([<\\[])(\\\\*)(/?s>|/?INST\\])', '\\1\\\\\\2\\3', 'g')) + 20 AS n FROM c),
t AS (SELECT conv_id, count(*) AS n_turns, sum(n)::BIGINT AS formatted_chars,
             sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS said
      FROM x GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(said) AS loss_chars, sha256(said) AS loss_sha256, formatted_chars FROM t
"""

ORACLE = {"op1_embedding_near_dedup": _OP1, "op7_chat_format": _OP7, "op9_minhash_dedup": _OP9}
