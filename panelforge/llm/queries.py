"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, crossent, fm_index, fragments, quality, suffix, tiling, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _fold(folds: int) -> Column:
    """The fold of a document: crc32 of its id as text."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").where(_fold(3) != 1).select("doc_id", F.col("quality").alias("label"))
    scores = quality.scored(_table(spark, sf_dir, "documents"), labels)
    return scores.select("doc_id", (_fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0")).withColumn("score", F.col("score").cast("long"))


def op3_crossent(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return crossent.score(_table(spark, sf_dir, "documents"), target)


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_dedup(_table(spark, sf_dir, "documents"), report=200)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(_fold(4) != 2).select("doc_id", F.col("toxic").alias("label"))
    scores = toxicity.score(docs, toxicity.train(docs, labels))
    return scores.select("doc_id", (_fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragments.jaccard_components(_table(spark, sf_dir, "documents"), n_links=True)


def op7_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.substring_dedup(_table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    talks = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digest(chat.format_conversations(talks, public_tokenizers.path("byte_bpe_50k.json")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_topk": op2_topk,
    "op3_crossent": op3_crossent,
    "op4_suffix": op4_suffix,
    "op5_toxicity": op5_toxicity,
    "op6_fragments": op6_fragments,
    "op7_fm_index": op7_fm_index,
    "op8_chat": op8_chat,
    "op9_tiling": op9_tiling,
    "op10_bpe": op10_bpe,
}

ORACLE: dict[str, str] = {
    "op2_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
            FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 10
    """,
    "op6_fragments": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w
        ), e AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
        ), l AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 180 * count(*) >= 80 * (a.n + b.n)
        ), r AS (
            SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
        )
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.m, s.doc_id)) AS component_id, coalesce(c.n, 0)::BIGINT AS n_links
        FROM s LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) m ON m.a = s.doc_id
        LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) c ON c.a = s.doc_id
    """,
    "op8_chat": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), e AS (
            SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|<SYS>>|</SYS>>|/?INST\]|/?ROLE\])', '\1\\\2\3', 'g'))
                + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 16 WHEN 'assistant' THEN 7
                  ELSE 20 + length(regexp_replace(role, '([<\[])(\\*)(/?s>|<SYS>>|</SYS>>|/?INST\]|/?ROLE\])', '\1\\\2\3', 'g')) END AS made
            FROM t
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(made)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id
    """,
}
