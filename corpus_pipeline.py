"""The corpus pipeline: toxicity, near duplicates, repeated substrings, benchmark leaks, tokens.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the
columns of documents.  Rows are handled one by one: ids may be null or repeated.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import bpe, fragments, shards, suffix, tiling, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of a passage that may stand in the corpus once only: some 30 to 40 words, so that passages of 50 words and
#: more are found whatever the length of their words (op4's contract asks for 400 bytes; this stage has its own).
REPEAT = 200


def _fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go.  Learns from labels outside the held-out fold, as op5 does; without labels of both classes all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(_fold() != 2).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs, labels)
    return toxicity.keep(docs, model, 0.3).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row stays, that with the smallest doc_id (nulls last; of several such the one with the smallest xxhash64 of its text); rows without words stay.

    Rows that equal each other in doc_id and text count once.
    """
    found = fragments.jaccard_components(docs, rows_apart=True)
    rows = found.groupBy("component", "doc_id", "mark").agg(F.count("*").alias("n"))
    first = rows.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "n")).alias("k"))
    kept = shards.durable(first.select("k.doc_id", "k.mark", "k.n").unionByName(rows.where("component IS NULL").select("doc_id", "mark", "n")))
    same = docs["doc_id"].eqNullSafe(kept["doc_id"]) & F.xxhash64(docs["text"]).eqNullSafe(kept["mark"])
    out = docs.join(kept, same, "left_semi")
    # no shuffle of texts for repeated rows where there are none
    return (out if kept.where("n > 1").isEmpty() else out.dropDuplicates(["doc_id", "text"])).select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes under strings of REPEAT bytes that occur elsewhere too; what is left of a cut character goes."""
    kept = suffix.suffix_dedup(docs, REPEAT, keep="text", carry=("lang", "source"))
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item or more go."""
    return tiling.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What op10 returns, of the documents that are left."""
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("repeated substrings", cut_repeats),
    ("benchmark leaks", drop_leaks),
    ("tokens", to_tokens),
]

#: A classifier, components of similar sets and BPE have no counterpart in SQL; tests/llm compares run() with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; between them Parquet in the folder that all machines share."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shards.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
