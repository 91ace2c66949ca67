"""From raw documents to token files: five stages, each on all that the one before kept.

1. language ID: documents in none of the learned languages go;
2. SimHash near-dedup: of each group of near copies the document with the smallest doc_id stays;
3. benchmark decontamination: documents that hold a window of a benchmark item go;
4. mixing: sources are repeated and cut to their target weights, whole documents at a time;
5. token ids: what is left is encoded, written in directly addressable codes and read back.

Rows that share a doc_id are one document: where one of them is contaminated, all go. Null texts
and texts without a letter go in the first stage. No stage fails on an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from longspan.llm.op2_language_id import in_known_language
from longspan.llm.op4_token_ids import FEW_KNOWN_BYTES, read_tokens, write_tokens
from longspan.llm.op6_decontaminate import without_benchmark
from longspan.llm.op8_mix import mixed
from longspan.llm.op10_simhash import one_of_each
from longspan.sources.stages import scratch_path, stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Fitted weights, hashes and a trained vocabulary are in the stages, so no SQL states the rows.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return in_known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    write_tokens(docs, path, tokenizer, known_bytes=FEW_KNOWN_BYTES, keep_known=False)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document that is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
