"""From raw documents to token ids: quality, near-duplicates, passages, mixture, encoding.

Every stage takes what the one before kept, written as Parquet and read again. ``docs`` has the
columns of ``documents``; all stages but the last return these.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.llm import bpe, chunks, mixing, quality, simhash
from tideline.plans.scratch import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose SimHashes of three-word shingles link at 3 bits or fewer the least id stays."""
    return simhash.keep_one(docs, words=3, radius=3)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; ``n_chars`` follows the text."""
    cut = chunks.dedup(docs).select(docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast("long"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target rate has it, in a global random order."""
    return mixing.mix(docs, seed=17, alpha=0.5).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; ``intact`` says that they decode to its text."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    model = bpe.share(spark, ranks, public_tokenizers.PATTERN)
    coded = bpe.decode(bpe.encode(docs, model), model)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select(
        "doc_id", "lang", "source", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids", same.alias("intact")
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("source mixture", source_mixture),
    ("token ids", token_ids),
]

# SQL has no 64-bit XXH64 shingles, gear hashes or merges; the stages are tested by themselves.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
