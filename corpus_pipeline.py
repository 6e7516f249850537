"""A cleaning pipeline over ``documents``: each stage works on all that its predecessor kept."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versespark.llm import bpe, decontaminate, language, passages, simhash
from versespark.llm.common import read, shared_dir
from versespark.llm.queries import tokenizer_path

#: Stages in SQL: none can be expressed; tests hold them against brute force.
ORACLE_SQL = None
#: Bytes of an Arrow batch between executors and their Python workers, and Spark's default; a session's own setting stays.
BATCH_CONF, BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20, "67108864b"


def in_small_batches(stage: Callable) -> Callable:
    """The stage, planned with batches of BATCH_BYTES: helpers work on two megabytes of text at a time, so larger batches are only held."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH_CONF, BATCH_DEFAULT) == BATCH_DEFAULT:
            spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language the compressors cannot tell. Null and empty texts and texts without a letter go; equal rows
    share their fate; columns of any name stay as they are; an empty table gives no rows."""
    return language.confident(docs)


@in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of five-word shingle similarity 0.8: the one of the smallest doc_id. Rows without a
    doc_id stay; null, empty and wordless texts are one group; of rows that repeat a kept doc_id only equal ones go."""
    return simhash.first_of_each(docs)


@in_small_batches
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document holds already. Null texts and rows without a doc_id stay as they are; a text that
    is repeated as a whole becomes empty and its row stays; ``n_chars`` follows the text."""
    return passages.strip(docs, passages.repeated_passages(docs))


@in_small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item. Null and empty texts hold none; equal rows share their fate; without a
    benchmark all stay."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


@in_small_batches
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what is left, one row each. Null and empty texts have no tokens and the digests of the empty string."""
    coded = bpe.encode(docs.select("doc_id", "text", "lang", "source"), tokenizer_path())
    return coded.select("doc_id", "lang", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
    ("decontamination", decontamination), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written to the shared folder and read again."""
    docs, base = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
