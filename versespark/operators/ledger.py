"""Model calls that are paid for once: answers are kept in a table by a digest of what was asked, and a job that was stopped goes on from there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import exists
from ..sources.shared import written
from .knn import embed_texts
from .responses import call_model

#: Distinct requests that are called and committed together: what a stopped job loses at most.
BATCH_ROWS = 10_000


def digest(model: str, *columns: str) -> Column:
    """What a request is known by: the model's name and all that it is asked; null and empty are told apart."""
    return F.sha2(F.to_json(F.struct(F.lit(model).alias("model"), *columns), {"ignoreNullFields": "false"}), 256)


def _answers(spark: SparkSession, ledger: str, schema: str) -> DataFrame:
    """(key, answer, error): one row a key, an answer before an error."""
    rows = spark.read.schema(schema).parquet(ledger) if exists(spark, ledger) else spark.createDataFrame([], schema)
    best = F.max_by(F.struct("answer", "error"), F.col("error").isNull().cast("int")).alias("x")
    return rows.groupBy("key").agg(best).select("key", "x.answer", "x.error")


def answered(requests: DataFrame, key: Column, ask: Callable[[DataFrame], DataFrame], ledger: str, kind: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """``requests`` with ``answer`` and ``error`` from the table at ``ledger``; ``kind`` is the type of an answer.

    ``ask`` gives (key, answer, error) for requests that have a column ``key``. Equal requests are asked once; those with an answer in the
    table are not asked again, those with an error are. The others are asked in batches of about ``batch_rows``, each one job that appends its answers.
    Requests are dealt into batches by their key. The names ``key``, ``answer``, ``error`` must be free.
    """
    spark, schema = requests.sparkSession, f"key string, answer {kind}, error string"
    keyed = requests.withColumn("key", key)
    done = _answers(spark, ledger, schema).where("error IS NULL").select("key")
    open_ = written(keyed.dropDuplicates(["key"]).join(done, "key", "left_anti"), "open-requests")
    batches = -(-open_.count() // batch_rows)
    for batch in range(batches):
        some = open_.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == batch)
        ask(some).select("key", F.col("answer").cast(kind), "error").write.mode("append").parquet(ledger)
    return keyed.join(_answers(spark, ledger, schema), "key", "left").drop("key")


def call_model_once(requests: DataFrame, complete: Callable[[str, str], str], ledger: str, model: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """The rows of ``call_model`` by way of ``answered``."""
    def ask(some: DataFrame) -> DataFrame:
        rows = some.select(F.col("key").alias("problem_id"), F.lit(0).alias("chunk_index"), "system", "human")
        return call_model(rows, complete).select(F.col("problem_id").alias("key"), F.col("response").alias("answer"), "error")

    found = answered(requests, digest(model, "system", "human"), ask, ledger, "string", batch_rows)
    return found.select("problem_id", "chunk_index", F.col("answer").alias("response"), "error")


def embed_texts_once(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], ledger: str, model: str, batch: int = 64,
                     batch_rows: int = BATCH_ROWS) -> DataFrame:
    """The rows of ``embed_texts`` by way of ``answered``; a failing call ends the job and keeps the batches before."""
    def ask(some: DataFrame) -> DataFrame:
        return embed_texts(some.select("key", F.coalesce("text", F.lit("")).alias("text")), embed, batch).select(
            "key", F.col("embedding").alias("answer"), F.lit(None).cast("string").alias("error"))

    asked = rows.withColumn("_asked", F.coalesce("text", F.lit("")))
    return answered(asked, digest(model, "_asked"), ask, ledger, "array<float>", batch_rows).drop("_asked", "error").withColumnRenamed("answer", "embedding")
