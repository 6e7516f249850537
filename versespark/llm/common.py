"""Helpers shared by the operators: shared-folder tables, text batches, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, written  # noqa: F401

#: ASCII white space of a Java character class; ``bytes.split()`` splits on the same bytes.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_on(df: DataFrame, without: DataFrame, columns: list[str], most_rows: int) -> DataFrame:
    """``df`` without the rows whose ``columns`` stand in the written table ``without``, which is broadcast up to a counted
    number of rows and joined by shuffle beyond."""
    gone = without.select(*columns).distinct()
    return df.join(F.broadcast(gone) if without.count() <= most_rows else gone, columns, "left_anti")


def row_key(*columns: str) -> Column:
    """128 bits that identify the content of a row; equal rows share them, and so share any result."""
    whole = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.unhex(F.md5(whole))


def give_back() -> None:
    """Return memory that is held and not used to the system: executors keep their Python workers from stage to stage."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``most_bytes`` of ``column`` each, one row at least; unused memory is given back after the last."""
    sizes = batch.column(column)
    start, held = 0, 0
    for i, value in enumerate(sizes):
        n = len(value.as_buffer()) if value.is_valid else 0
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)
    give_back()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of undirected ``edges`` (a, b: long): rows (node, component), the smallest node.

    Alternates large-star and small-star steps over the edge table; every round is written to the
    shared folder, and only a count and a checksum reach the driver. Hot nodes are summed with
    map-side combine, and the joins back are plain ones that adaptive execution may split.
    Null ends and self loops are ignored; no edges give no rows.
    """
    def smallest(both: DataFrame) -> DataFrame:
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.join(low, "u")

    def checked(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b").distinct(), label)
    seen = checked(e)
    while seen[0]:
        both = e.selectExpr("a AS u", "b AS v").unionByName(e.selectExpr("b AS u", "a AS v"))
        large = smallest(both).where("v > u").selectExpr("v AS a", "m AS b").where("a <> b").distinct()
        down = large.selectExpr("greatest(a, b) AS u", "least(a, b) AS v")
        small = smallest(down).selectExpr("v AS a", "m AS b").unionByName(
            down.groupBy("u").agg(F.min("v").alias("b")).selectExpr("u AS a", "b"))
        e = written(small.where("a <> b").distinct(), label)
        now = checked(e)
        if now == seen:
            break
        seen = now
    members = e.selectExpr("a AS node", "b AS component")
    return members.unionByName(e.selectExpr("b AS node", "b AS component").distinct())
