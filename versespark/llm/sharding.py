"""Two-pass external shuffle of records into shards, in DataFrame expressions only.

Pass one scatters records into buckets of about ``bucket_bytes`` by a seeded hash and writes them to
the shared folder. Pass two gathers each bucket in a task of its own, whose memory it fits by construction,
shuffles it (Spark's ``shuffle`` is a Fisher-Yates shuffle of the array) and deals the whole
permuted sequence out to the shards in turn, so the shards' row counts are at most one apart.

The hash covers the key columns and the row's place in the scan, so repeated keys and
repeated rows, even a third of the table, spread over all buckets. Buckets are sorted before they are shuffled,
so a retried task draws the same permutation.

Defined cases: null keys hash like any value; an empty table gives no rows; every other column,
of any sortable type, is carried in a struct, so names cannot clash with ``bucket``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

BUCKET_BYTES = 16 << 20


def record_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes while it is moved: its strings and binaries, and eight for any other column."""
    sizes = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)).cast("long") for f in df.schema
             if isinstance(f.dataType, T.StringType | T.BinaryType)]
    return sum(sizes, F.lit(16 + 8 * len(df.columns)).cast("long"))


def scatter(records: DataFrame, keys: list[str], seed: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """Pass one: the written table (bucket, item), item being (hash, place, record), and the number of buckets.

    Buckets are as large as what is moved. A partition holds every ``m``-th bucket, placed by number and not by another hash, so that
    partitions are as even as the buckets are.
    """
    total = records.agg(F.sum(record_bytes(records))).first()[0] or 0
    n = max(1, math.ceil(total / bucket_bytes))
    m = min(n, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n = m * math.ceil(n / m)
    place = F.monotonically_increasing_id()
    items = records.select(F.struct(
        F.xxhash64(F.lit(seed), *keys).alias("hash"), place.alias("place"),
        F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias("record")).alias("item"))
    dealt = items.select(
        F.pmod(F.xxhash64("item.hash", "item.place"), F.lit(n)).cast("int").alias("bucket"), "item")
    return written(dealt.repartitionById(m, F.pmod("bucket", F.lit(m)).cast("int")), "scattered"), n


def offsets_of(counts: DataFrame, n: int) -> DataFrame:
    """(bucket, offset): rows before each bucket, by sums of runs of buckets, so that no task orders them all."""
    run = F.floor(F.col("bucket") / max(1, math.isqrt(n))).cast("int")
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("run", run)
    runs = counts.groupBy("run").agg(F.sum("n").alias("m")).select("run", F.coalesce(F.sum("m").over(before("run")), F.lit(0)).alias("first"))
    return counts.withColumn("inside", F.coalesce(F.sum("n").over(before("run", "bucket")), F.lit(0))).join(runs, "run").select(
        "bucket", (F.col("first") + F.col("inside")).alias("offset"))


def shuffled(records: DataFrame, keys: list[str], n_shards: int = 24, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``records`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard)."""
    table, n = scatter(records, keys, seed, bucket_bytes)
    offsets = offsets_of(table.groupBy("bucket").agg(F.count("*").alias("n")), n)
    buckets = table.repartitionById(n, "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list("item")).alias("items"))
    mixed = buckets.join(F.broadcast(offsets), "bucket").select("offset", F.shuffle("items", seed).alias("items"))  # a row a bucket
    dealt = mixed.select("offset", F.posexplode("items").alias("at", "item"))
    rank = F.col("offset") + F.col("at")
    return dealt.select(
        "item.record.*", (rank % n_shards).cast("int").alias("shard"),
        F.floor(rank / n_shards).cast("long").alias("slot"))


def write_shards(records: DataFrame, keys: list[str], path: str, **options) -> None:
    """Write the shuffled records, one folder a shard, each file a run of slots in order."""
    out = shuffled(records, keys, **options)
    n = options.get("n_shards", 24)
    (out.repartition(4 * n, "shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
