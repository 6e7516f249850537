"""Vector collections in buckets: an upsert reads and rewrites only the buckets that its rows fall in, and counts all at once or not at all.

A folder holds ``data/<write>/bucket=<b>`` and ``manifest/<version>.json``, which names each bucket's place. A manifest is written last, as a new file;
readers take the newest, so a job that stops before leaves the version before. Two writers of one version cannot both
succeed. Places that no manifest names any more stay until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import exists, upsert

#: Buckets of a new collection table; fixed from then on.
BUCKETS = 64


def _store(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, folder: str) -> dict:
    """The newest manifest: version, number of buckets, and each bucket's place within the folder."""
    path, store = _store(spark, folder)
    if not exists(spark, f"{folder}/manifest"):
        return {"version": 0, "buckets": BUCKETS, "places": {}}
    versions = [int(f.getPath().getName()[:-5]) for f in store.listStatus(path(f"{folder}/manifest")) if f.getPath().getName().endswith(".json")]
    if not versions:
        return {"version": 0, "buckets": BUCKETS, "places": {}}
    return json.loads("\n".join(r["value"] for r in spark.read.text(f"{folder}/manifest/{max(versions)}.json").collect()))


def _commit(spark: SparkSession, folder: str, held: dict) -> None:
    path, store = _store(spark, folder)
    draft = path(f"{folder}/manifest/_{uuid.uuid4().hex}")
    stream = store.create(draft, False)
    stream.write(bytearray(json.dumps(held).encode()))
    stream.close()
    target = path(f"{folder}/manifest/{held['version']}.json")
    if store.exists(target) or not store.rename(draft, target):
        raise RuntimeError(f"another job has written version {held['version']} of {folder}")


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("collection_name", "id"), F.lit(buckets)).cast("int")


def upsert_into(new: DataFrame, folder: str, buckets: int = BUCKETS) -> list[int]:
    """Put ``new`` (collection_name, id, row_index, ...) into the collections at ``folder`` as ``files.upsert`` does; the buckets rewritten."""
    spark, held = new.sparkSession, manifest(new.sparkSession, folder)
    buckets = held["buckets"] if held["version"] else buckets
    touched = sorted(r[0] for r in new.select(bucket_of(buckets)).distinct().collect())  # ``buckets`` rows at most
    if not touched:
        return []
    old = [f"{folder}/{held['places'][str(b)]}" for b in touched if str(b) in held["places"]]
    before = spark.read.schema(new.schema).parquet(*old) if old else spark.createDataFrame([], new.schema)
    write = f"data/{uuid.uuid4().hex}"
    upsert(before, new).withColumn("_bucket", bucket_of(buckets)).repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{folder}/{write}")
    places = held["places"] | {str(b): f"{write}/_bucket={b}" for b in touched}
    _commit(spark, folder, {"version": held["version"] + 1, "buckets": buckets, "places": places})
    return touched


def read_collections(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """All rows of the newest version; an empty table of ``schema`` where there is none."""
    places = sorted(manifest(spark, folder)["places"].values())
    if not places:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(*[f"{folder}/{p}" for p in places])


def vacuum(spark: SparkSession, folder: str) -> int:
    """Delete the places that the newest manifest does not name; how many. Only where no job reads an older version."""
    path, store = _store(spark, folder)
    named, gone = set(manifest(spark, folder)["places"].values()), 0
    for write in store.listStatus(path(f"{folder}/data")):
        for part in store.listStatus(write.getPath()):
            name = f"data/{write.getPath().getName()}/{part.getPath().getName()}"
            if part.isDirectory() and name not in named:
                gone += bool(store.delete(part.getPath(), True))
    return gone
