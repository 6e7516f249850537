"""Readers and writers of problems, gold spans, verses, mappings, reuse output and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.refs import build_reference, normalize_alias, strip

SPAN = "span_start INT, span_end INT, resolved_references ARRAY<STRING>"
VERSE = "book_code STRING, chapter_number INT, verse_index INT, text STRING"
WITNESS = "id STRING, matches DOUBLE, alg STRING, alg2 STRING, begin INT, begin2 INT, text STRING"
REUSE = f"id STRING, text STRING, lines ARRAY<STRUCT<text STRING, wits ARRAY<STRUCT<{WITNESS}>>>>"
TASK_CHUNK = "id STRING, group STRING, problem_id STRING, chunk_index INT, chunk_start INT, chunk_end INT, text STRING"
VERSE_RECORD = "id STRING, group STRING, reference STRING, text STRING"
PREDICTION = "problem_id STRING, reference STRING, score DOUBLE, method STRING"


def _stem(extension: str):
    return F.regexp_extract("_metadata.file_name", rf"^(.*)\.{extension}$", 1)


def exists(spark: SparkSession, folder: str) -> bool:
    """Is there a file or folder at that place of Spark's stores?"""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _whole_files(spark: SparkSession, folder: str, extension: str, may_miss: bool = False) -> DataFrame:
    """One row per file; a folder without such files has none, a missing one is an error unless ``may_miss``."""
    if may_miss and not exists(spark, folder):
        return spark.createDataFrame([], "value STRING, _metadata STRUCT<file_name: STRING>")
    return spark.read.text(folder, wholetext=True, pathGlobFilter=f"*.{extension}")


def read_problems(spark: SparkSession, folder: str) -> DataFrame:
    """(problem_id, text): one row per ``*.txt`` file."""
    return _whole_files(spark, folder, "txt").select(_stem("txt").alias("problem_id"), F.col("value").alias("text"))


def read_xml(spark: SparkSession, folder: str) -> DataFrame:
    """(problem_id, xml): one row per ``*.xml`` file; parsing is up to the caller."""
    return _whole_files(spark, folder, "xml").select(_stem("xml").alias("problem_id"), F.col("value").alias("xml"))


def read_solutions(spark: SparkSession, folder: str, tolerant: bool = False) -> DataFrame:
    """(problem_id, span_index, span_start, span_end, resolved_references) of JSON arrays, one file per problem.

    ``tolerant``: a missing folder, and files that do not parse or hold no array, give no rows; otherwise they end the job.
    """
    whole = _whole_files(spark, folder, "json", tolerant).select(_stem("json").alias("problem_id"), "value")
    spans = F.from_json("value", f"array<struct<{SPAN.replace(' INT', ': INT').replace(' ARRAY', ': ARRAY')}>>",
                        {"mode": "PERMISSIVE" if tolerant else "FAILFAST"})
    rows = whole.where(F.btrim("value").startswith("[")) if tolerant else whole
    return rows.select("problem_id", F.posexplode(spans).alias("span_index", "s")).select(
        "problem_id", "span_index", "s.*").where("span_start IS NOT NULL OR span_end IS NOT NULL OR resolved_references IS NOT NULL")


def read_verses(spark: SparkSession, path: str) -> DataFrame:
    """A TSV with header; numbers must parse. Adds ``reference``; missing text is empty."""
    rows = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True, schema=VERSE,
                          mode="FAILFAST", enforceSchema=False)
    return rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn(
        "reference", build_reference(F.col("book_code"), F.col("chapter_number"), F.col("verse_index")))


def book_codes(verses: DataFrame) -> DataFrame:
    return verses.select(F.lower(strip(F.col("book_code"))).alias("book_code")).where("book_code <> ''").distinct()


def read_abbreviations(spark: SparkSession, path: str) -> DataFrame:
    """(abbrev, book_code) of a JSON object."""
    return spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json("value", "map<string,string>")).alias("abbrev", "book_code"))


def book_aliases(mapping: DataFrame) -> DataFrame:
    """(alias, book_code) of (row_no, book_code, work_name) rows: codes and names are aliases, later rows win."""
    code = F.lower(strip(F.col("book_code")))
    rows = mapping.select("row_no", code.alias("code"), F.explode(F.array("book_code", "work_name")).alias("name"))
    rows = rows.where("code <> '' AND name IS NOT NULL").select(normalize_alias(F.col("name")).alias("alias"), "code", "row_no")
    return rows.where("alias <> ''").groupBy("alias").agg(F.max_by("code", "row_no").alias("book_code"))


def read_book_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Aliases of a TSV with header; no book code at all is an error."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="book_code STRING, work_name STRING", enforceSchema=False)
    aliases = book_aliases(rows.withColumn("row_no", F.monotonically_increasing_id()))
    if aliases.isEmpty():
        raise ValueError(f"no book codes in {path}")
    return aliases


def read_jsonl(spark: SparkSession, path: str, schema: str, skip_bad: bool = False) -> DataFrame:
    return spark.read.json(path, schema=schema, mode="DROPMALFORMED" if skip_bad else "FAILFAST")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_reuse_output(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.json(f"{folder}/out.json", schema=REUSE)


def write_dataset(problems: DataFrame, spans: DataFrame, folder: str) -> None:
    """Problems with a span, and all spans, as two tables keyed by problem_id."""
    problems.join(spans.select("problem_id").distinct(), "problem_id", "left_semi").write.mode("overwrite").parquet(f"{folder}/problems")
    spans.write.mode("overwrite").parquet(f"{folder}/solutions")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def in_prediction_order(predictions: DataFrame, by_score: bool = True) -> DataFrame:
    """Score descending within a problem, ties by reference; or by (problem_id, reference)."""
    return predictions.orderBy("problem_id", *([F.desc("score")] if by_score else []), "reference")


def per_problem(predictions: DataFrame) -> DataFrame:
    """(problem_id, predictions): all predictions of a problem, best first."""
    rows = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "reference", "score", "method")))
    return predictions.groupBy("problem_id").agg(F.transform(rows, lambda x: F.struct(
        x["reference"].alias("reference"), x["score"].alias("score"), x["method"].alias("method"))).alias("predictions"))


def write_results(predictions: DataFrame, matches: DataFrame | None, folder: str, by_score: bool = True) -> None:
    """Predictions in their order, which for the reuse method is not ``by_score`` but by problem and reference, and matches as they come."""
    in_prediction_order(predictions, by_score).write.mode("overwrite").json(f"{folder}/predictions")
    if matches is not None:
        matches.write.mode("overwrite").json(f"{folder}/matches")


def append_run(spark: SparkSession, path: str, method: str, parameters: dict, metrics: DataFrame, produced: int) -> DataFrame:
    """Append one row of parameters and metrics to the run table, partitioned by method."""
    import json

    row = metrics.select(
        F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss").alias("run_id"), F.lit(method).alias("method"),
        F.lit(json.dumps(parameters, sort_keys=True)).alias("parameters"), "*", F.lit(produced).alias("predictions_produced"))
    row.write.mode("append").partitionBy("method").parquet(path)
    return row


def write_report(statistics: DataFrame, path: str) -> None:
    statistics.coalesce(1).write.mode("overwrite").json(path)


#: Rows of one reference that one task numbers, where row_index is dense.
NUMBERED_ROWS = 1_000_000


def unique_ids(rows: DataFrame) -> DataFrame:
    """Add ``id``: the reference, ``ref__1``, ``ref__2`` for repeats by row_index; an empty one is ``row_<i>``.

    Rows of a reference are numbered within stretches of row_index, and the counts of earlier stretches are added, so that
    a reference that many rows share is no single task.
    """
    base = F.when(F.coalesce("reference", F.lit("")) == "", F.concat(F.lit("row_"), F.col("row_index").cast("string"))).otherwise(F.col("reference"))
    packed = rows.select(F.struct(*rows.columns).alias("row"), base.alias("base"), F.floor(F.col("row_index") / NUMBERED_ROWS).alias("stretch"))
    before = Window.partitionBy("base").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = packed.groupBy("base", "stretch").agg(F.count("*").alias("n")).where("base IS NOT NULL")
    earlier = counts.select("base", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")).where("earlier > 0")
    inside = F.row_number().over(Window.partitionBy("base", "stretch").orderBy("row.row_index")) - 1
    numbered = packed.withColumn("inside", inside).join(earlier, ["base", "stretch"], "left")
    n = F.col("inside") + F.coalesce("earlier", F.lit(0))
    return numbered.select("row.*", F.when(n == 0, F.col("base")).otherwise(F.concat("base", F.lit("__"), n.cast("string"))).alias("id"))


def upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace those of the same collection and id; of several in ``new`` the one of the largest row_index stays."""
    order = Window.partitionBy("collection_name", "id").orderBy(F.desc("row_index"))
    new = new.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return existing.join(new.select("collection_name", "id").distinct(), ["collection_name", "id"], "left_anti").unionByName(new)


def write_collections(df: DataFrame, path: str) -> None:
    """Replace only the collections that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection_name").parquet(path)


def find_collection(catalogue: DataFrame, provider: str, model: str, prefix: str, name: str | None = None, default: str | None = None) -> DataFrame:
    """One row (collection_name): by identity, else the explicit name, else the default, else the first."""
    same = (F.lower("provider") == provider.lower()) & (F.lower("model_name") == model.lower()) & (F.lower("collection_prefix") == prefix.lower())
    first = lambda test: F.min(F.when(test, F.col("collection_name")))
    return catalogue.agg(F.coalesce(first(same), first(F.col("collection_name") == F.lit(name)),
                                    first(F.col("collection_name") == F.lit(default)), F.min("collection_name")).alias("collection_name"))
