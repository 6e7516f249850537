"""The library's inputs as views of the given tables: problems, verses, gold spans, vectors, responses, TEI documents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.chunking import chunked_with_offsets
from ..functions.refs import normalize_space
from ..operators import reuse
from ..operators.annotations import escape_markup
from ..sources.shared import written

BOOKS = {"Bench": "bench", "Gen": "gen", "1Cor": "1cor"}
CODES = ["bench", "gen", "1cor"]
ALIASES = {"gen": "gen", "genesis": "gen", "1corinthians": "1cor", "bench": "bench"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("problem_id"), "text")


def verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(
        F.lit("bench").alias("book_code"), F.expr("int(item_id div 10 + 1)").alias("chapter_number"),
        F.expr("int(item_id % 10 + 1)").alias("verse_index"), "text", F.col("item_id").alias("row_index"))
    return rows.withColumn("reference", F.expr("concat('bench_', chapter_number, ':', verse_index)"))


#: Length of the n-gram on which gold verses and problems meet; shorter verses meet them on their first character.
SEED = 8


def gold_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(problem_id, span_index, span_start, span_end, resolved_references): every place where a verse stands verbatim, left to
    right without overlaps of one verse. Problems and verses meet on a verse's first characters, then the text is searched."""
    texts, marks = problems(spark, sf_dir), verses(spark, sf_dir).select("reference", F.col("text").alias("verse")).where("verse <> ''")
    first = lambda n: marks.select("reference", "verse", F.left("verse", F.lit(n)).alias("gram"))
    rows = texts.select(F.col("problem_id").alias("id"), F.lit("task").alias("group"), "text").unionByName(
        first(SEED).where(F.length("verse") >= SEED).select(F.col("reference").alias("id"), F.lit("bible").alias("group"), F.col("gram").alias("text")))
    long = reuse.verse_grams(rows, SEED).where("group = 'task'").select(F.col("id").alias("problem_id"), "gram").distinct()
    pairs = long.join(first(SEED).where(F.length("verse") >= SEED), "gram")
    brief = first(1).where(F.length("verse") < SEED)
    if not brief.isEmpty():  # else no text is taken apart into characters
        pairs = pairs.unionByName(texts.select("problem_id", F.explode(F.array_distinct(F.split("text", ""))).alias("gram")).join(brief, "gram"))
    pairs = pairs.select("problem_id", "reference", "verse")
    quoted = F.concat(F.lit("\\Q"), F.replace("verse", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    found = pairs.join(texts, "problem_id").where(F.contains("text", "verse")).withColumn("parts", F.split("text", quoted, -1))
    starts = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda k: F.aggregate(
        F.slice("parts", 1, k), F.lit(0), lambda n, x: n + F.length(x)) + (k - 1) * F.length("verse"))
    found = found.select("problem_id", "reference", "verse", F.explode(starts).alias("span_start"))
    order = Window.partitionBy("problem_id").orderBy("span_start", "reference")
    return found.select("problem_id", (F.row_number().over(order) - 1).alias("span_index"), "span_start",
                        (F.col("span_start") + F.length("verse")).alias("span_end"), F.array("reference").alias("resolved_references"))


def chunks(spark: SparkSession, sf_dir: str, size: int = 100, overlap: int = 50) -> DataFrame:
    return chunked_with_offsets(problems(spark, sf_dir), "char", char_size=size, char_overlap=overlap, min_chars=25)


def reuse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse.records(chunks(spark, sf_dir), verses(spark, sf_dir))


OPTIONS = reuse.ReuseOptions(n=16)


def shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse.shared_grams(written(reuse.verse_grams(reuse_records(spark, sf_dir), OPTIONS.n), "verse-grams"), OPTIONS)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse.candidate_pairs(written(reuse.verse_grams(reuse_records(spark, sf_dir), OPTIONS.n), "verse-grams"), OPTIONS)


def candidates_of_all_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates without a bound on how many texts an n-gram may stand in."""
    held = written(reuse.verse_grams(reuse_records(spark, sf_dir), OPTIONS.n), "verse-grams")
    return reuse.candidate_pairs(held, replace(OPTIONS, max_df=0))


def reuse_output_of_full_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested output of the whole job over texts that are not cut into chunks."""
    return reuse.detect(chunked_with_offsets(problems(spark, sf_dir), "full", min_chars=25), verses(spark, sf_dir), replace(OPTIONS, max_df=0))


def reuse_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested output of the whole job."""
    return reuse.detect(chunks(spark, sf_dir), verses(spark, sf_dir), OPTIONS)


def exact_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested output whose alignments are the longest runs in common."""
    places = written(shared(spark, sf_dir), "shared-grams")
    rows = written(reuse.records_of(chunks(spark, sf_dir), verses(spark, sf_dir), places.select("verse", "chunk").distinct()), "reuse-rows")
    return reuse.nested_output(reuse.exact_runs(places, rows, OPTIONS.n, OPTIONS.min_align), rows)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reuse.best_pairs(reuse.flatten_output(reuse_output(spark, sf_dir)))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.concat(F.lit("v-"), F.col("vec_id").cast("string")).alias("reference"),
        F.expr("concat('p-', vec_id % 50)").alias("problem_id"), "embedding", "label")


RESPONSE = """CASE conv_id % 4
 WHEN 0 THEN concat('```json\\n{"matches":[{"reference":"bench_', conv_id % 4 + 1, ':', turn + 1, '","confidence":1.7}]}\\n```')
 WHEN 1 THEN concat('{"results":[{"ref":"bench_', conv_id % 7 + 1, ':', turn + 1, '-', turn + 3, '","score":"0.7"}]}')
 WHEN 2 THEN concat('See [{"reference":"Genesis ', conv_id % 9 + 1, ':', turn + 1, '"},{"reference":"bench_1:', turn + 2, '; foo_1:1"}]')
 ELSE text END"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.expr("concat('conv-', conv_id)").alias("problem_id"), F.col("turn").cast("int").alias("chunk_index"), F.expr(RESPONSE).alias("response"))


def tei_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per conversation, one paragraph per turn; words three to six of a turn of eight or more are a quote."""
    words = F.split(normalize_space(F.col("text")), " ")
    part = lambda a, n: escape_markup(F.array_join(F.slice("w", a, n), " "))
    source = F.expr("concat('Bench_', conv_id % 20 + 1, '_', turn + 1, '-', turn + 2)")
    quoted = F.concat(part(1, 2), F.lit(' <quote source="'), source, F.lit('">'), part(3, 4), F.lit("</quote> "), part(7, F.size("w")))
    rows = table(spark, sf_dir, "conversations").withColumn("w", words)
    rows = rows.select("conv_id", "turn", F.concat(F.lit("<p>"), F.when(F.size("w") >= 8, quoted).otherwise(part(1, F.size("w"))), F.lit("</p>")).alias("p"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "p"))), lambda x: x["p"]), "")
    return rows.groupBy("conv_id").agg(body.alias("body")).select(
        F.expr("concat('conv-', conv_id)").alias("problem_id"),
        F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>'), "body", F.lit("</body></text></TEI>")).alias("xml"))


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as documents that do not parse as XML."""
    return table(spark, sf_dir, "pages").select(F.expr("concat('page-', page_id)").alias("problem_id"), F.col("html").alias("xml"))


def bodiless_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that parse and have no body, or a body without paragraphs."""
    xml = F.expr("""CASE WHEN conv_id % 2 = 0 THEN '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text/></TEI>'
      ELSE '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><head>none</head></body></text></TEI>' END""")
    return table(spark, sf_dir, "conversations").where("turn = 0").select(F.expr("concat('bare-', conv_id)").alias("problem_id"), xml.alias("xml"))


def base_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.expr("concat('doc-', doc_id)").alias("problem_id"), F.expr("int(doc_id % 7)").alias("span_start"), F.expr("int(doc_id % 7 + 5)").alias("span_end"),
        F.expr("array('bench_1:2', concat(' BENCH_1:', doc_id % 3 + 1))").alias("references"))


def added_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row in two repeats the base in other order; one in five is invalid."""
    return table(spark, sf_dir, "documents").select(
        F.expr("concat('doc-', doc_id)").alias("problem_id"), F.expr("int(doc_id % 7)").alias("span_start"),
        F.expr("int(doc_id % 7 + CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 5 + doc_id % 2 END)").alias("span_end"),
        F.expr("array(concat('bench_1:', doc_id % 3 + 1), 'bench_1:2', 'bench_1:2')").alias("references"))
