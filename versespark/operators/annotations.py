"""Gold spans, reviewed additions, their merge, and views of spans in their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.refs import normalize_reference_array

ENTRY = ["problem_id", "span_start", "span_end", "references"]


def canonical(spans: DataFrame) -> DataFrame:
    """Distinct valid entries (problem_id, span_start, span_end, references); references sorted, at least one, end > start."""
    rows = spans.select("problem_id", F.col("span_start").try_cast("int").alias("span_start"), F.col("span_end").try_cast("int").alias("span_end"),
                        normalize_reference_array(F.col("references")).alias("references"))
    return rows.where("span_end > span_start AND size(references) > 0").dropDuplicates(ENTRY)


def merge(base: DataFrame, additions: DataFrame) -> DataFrame:
    """Union of both, canonical and distinct; merging again changes nothing."""
    return canonical(base.select(*ENTRY).unionByName(additions.select(*ENTRY)))


def source_labels(entries: DataFrame, base: DataFrame, additions: DataFrame) -> DataFrame:
    """``entries`` with ``label``: solution, add, solution+add or manual."""
    origins = canonical(base).withColumn("origin", F.lit("base")).unionByName(canonical(additions).withColumn("origin", F.lit("add")))
    origins = origins.unionByName(canonical(entries).withColumn("origin", F.lit("entry")))
    has = lambda kind: F.bool_or(F.col("origin") == kind)
    rows = origins.groupBy(*ENTRY).agg(has("base").alias("b"), has("add").alias("a"), has("entry").alias("e")).where("e")
    label = F.when(F.col("b") & F.col("a"), "solution+add").when(F.col("b"), "solution").when(F.col("a"), "add").otherwise("manual")
    return rows.select(*ENTRY, label.alias("label"))


def append_accepted(additions: DataFrame, accepted: DataFrame) -> DataFrame:
    """Accepted matches join the additions; without own references they take that of the match."""
    refs = F.when(F.size(F.coalesce("references", F.array().cast("array<string>"))) > 0, F.col("references")).otherwise(F.array("reference"))
    return merge(additions, accepted.withColumn("references", refs))


def merge_counts(entries: DataFrame) -> DataFrame:
    return entries.agg(F.countDistinct("problem_id").alias("problems"), F.count("*").alias("rows"))


def span_preview(spans: DataFrame, problems: DataFrame, context: int = 50) -> DataFrame:
    """Spans with validity, quote, contexts and snippet; problems without text are left out."""
    text, n = F.col("text"), F.length("text")
    start, end = F.col("span_start"), F.col("span_end")
    valid = F.coalesce((start >= 0) & (start < end) & (end <= n), F.lit(False))
    empty = lambda c: F.when(F.col("valid_span"), c).otherwise("")
    left = F.greatest(start - context, F.lit(0))
    rows = spans.join(problems, "problem_id").withColumn("valid_span", valid)
    rows = rows.select(
        "problem_id", "span_index", "span_start", "span_end", F.when(F.col("valid_span"), end - start).alias("span_length"), "valid_span",
        empty(F.substring(text, start + 1, end - start)).alias("quote_text"),
        empty(F.substring(text, left + 1, start - left)).alias("left_context"),
        empty(F.substring(text, end + 1, F.lit(context))).alias("right_context"), "resolved_references")
    return rows.withColumn("visual_snippet", empty(F.concat("left_context", F.lit("["), "quote_text", F.lit("]"), "right_context")))


def skipped_spans(spans: DataFrame, problems: DataFrame) -> DataFrame:
    """(problem_id, spans): the problems without text that spans name, whose spans no preview shows, and how many they are."""
    return spans.join(problems.select("problem_id").distinct(), "problem_id", "left_anti").groupBy("problem_id").agg(F.count("*").alias("spans"))


def verse_text_pairs(spans: DataFrame, verses: DataFrame) -> DataFrame:
    """(problem_id, span_index, pairs): ``ref :: text`` of each reference in order, ``[MISSING]`` if unknown."""
    rows = spans.select("problem_id", "span_index", F.posexplode("resolved_references").alias("pos", "reference"))
    rows = rows.join(verses.select("reference", F.col("text").alias("_verse")).dropDuplicates(["reference"]), "reference", "left")
    pair = F.concat("reference", F.lit(" :: "), F.coalesce("_verse", F.lit("[MISSING]")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", pair.alias("pair"))))
    return rows.groupBy("problem_id", "span_index").agg(F.array_join(F.transform(ordered, lambda x: x["pair"]), " || ").alias("pairs"))


def similar_text(neighbours: DataFrame) -> DataFrame:
    """(reference, similar): ``ref => [cand (0.873), ...]`` of (query_id, reference, similarity, rank) rows."""
    one = F.concat("reference", F.lit(" ("), F.format_string("%.3f", "similarity"), F.lit(")"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", one.alias("one"))))
    return neighbours.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["one"]), ", ").alias("all")).select(
        F.col("query_id").alias("reference"), F.concat("query_id", F.lit(" => ["), "all", F.lit("]")).alias("similar"))


def validation_preview(spans: DataFrame, problems: DataFrame, context: int = 50, verses: DataFrame | None = None,
                       neighbours: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """The preview table, in document order, with verse texts and similar verses if asked for."""
    rows = span_preview(spans, problems, context)
    if verses is not None:
        rows = rows.join(verse_text_pairs(spans, verses), ["problem_id", "span_index"], "left").withColumnRenamed("pairs", "resolved_reference_text_pairs")
    if neighbours is not None:
        refs = spans.select("problem_id", "span_index", F.posexplode("resolved_references").alias("pos", "reference")).join(similar_text(neighbours), "reference", "left")
        line = F.coalesce("similar", F.concat("reference", F.lit(" => []")))
        ordered = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
        refs = refs.groupBy("problem_id", "span_index").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), " || ").alias("resolved_reference_top_similar"))
        rows = rows.join(refs, ["problem_id", "span_index"], "left")
    rows = rows.withColumn("resolved_references", F.array_join("resolved_references", ", ")).withColumnRenamed("problem_id", "document")
    rows = rows.orderBy(F.asc_nulls_last("document"), F.asc_nulls_last("span_start"), F.asc_nulls_last("span_end"), "span_index")
    return rows.limit(most) if most else rows


def escape_markup(text: Column, quotes: bool = False) -> Column:
    text = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(text, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;")) if quotes else text


def mark_snippet(snippet: Column) -> Column:
    return F.regexp_replace(escape_markup(snippet), r"\[(.*?)\]", "<mark>$1</mark>")


def mark_slice(text: Column, start: Column, end: Column) -> Column:
    n = F.length(text)
    a = F.greatest(F.lit(0), F.least(start, n))
    b = F.greatest(a, F.least(end, n))
    part = lambda i, j: escape_markup(F.substring(text, i + 1, j - i), quotes=True)
    return F.concat(part(F.lit(0), a), F.lit("<mark>"), part(a, b), F.lit("</mark>"), part(b, n))


def clip_highlights(spans: DataFrame, problems: DataFrame) -> DataFrame:
    """(problem_id, span_start, span_end): spans within the text, each cut where an earlier one reaches."""
    n = F.length("text")
    rows = spans.join(problems, "problem_id").select(
        "problem_id", F.greatest(F.lit(0), F.least("span_start", n)).alias("s"), F.greatest(F.lit(0), F.least("span_end", n)).alias("e"))
    before = Window.partitionBy("problem_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("s", F.greatest("s", F.coalesce(F.max("e").over(before), F.lit(0))))
    return rows.where("e > s").select("problem_id", F.col("s").alias("span_start"), F.col("e").alias("span_end"))


def dataset_overview(**tables: DataFrame) -> DataFrame:
    """(name, n): rows of each table."""
    out = None
    for name, table in sorted(tables.items()):
        row = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out
