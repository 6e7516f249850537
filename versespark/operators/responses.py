"""Language-model prompts and responses: prompts, calls, JSON payloads, references and scores."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.refs import CANONICAL, parse_free_form, split_candidates, strip
from .evaluate import best_scores

#: Keys of an object under which a list of matches may stand, in this order.
LIST_KEYS = ("matches", "references", "predictions", "items", "results")
CODES_PER_LINE = 16


def _strict(text: Column) -> Column:
    """The VARIANT of a text that is JSON as a whole, else null; the parser alone would ignore trailing text."""
    wrapped = F.try_parse_json(F.concat(F.lit('{"p":'), text, F.lit(',"z":1}')))
    whole = (F.try_variant_get(wrapped, "$.z", "int") == 1) & (F.size(F.json_object_keys(F.to_json(wrapped))) == 2)
    return F.when(whole, F.try_variant_get(wrapped, "$.p", "variant"))


def extract_payload(response: Column) -> Column:
    """VARIANT of the first JSON found: the text without code fence, else the greedy {...}, else the greedy [...]."""
    text = strip(F.coalesce(response, F.lit("")))
    text = strip(F.regexp_replace(F.regexp_replace(text, r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))
    found = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))
    return F.coalesce(_strict(text), _strict(found(r"\{[\s\S]*\}")), _strict(found(r"\[[\s\S]*\]")))


def match_list(payload: Column) -> Column:
    """array<variant>: the payload if a list, else the first key whose value is a list."""
    lists = [F.try_variant_get(payload, "$", "array<variant>")]
    lists += [F.try_variant_get(payload, f"$.{key}", "array<variant>") for key in LIST_KEYS]
    found = F.coalesce(*lists)
    return F.filter(found, lambda e: F.startswith(F.schema_of_variant(e), F.lit("OBJECT")))


def match_reference(match: Column) -> Column:
    """The value of ``reference`` if the key is there, whatever it is, else that of ``ref``; an explicit null is the word None."""
    held = lambda key: F.try_variant_get(match, f"$.{key}", "variant")
    text = lambda key: F.when(F.is_variant_null(held(key)), "None").otherwise(F.try_variant_get(match, f"$.{key}", "string"))
    return F.nullif(strip(F.when(held("reference").isNotNull(), text("reference")).when(held("ref").isNotNull(), text("ref"))), F.lit(""))


def match_confidence(match: Column) -> Column:
    """The confidence key, else the score key, else 0.5; an explicit null or a non-number is 0.5; within [0, 1]."""
    confidence, score = F.try_variant_get(match, "$.confidence", "variant"), F.try_variant_get(match, "$.score", "variant")
    number = F.when(confidence.isNotNull(), F.try_variant_get(match, "$.confidence", "double")).when(
        score.isNotNull(), F.try_variant_get(match, "$.score", "double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.5))))


def extract_matches(responses: DataFrame) -> DataFrame:
    """(problem_id, chunk_index, raw_reference, confidence) of (problem_id, chunk_index, response) rows."""
    rows = responses.select("problem_id", "chunk_index", F.explode(match_list(extract_payload(F.col("response")))).alias("m"))
    rows = rows.select("problem_id", "chunk_index", match_reference(F.col("m")).alias("raw_reference"), match_confidence(F.col("m")).alias("confidence"))
    return rows.where("raw_reference IS NOT NULL")


def verse_index(verses: DataFrame) -> DataFrame:
    """Distinct (book, chapter, verse) of canonical references."""
    ref = F.col("reference")
    return verses.where(ref.rlike(CANONICAL)).select(
        F.regexp_extract(ref, CANONICAL, 1).alias("book"), F.regexp_extract(ref, CANONICAL, 2).cast("int").alias("chapter"),
        F.regexp_extract(ref, CANONICAL, 3).cast("int").alias("verse")).distinct()


def verse_runs(index: DataFrame) -> DataFrame:
    """(book, chapter, run_start, run_end): the maximal runs of consecutive verses in ``index`` (book, chapter, verse)."""
    order = Window.partitionBy("book", "chapter").orderBy("verse")
    rows = index.distinct().withColumn("_island", F.col("verse") - F.row_number().over(order))
    return rows.groupBy("book", "chapter", "_island").agg(F.min("verse").alias("run_start"), F.max("verse").alias("run_end")).drop("_island")


#: Width in verses of the bins in which ranges and runs meet.
BIN = 64


def range_intervals(ranges: DataFrame, index: DataFrame) -> DataFrame:
    """Add ``first`` and ``last``: what (book, chapter, verse_start, verse_end) names, as stretches of existing verses; the range as it is
    if the chapter is unknown. A range without a verse, or whose end is before its start, gives no row; the length of a range costs nothing.

    Ranges are clipped to their chapter, then meet its runs in bins; a pair that shares several bins counts in the first one.
    """
    runs = verse_runs(index)
    bounds = runs.groupBy("book", "chapter").agg(F.min("run_start").alias("_low"), F.max("run_end").alias("_high"))
    known, bin_of = F.col("_low").isNotNull(), (lambda c: F.floor(F.col(c) / BIN).cast("int"))
    rows = ranges.join(bounds, ["book", "chapter"], "left").withColumns({
        "_first": F.when(known, F.greatest("verse_start", "_low")).otherwise(F.col("verse_start")),
        "_last": F.when(known, F.least("verse_end", "_high")).otherwise(F.col("verse_end"))}).where("_first <= _last")
    bins = F.when(known, F.sequence(bin_of("_first"), bin_of("_last"))).otherwise(F.array(F.lit(None).cast("int")))
    rows = rows.withColumn("_bin", F.explode(bins))
    held = runs.withColumn("_bin", F.explode(F.sequence(bin_of("run_start"), bin_of("run_end"))))
    met = rows.join(held, ["book", "chapter", "_bin"], "left")
    first, last = F.greatest("_first", F.coalesce("run_start", "_first")), F.least("_last", F.coalesce("run_end", "_last"))
    met = met.withColumns({"first": first, "last": last})
    here = F.col("run_start").isNotNull() & (F.col("first") <= F.col("last")) & (bin_of("first") == F.col("_bin"))
    return met.where(F.col("_low").isNull() | here).drop("_low", "_high", "_first", "_last", "_bin", "run_start", "run_end")


#: Verses that one array holds while a stretch is spread into rows.
SPREAD = 10_000


def expand_intervals(intervals: DataFrame) -> DataFrame:
    """A row with ``verse`` and ``reference`` for each verse from ``first`` to ``last``, in parts, so that no array grows with a stretch."""
    first, last = F.col("first").cast("long"), F.col("last").cast("long")
    rows = intervals.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((last - first) / SPREAD))))
    begin = first + F.col("_part") * SPREAD
    rows = rows.withColumn("verse", F.explode(F.sequence(begin, F.least(begin + (SPREAD - 1), last)))).drop("_part", "first", "last").withColumn("verse", F.col("verse").cast("int"))
    return rows.withColumn("reference", F.concat("book", F.lit("_"), F.col("chapter").cast("string"), F.lit(":"), F.col("verse").cast("string")))


def expand_ranges(ranges: DataFrame, index: DataFrame) -> DataFrame:
    """Add ``verse`` and ``reference``: each existing verse of (book, chapter, verse_start, verse_end); all of them if the chapter is unknown."""
    return expand_intervals(range_intervals(ranges, index))


def score_intervals(responses: DataFrame, index: DataFrame, aliases: Mapping[str, str], allowed: Iterable[str]) -> DataFrame:
    """(problem_id, book, chapter, first, last, score): the best confidence of every stretch of verses that responses name."""
    rows = extract_matches(responses).select("problem_id", "confidence", F.explode(split_candidates(F.col("raw_reference"))).alias("raw"))
    rows = rows.select("problem_id", "confidence", parse_free_form(F.col("raw"), aliases, allowed).alias("r")).where("r IS NOT NULL")
    found = range_intervals(rows.select("problem_id", F.col("confidence").alias("score"), "r.*"), index)
    return found.groupBy("problem_id", "book", "chapter", "first", "last").agg(F.max("score").alias("score"))


def score_responses(responses: DataFrame, index: DataFrame, aliases: Mapping[str, str], allowed: Iterable[str]) -> DataFrame:
    """(problem_id, reference, score, method): the best confidence of every resolved reference. Stretches become references last."""
    rows = expand_intervals(score_intervals(responses, index, aliases, allowed))
    return best_scores(rows).withColumn("method", F.lit("direct_prompting"))


def code_block(codes: Iterable[str]) -> str:
    codes = sorted(codes)
    return "\n".join(", ".join(codes[i:i + CODES_PER_LINE]) for i in range(0, len(codes), CODES_PER_LINE))


def prompts(chunks: DataFrame, codes: Iterable[str], instruction: str) -> DataFrame:
    """(problem_id, chunk_index, system, human): one request per chunk."""
    system = f"{instruction}\nBook codes:\n{code_block(codes)}"
    return chunks.select("problem_id", "chunk_index", F.lit(system).alias("system"), F.col("text").alias("human"))


def message_text(content: Column) -> Column:
    """Text of a message VARIANT: a string, or a list of strings and {text} parts joined by newlines."""
    parts = F.transform(F.try_variant_get(content, "$", "array<variant>"), lambda p: F.coalesce(
        F.when(F.startswith(F.schema_of_variant(p), F.lit("OBJECT")), F.try_variant_get(p, "$.text", "string")),
        F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string"))))
    return F.coalesce(F.array_join(parts, "\n"), F.try_variant_get(content, "$", "string"))


def call_model(requests: DataFrame, complete: Callable[[str, str], str]) -> DataFrame:
    """(problem_id, chunk_index, response, error) by a pluggable ``complete(system, human)``; a failed call keeps its error."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for problem, index, system, human in frame[["problem_id", "chunk_index", "system", "human"]].itertuples(index=False, name=None):
                try:
                    rows.append((problem, index, complete(system, human), None))
                except Exception as e:  # noqa: BLE001  whatever the client raises
                    rows.append((problem, index, None, str(e)))
            yield pd.DataFrame(rows, columns=["problem_id", "chunk_index", "response", "error"])

    return requests.mapInPandas(run, "problem_id string, chunk_index int, response string, error string")
