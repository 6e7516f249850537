"""Registered queries: each applies one operator to whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import refs
from ..functions.chunking import chunked, chunked_with_offsets, token_budget_split
from ..operators import annotations, evaluate, knn, methods, responses, reuse, tei
from ..sources import collections, files
from ..sources.shared import shared_dir, written
from . import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def ref_normalize(spark, d):
    raw = F.expr("concat('  ', upper(lang), '_', doc_id % 50 + 1, ':', n_chars % 30 + 1, '\\t ')")
    return v.table(spark, d, "documents").select("doc_id", refs.normalize_reference(raw).alias("reference"))


@query
def source_resolve(spark, d):
    source = F.expr("concat('CF_Bench_', conv_id % 20 + 1, '_', turn + 1, '-', turn + 3, '; (Gen_0', turn + 1, ':', conv_id % 31 + 1, ') Foo_1_1 gen_1_1 1Cor_13_4.')")
    return v.table(spark, d, "conversations").select(
        "conv_id", "turn", F.array_join(refs.resolve_source(source, v.BOOKS, v.CODES)["references"], " ").alias("resolved"))


@query
def verse_spec_expand(spark, d):
    spec = F.expr("CASE doc_id % 3 WHEN 0 THEN concat('0', doc_id % 20 + 1) WHEN 1 THEN concat(doc_id % 20 + 1, '-', n_chars % 20 + 1) ELSE concat(doc_id, 'x') END")
    found = refs.expand_verse_spec(spec)
    return v.table(spark, d, "documents").select("doc_id", F.array_join(found["verses"], " ").alias("verses"), found["error"].isNotNull().alias("is_error"))


@query
def freeform_parse(spark, d):
    raw = F.expr("""CASE doc_id % 4 WHEN 0 THEN concat(' Genesis ', doc_id % 50 + 1, ':', n_chars % 30 + 1)
      WHEN 1 THEN concat('gen_', doc_id % 50 + 1, ':', n_chars % 30 + 3, '–', n_chars % 7 + 1)
      WHEN 2 THEN concat('1 Corinthians ', doc_id % 16 + 1, ':', n_chars % 30 + 1, '-', n_chars % 30 + 4) ELSE concat('foo_', doc_id, ':1') END""")
    return v.table(spark, d, "documents").select("doc_id", refs.parse_free_form(raw, v.ALIASES, v.CODES).alias("r")).select("doc_id", "r.*")


@query
def chunks_sentence(spark, d):
    return chunked(v.problems(spark, d), "sentence")


@query
def chunks_sentence_window(spark, d):
    return chunked(v.problems(spark, d), "sentence_window")


@query
def chunks_char(spark, d):
    return chunked(v.problems(spark, d), "char")


@query
def chunks_char_offsets(spark, d):
    return chunked_with_offsets(v.problems(spark, d), "char")


@query
def chunks_window_offsets(spark, d):
    return chunked_with_offsets(v.problems(spark, d), "sentence_window")


@query
def token_budget(spark, d):
    return token_budget_split(chunked(v.problems(spark, d), "full"), context=1000, reserve=200, output=100)


@query
def ngram_df(spark, d):
    return reuse.document_frequency(reuse.verse_grams(v.reuse_records(spark, d), 8))


@query
def reuse_candidates(spark, d):
    return v.candidates(spark, d)


@query
def reuse_candidates_unbounded(spark, d):
    return v.candidates_of_all_grams(spark, d)


@query
def reuse_best_full(spark, d):
    """Pairs of the job over whole texts, of which only stretches around chains of hits are aligned."""
    return reuse.best_pairs(reuse.flatten_output(v.reuse_output_of_full_texts(spark, d)))


@query
def passage_groups(spark, d):
    return reuse.passage_groups(v.shared(spark, d), gap=20)


FLAT = ("problem_id", "chunk_index", "reference", "score", "aligned_chunk_start", "aligned_chunk_end", "aligned_verse_start", "aligned_verse_end")


@query
def reuse_flatten(spark, d):
    return reuse.flatten_output(v.reuse_output(spark, d)).select(*FLAT)


@query
def reuse_best(spark, d):
    return reuse.best_pairs(reuse.flatten_output(v.reuse_output(spark, d)))


def _inspected(spark, d, output):
    found = reuse.flatten_output(output)
    chunks = v.chunks(spark, d).join(found.select("problem_id").distinct(), "problem_id", "left_semi").withColumn(
        "chunk_id", refs.chunk_id(F.col("problem_id"), F.col("chunk_index")))
    return reuse.match_inspection(found, chunks, v.verses(spark, d), evaluate.truth_pairs(v.gold_spans(spark, d)))


@query
def match_inspection(spark, d):
    return _inspected(spark, d, v.reuse_output(spark, d))


@query
def exact_flatten(spark, d):
    return reuse.flatten_output(v.exact_output(spark, d)).select(*FLAT)


@query
def exact_best(spark, d):
    return reuse.best_pairs(reuse.flatten_output(v.exact_output(spark, d)))


@query
def exact_inspection(spark, d):
    return _inspected(spark, d, v.exact_output(spark, d))


@query
def review_rows(spark, d):
    """What a reviewer sees: rows that gold does not have, or all above a score, with previews and absolute places."""
    rows = reuse.inspection_filter(_inspected(spark, d, v.exact_output(spark, d)), min_score=20.0, reference_part="bench_")
    span = refs.absolute_span(F.col("chunk_start"), F.col("aligned_chunk_start"), F.col("aligned_chunk_end"))
    return rows.select("problem_id", "chunk_id", "reference", "chunk_preview", "verse_preview", span["span_start"].alias("start"), span["span_end"].alias("end"))


@query
def reuse_detect(spark, d):
    return reuse.flatten_output(v.reuse_output(spark, d))


@query
def run_counts(spark, d):
    chunks, verses = v.chunks(spark, d), v.verses(spark, d)
    flat = reuse.flatten_output(v.exact_output(spark, d))
    return reuse.run_counts(chunks, verses, flat, flat)


def _sides(spark, d):
    """Every hundredth vector as a query, and all as the side that is searched."""
    rows = v.vectors(spark, d)
    return rows.where("vec_id % 100 = 0").withColumn("query_id", F.col("reference")), rows


def _rounded(df):
    return df.withColumn("similarity", F.round("similarity", 6))


def _nearest(rows):
    """The five nearest others of every vector."""
    return knn.self_top_k(rows, k=5, threshold=0.3)


@query
def knn_topk(spark, d):
    return _rounded(_nearest(v.vectors(spark, d)))


@query
def knn_search(spark, d):
    return _rounded(knn.top_k(*_sides(spark, d), k=10, threshold=-1.0))


def _indexed(spark, d):
    queries, side = _sides(spark, d)
    index = knn.fit_cells(side, k=10)
    return queries, side, index, written(knn.assign_cells(side, index), "cells")


@query
def knn_index(spark, d):
    """The search of ``knn_search`` by an inverted file: some neighbours may be missed, similarities are exact."""
    queries, _, index, assigned = _indexed(spark, d)
    return _rounded(knn.search_cells(queries, assigned, index, k=10))


@query
def knn_index_recall(spark, d):
    """The inverted file measured against the exact search: whether nine of ten neighbours are found with fewer comparisons than all pairs."""
    queries, side, index, assigned = _indexed(spark, d)
    exact, found = knn.top_k(queries, side, k=10, threshold=-1.0), knn.search_cells(queries, assigned, index, k=10)
    work = knn.compared_pairs(queries, assigned, index).select((F.col("compared") < queries.count() * side.count()).alias("less_work"))
    return knn.recall_at(exact, found).select("neighbours", (F.col("recall") >= 0.9).alias("reached")).crossJoin(F.broadcast(work))  # one row each


@query
def knn_self(spark, d):
    return _rounded(knn.self_top_k(v.vectors(spark, d), k=2, threshold=0.3))


def _embedding_best(rows):
    near = _nearest(rows).join(rows.select(F.col("reference").alias("query_id"), "problem_id"), "query_id")
    return knn.embedding_pairs(near).withColumn("score", F.round("score", 6))


@query
def embedding_best(spark, d):
    return _embedding_best(v.vectors(spark, d))


@query
def truth_pairs(spark, d):
    return evaluate.truth_pairs(v.gold_spans(spark, d))


@query
def error_sets(spark, d):
    return evaluate.error_sets(evaluate.prediction_pairs(v.predictions(spark, d)), evaluate.truth_pairs(v.gold_spans(spark, d)))


@query
def score_predictions(spark, d):
    return evaluate.evaluate(v.predictions(spark, d), v.gold_spans(spark, d))


@query
def first_n_problems(spark, d):
    chosen = evaluate.first_problems(v.problems(spark, d), 5)
    return evaluate.subset(v.gold_spans(spark, d).select("problem_id", "span_start"), chosen).unionByName(chosen.select("problem_id", F.lit(-1).alias("span_start")))


@query
def quote_stats(spark, d):
    return tei.quote_totals(v.tei_documents(spark, d).unionByName(v.page_documents(spark, d)), v.BOOKS)


def _paragraphs(spark, d):
    return tei.paragraphs(v.tei_documents(spark, d), v.BOOKS, v.CODES)


@query
def dataset_stats(spark, d):
    """Over conversations, and documents that do not parse, have no body, or no paragraph."""
    odd = v.page_documents(spark, d).unionByName(v.bodiless_documents(spark, d))
    return tei.dataset_statistics(tei.paragraphs(v.tei_documents(spark, d).unionByName(odd), v.BOOKS, v.CODES))


@query
def quote_files(spark, d):
    return tei.files_by_count(tei.quote_statistics(v.tei_documents(spark, d), v.BOOKS))


@query
def tei_spans(spark, d):
    return tei.document_spans(_paragraphs(spark, d)).withColumn("resolved_references", F.array_join("resolved_references", " "))


@query
def tei_texts(spark, d):
    return tei.document_texts(_paragraphs(spark, d))


@query
def paragraph_offsets(spark, d):
    return tei.paragraph_offsets(_paragraphs(spark, d)).select("problem_id", "para_no", "offset")


@query
def span_preview(spark, d):
    rows = annotations.span_preview(v.gold_spans(spark, d), v.problems(spark, d), 20)
    return rows.select("problem_id", "span_start", "span_end", "span_length", "valid_span", "quote_text", "left_context", "right_context", "visual_snippet",
                       annotations.mark_snippet(F.col("visual_snippet")).alias("marked"))


@query
def span_validity(spark, d):
    """Spans that fit their text, that begin before it, go beyond it, or have no length; only the fitting ones have a snippet."""
    spans = v.table(spark, d, "documents").select(
        F.expr("concat('doc-', doc_id)").alias("problem_id"), F.lit(0).alias("span_index"), F.expr("int(doc_id % 7 - 2)").alias("span_start"),
        F.expr("int(CASE doc_id % 3 WHEN 0 THEN doc_id % 7 + 5 WHEN 1 THEN length(text) + doc_id % 2 ELSE doc_id % 7 - 2 END)").alias("span_end"),
        F.array().cast("array<string>").alias("resolved_references"))
    return annotations.span_preview(spans, v.problems(spark, d), 20).select("problem_id", "span_start", "span_end", "span_length", "valid_span", "visual_snippet")


@query
def skipped_spans(spark, d):
    """Spans of a corpus of which every third text is gone."""
    return annotations.skipped_spans(v.base_entries(spark, d), v.problems(spark, d).where("int(substring(problem_id, 5)) % 3 <> 0"))


def _words_method(problem_id: str, text: str, context: dict) -> list[dict]:
    if " " not in (text or ""):
        raise ValueError("no words")
    return [{"reference": f"bench_{len(text) % 20 + 1}:{text.count(' ') % 10 + 1}", "score": context["score"], "method": "words"}]


@query
def user_method_table(spark, d):
    """A user's method as a table function in SQL; a problem that fails is a row."""
    methods.register_method(spark, "run_method", _words_method, {"score": 0.5})
    v.problems(spark, d).createOrReplaceTempView("method_problems")
    return spark.sql("SELECT * FROM run_method(TABLE(method_problems) PARTITION BY problem_id)")


@query
def verse_text_pairs(spark, d):
    spans = v.table(spark, d, "documents").select(
        F.expr("concat('doc-', doc_id)").alias("problem_id"), F.lit(0).alias("span_index"),
        F.expr("array(concat('bench_', doc_id % 25 + 1, ':', n_chars % 10 + 1), 'gen_1:1', 'bench_1:1')").alias("resolved_references"))
    return annotations.verse_text_pairs(spans, v.verses(spark, d)).select("problem_id", "pairs")


@query
def highlight_clip(spark, d):
    n = F.length("text")
    pairs = [(F.lit(0), F.lit(5)), (F.lit(3), F.lit(8)), (F.lit(4), F.lit(6)), (n - 3, n + 10), (F.lit(9), F.lit(9))]
    spans = v.problems(spark, d).select("problem_id", F.explode(F.array(*[F.struct(a.alias("s"), b.alias("e")) for a, b in pairs])).alias("x"))
    return annotations.clip_highlights(spans.select("problem_id", F.col("x.s").alias("span_start"), F.col("x.e").alias("span_end")), v.problems(spark, d))


def _flat_refs(df):
    return df.withColumn("references", F.array_join("references", ","))


@query
def merge_solutions(spark, d):
    return _flat_refs(annotations.merge(v.base_entries(spark, d), v.added_entries(spark, d)))


@query
def source_label(spark, d):
    base, added = v.base_entries(spark, d), v.added_entries(spark, d)
    return _flat_refs(annotations.source_labels(annotations.merge(base, added), base, added))


@query
def unique_ids(spark, d):
    rows = v.table(spark, d, "documents").select(
        F.col("doc_id").alias("row_index"), F.expr("CASE WHEN doc_id % 11 = 0 THEN '' ELSE concat(lang, '_', doc_id % 7) END").alias("reference"))
    return files.unique_ids(rows)


@query
def collection_name(spark, d):
    model = F.expr("concat('Org/Model-', n_chars, repeat('-x', int(doc_id % 40)))")
    return v.table(spark, d, "documents").select("doc_id", refs.collection_name(F.col("source"), F.expr("concat('--', lang)"), model).alias("name"))


@query
def vector_upsert(spark, d):
    rows = v.vectors(spark, d).select(F.expr("concat('c', label)").alias("collection_name"), F.col("reference").alias("id"), F.col("vec_id").alias("row_index"), F.lit("old").alias("document"))
    return files.upsert(rows, rows.where("row_index % 3 = 0").withColumn("document", F.lit("new")))


@query
def vector_upsert_buckets(spark, d):
    """The same by way of a table in buckets, of which an upsert rewrites those that it touches."""
    folder = f"{shared_dir(spark)}/collections-{uuid.uuid4().hex}"
    rows = v.vectors(spark, d).select(F.expr("concat('c', label)").alias("collection_name"), F.col("reference").alias("id"), F.col("vec_id").alias("row_index"), F.lit("old").alias("document"))
    collections.upsert_into(rows, folder)
    collections.upsert_into(rows.where("row_index % 3 = 0").withColumn("document", F.lit("new")), folder)
    return collections.read_collections(spark, folder)


@query
def llm_extract(spark, d):
    return responses.extract_matches(v.responses(spark, d))


@query
def llm_best(spark, d):
    return responses.score_responses(v.responses(spark, d), responses.verse_index(v.verses(spark, d)), v.ALIASES, v.CODES)


@query
def verse_index(spark, d):
    return responses.verse_index(v.verses(spark, d))


@query
def verse_range_join(spark, d):
    ranges = v.table(spark, d, "documents").select("doc_id", F.lit("bench").alias("book"), F.expr("int(doc_id % 30 + 1)").alias("chapter"),
                                                   F.expr("int(n_chars % 12 + 1)").alias("verse_start"), F.expr("int(n_chars % 12 + 4)").alias("verse_end"))
    return responses.expand_ranges(ranges, responses.verse_index(v.verses(spark, d))).select("doc_id", "reference")


@query
def verse_intervals(spark, d):
    """Ranges as stretches of existing verses, where one verse in seven is missing; one range in fifty has no end to speak of."""
    ranges = v.table(spark, d, "documents").select("doc_id", F.lit("bench").alias("book"), F.expr("int(doc_id % 30 + 1)").alias("chapter"), F.expr("int(n_chars % 12 + 1)").alias("verse_start"),
                                                   F.expr("CASE WHEN doc_id % 50 = 0 THEN 2000000000 ELSE int(n_chars % 12 + 4) END").alias("verse_end"))
    known = responses.verse_index(v.verses(spark, d).where("row_index % 7 <> 3"))
    return responses.range_intervals(ranges, known).select("doc_id", "chapter", "first", "last")


@query
def dataset_overview(spark, d):
    spans = v.gold_spans(spark, d)
    return annotations.dataset_overview(problems=v.problems(spark, d), solutions=spans, additions=v.added_entries(spark, d),
                                        merged=annotations.merge(v.base_entries(spark, d), v.added_entries(spark, d)))


@query
def absolute_spans(spark, d):
    """Places of matches in their problem: a chunk without a known start counts from zero."""
    rows = v.table(spark, d, "documents").select("doc_id", F.expr("CASE WHEN doc_id % 4 = 0 THEN NULL ELSE int(doc_id % 90) END").alias("c"), F.expr("int(n_chars % 50)").alias("a"))
    return rows.select("doc_id", refs.absolute_span(F.col("c"), F.col("a"), F.col("a") + 7).alias("s")).select("doc_id", "s.*")


@query
def aligned_ends(spark, d):
    """Ends of aligned texts, whose gaps take no place."""
    rows = v.table(spark, d, "documents").select("doc_id", F.expr("int(doc_id % 40)").alias("begin"), F.expr("concat(source, '-', repeat('-', int(doc_id % 5)), lang)").alias("alg"))
    return rows.select("doc_id", refs.aligned_end(F.col("begin"), F.col("alg")).alias("end"))


@query
def highlight_slice(spark, d):
    rows = v.table(spark, d, "documents").select("doc_id", F.expr("concat('<', source, '> & \"', lang, '\"')").alias("text"), F.expr("int(doc_id % 12 - 2)").alias("a"), F.expr("int(n_chars % 20)").alias("b"))
    return rows.select("doc_id", annotations.mark_slice(F.col("text"), F.col("a"), F.col("b")).alias("marked"))


@query
def reference_list(spark, d):
    raw = F.expr("concat(' BENCH_', doc_id % 4, ':1;', lang, '_1:2, ', lang, '_1:2  bench_0:', n_chars % 3)")
    return v.table(spark, d, "documents").select("doc_id", F.array_join(refs.parse_reference_list(raw), " ").alias("references"))


@query
def prompt_rows(spark, d):
    rows = responses.prompts(chunked(v.problems(spark, d), "full"), v.CODES, "Name every verse.")
    return rows.withColumn("chars", F.length("human")).drop("human")


@query
def message_texts(spark, d):
    content = F.expr("""CASE doc_id % 3 WHEN 0 THEN '[]' WHEN 1 THEN concat('["', source, '",{"text":"', lang, '"},7]')
      ELSE concat('"', source, ' ', lang, '"') END""")
    return v.table(spark, d, "documents").select("doc_id", responses.message_text(F.try_parse_json(content)).alias("message"))


@query
def find_collection(spark, d):
    rows = v.table(spark, d, "documents").select(F.concat("source", F.lit("-"), "lang").alias("collection_name"), F.col("source").alias("provider"),
                                                 F.upper("lang").alias("model_name"), F.lit("Base").alias("collection_prefix"))
    return files.find_collection(rows, "SRC1", "de", "base").unionByName(
        files.find_collection(rows, "none", "de", "base", "src2-en")).unionByName(files.find_collection(rows, "none", "none", "base", "none", "none"))


@query
def accepted_matches(spark, d):
    accepted = v.table(spark, d, "documents").where("doc_id % 2 = 0").select(
        F.expr("concat('doc-', doc_id)").alias("problem_id"), F.expr("int(doc_id % 7 + 1)").alias("span_start"), F.expr("int(doc_id % 7 + 4)").alias("span_end"),
        F.expr("CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' Bench_2:1, bench_1:9' END").alias("references"), F.lit("bench_7:7").alias("reference"))
    return _flat_refs(annotations.append_accepted(v.added_entries(spark, d), accepted.withColumn("references", refs.parse_reference_list(F.col("references")))))


@query
def merge_counts(spark, d):
    return annotations.merge_counts(annotations.merge(v.base_entries(spark, d), v.added_entries(spark, d)))


@query
def predictions_per_problem(spark, d):
    return files.per_problem(_embedding_best(v.vectors(spark, d))).select("problem_id", F.array_join("predictions.reference", " ").alias("references"))


@query
def similar_verse_text(spark, d):
    """The preview's column of similar verses."""
    near = knn.self_top_k(v.vectors(spark, d), k=2, threshold=0.3)
    return annotations.similar_text(near).select("reference", F.regexp_replace("similar", r" \(\d\.\d{3}\)", "").alias("similar"))
