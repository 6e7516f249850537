"""Cases of the blueprint with their expected values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from versespark.functions import refs
from versespark.functions.chunking import chunked, chunked_with_offsets, token_budget_split
from versespark.operators import annotations, evaluate, knn, methods, responses, reuse, tei
from versespark.sources import files

BOOKS, CODES = {"Gen": "gen", "1Cor": "1cor", "Ps": "ps"}, ["gen", "1cor"]
ALIASES = {"gen": "gen", "genesis": "gen", "1corinthians": "1cor"}


def one(spark, column, **values):
    names = list(values) or ["x"]
    df = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{n} {'int' if isinstance(values.get(n, 1), int) else 'string'}" for n in names))
    return df.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("source, expected", [
    (None, []), ("", []), ("Gen_1_1", ["gen_1:1"]), ("Gen_01:003-5", ["gen_1:3", "gen_1:4", "gen_1:5"]),
    ("cf_Gen_2_3; 1Cor_13_4", ["gen_2:3", "1cor_13:4"]), ("Gen_1_1 Gen_1_1-2", ["gen_1:1", "gen_1:2"]),
    ("gen_1_1", []), ("Gen_1", []), ("Gen_1_2_3", []), ("Gen", [])])
def test_source_resolver(spark, source, expected):
    df = spark.createDataFrame([(source,)], "s string")
    assert df.select(refs.resolve_source(F.col("s"), BOOKS, CODES)["references"]).first()[0] == expected


@pytest.mark.parametrize("source", ["Gen_1_5-3", "Gen_x_1", "Gen_1_2:3", "Ps_1_1"])
def test_source_errors(spark, source):
    df = spark.createDataFrame([(source,)], "s string")
    kept = df.select(refs.resolve_source(F.col("s"), BOOKS, CODES, "quarantine").alias("r")).first()["r"]
    assert kept["references"] == [] and len(kept["errors"]) == 1
    with pytest.raises(Exception):
        df.select(refs.resolve_source(F.col("s"), BOOKS, CODES)).collect()


@pytest.mark.parametrize("raw, expected", [
    ("Genesis 1:2-9", ["gen_1:2", "gen_1:3"]), ("gen_1:3–1", ["gen_1:1", "gen_1:2", "gen_1:3"]), ("Gen. 5:1-2", ["gen_5:1", "gen_5:2"]),
    ("gen_1:9", []), ("1 Corinthians 13:4", ["1cor_13:4"]), ("gen_1:1; gen_1:2", ["gen_1:1", "gen_1:2"]), ("gen_1:1,3", ["gen_1:1"]), ("foo_1:1", [])])
def test_free_form(spark, raw, expected):
    index = spark.createDataFrame([("gen", 1, i) for i in (1, 2, 3)], "book string, chapter int, verse int")
    rows = spark.createDataFrame([(raw,)], "raw string").select(F.explode(refs.split_candidates(F.col("raw"))).alias("raw"))
    rows = rows.select(refs.parse_free_form(F.col("raw"), ALIASES, CODES).alias("r")).where("r IS NOT NULL").select("r.*")
    assert sorted(r["reference"] for r in responses.expand_ranges(rows, index).collect()) == expected


def chunks_of(spark, text, mode, offsets=True, **options):
    df = spark.createDataFrame([("p", text)], "problem_id string, text string")
    if offsets:
        return [(r["chunk_index"], r["chunk_start"], r["chunk_end"], r["text"]) for r in chunked_with_offsets(df, mode, **options).orderBy("chunk_index").collect()]
    return [r["text"] for r in chunked(df, mode, **options).orderBy("chunk_index").collect()]


def test_chunks(spark):
    text = "Alpha beta. Gamma delta; eps! Zed"
    assert chunks_of(spark, text, "sentence", min_chars=1) == [
        (0, 0, 11, "Alpha beta."), (1, 12, 24, "Gamma delta;"), (2, 25, 29, "eps!"), (3, 30, 33, "Zed")]
    assert [c[0] for c in chunks_of(spark, text, "sentence", min_chars=5)] == [0, 1]
    assert [c[1:3] for c in chunks_of(spark, text, "sentence_window", min_chars=1)] == [(0, 24), (12, 29), (25, 33), (30, 33)]
    assert [c[1:] for c in chunks_of(spark, "abcdefghijklmno", "char", char_size=10, char_overlap=4, min_chars=1)] == [
        (0, 10, "abcdefghij"), (6, 15, "ghijklmno"), (12, 15, "mno")]
    assert chunks_of(spark, "abcd      efgh", "char", char_size=4, char_overlap=0, min_chars=2) == [
        (0, 0, 4, "abcd"), (2, 10, 12, "ef"), (3, 12, 14, "gh")]
    assert [c[1:3] for c in chunks_of(spark, "A b.\nC d.", "sentence_window", min_chars=1)] == [(0, 9), (5, 9)]
    assert [c[1] for c in chunks_of(spark, "x y. p q. r s. x y. p q. r s.", "sentence_window", min_chars=1)] == [0, 20, 10, 0, 5, 10]
    assert chunks_of(spark, "   ", "sentence", offsets=False) == [] and chunks_of(spark, "", "char", offsets=False) == []
    with pytest.raises(ValueError):
        chunks_of(spark, "x", "words")


def test_token_budget(spark):
    df = spark.createDataFrame([("p", 0, "x" * 2000), ("q", 0, "y" * 900)], "problem_id string, chunk_index int, text string")
    parts = token_budget_split(df, context=300, reserve=0, output=0, overlap=200).collect()
    assert sorted((r["problem_id"], r["part_index"], len(r["text"])) for r in parts) == [("p", 0, 1200), ("p", 1, 1000), ("q", 0, 900)]


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>
<p>abc <quote source="Gen_1_1">def</quote> ghi<note type="source">drop</note> tail</p><p/>
<p><quote source="Gen_1_2-3">In <quote source="Unknown_1">x</quote> y</quote> z</p></body></text></TEI>"""


def test_tei(spark):
    docs = spark.createDataFrame([("a", TEI), ("bad", "<TEI><p>")], "problem_id string, xml string")
    rows = tei.paragraphs(docs, BOOKS, CODES).cache()
    assert tei.document_texts(rows).collect() == [("a", "abc def ghi tail\n\nIn x y z")]
    spans = [(r["span_start"], r["span_end"], r["resolved_references"]) for r in tei.document_spans(rows).orderBy("span_index").collect()]
    assert spans == [(3, 7, ["gen_1:1"]), (18, 24, ["gen_1:2", "gen_1:3"])]
    assert [r["offset"] for r in tei.paragraph_offsets(rows.where("error IS NULL")).orderBy("para_no").collect()] == [0, 17, 18]
    assert tei.quote_totals(docs, BOOKS).first().asDict() == {
        "files": 2, "parse_errors": 1, "files_with_quotes": 1, "quotes": 3, "mapped": 2, "files_mapped": 1}
    assert tei.dataset_statistics(rows.where("problem_id = 'a'")).first().asDict() == {
        "files": 1, "files_with_spans": 1, "spans": 2, "verses": 3, "books": 1, "pairs": 3, "parse_errors": 0}


def test_scoring(spark):
    predictions = spark.createDataFrame(
        [("A", "gen_1:1"), ("A", "GEN_1:1 "), ("A", "gen_1:2"), ("", "x"), ("B", ""), ("C", "gen_9:9")], "problem_id string, reference string")
    gold = spark.createDataFrame([("A", ["gen_1:1", "gen_1:3"]), ("B", ["gen_2:1"])], "problem_id string, resolved_references array<string>")
    got = evaluate.evaluate(predictions, gold).first()
    assert got[:3] == (1.0, 2.0, 2.0) and all(abs(x - 1 / 3) < 1e-12 for x in got[3:])
    assert tuple(evaluate.evaluate(predictions.limit(0), gold.limit(0)).first()) == (0.0,) * 6


def test_preview_merge_highlight(spark):
    problems = spark.createDataFrame([("p", "0123456789")], "problem_id string, text string")
    spans = spark.createDataFrame([("p", 0, 2, 5, ["a"]), ("p", 1, 8, 12, ["a"])], "problem_id string, span_index int, span_start int, span_end int, resolved_references array<string>")
    rows = annotations.validation_preview(spans, problems, 2).collect()
    assert (rows[0]["valid_span"], rows[0]["span_length"], rows[0]["visual_snippet"]) == (True, 3, "01[234]56")
    assert (rows[1]["valid_span"], rows[1]["span_length"], rows[1]["visual_snippet"]) == (False, None, "")
    kind = "problem_id string, span_start int, span_end int, references array<string>"
    base = spark.createDataFrame([("p", 0, 5, ["gen_1:2", "GEN_1:1"])], kind)
    added = spark.createDataFrame([("p", 0, 5, ["gen_1:1", "gen_1:2"]), ("p", 5, 5, ["gen_1:1"]), ("p", 7, 9, []), ("p", 6, 9, ["gen_2:1"])], kind)
    merged = annotations.merge(base, added)
    labels = {tuple(r[:3]): r["label"] for r in annotations.source_labels(merged, base, added).select("span_start", "span_end", "references", "label").rdd.map(
        lambda r: (r[0], r[1], ",".join(r[2]), r[3])).toDF("s int, e int, r string, label string").collect()}
    assert labels == {(0, 5, "gen_1:1,gen_1:2"): "solution+add", (6, 9, "gen_2:1"): "add"}
    assert sorted(annotations.merge(merged, added).collect()) == sorted(merged.collect())
    long = spark.createDataFrame([("p", "x" * 20)], "problem_id string, text string")
    marks = spark.createDataFrame([("p", a, b) for a, b in [(0, 5), (3, 8), (4, 6), (10, 30), (12, 12)]], "problem_id string, span_start int, span_end int")
    assert sorted(r[1:] for r in annotations.clip_highlights(marks, long).collect()) == [(0, 5), (5, 8), (10, 20)]


def test_names(spark):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(["a", "a", "", "b", "a"])], "row_index int, reference string")
    assert [r["id"] for r in files.unique_ids(rows).orderBy("row_index").collect()] == ["a", "a__1", "row_2", "b", "a__2"]
    lit = F.lit
    assert one(spark, refs.collection_name(lit("biblical"), lit("hf"), lit("bowphs/LaBerta"))) == "biblical__hf__bowphs_laberta"
    name = one(spark, refs.collection_name(lit("biblical"), lit("hf"), lit("m" * 80)))
    assert len(name) <= 63 and name[-12:-10] == "__"
    assert one(spark, refs.parse_chunk_id(lit("task::a::chunk::b::chunk::3"))) == ("a::chunk::b", 3)
    assert one(spark, refs.parse_reference_list(lit("GEN_1:2, gen_1:1;gen_1:2\n"))) == ["gen_1:1", "gen_1:2"]
    assert one(spark, annotations.mark_slice(lit("a<b>"), lit(1), lit(9))) == "a<mark>&lt;b&gt;</mark>"


def test_reuse_reshape(spark):
    doc = {"id": "task::P::chunk::3", "text": "t", "lines": [{"text": None, "wits": [
        {"id": "bible::GEN_1:1", "matches": 12.0, "alg": "in-p", "alg2": "inxp", "begin": 0, "begin2": 4, "text": "w"},
        {"id": "task::x", "matches": 3.0, "alg": "a", "alg2": "a", "begin": 0, "begin2": 0, "text": "w"}]}]}
    nested = spark.createDataFrame([doc, {"id": "task::Q::chunk::0", "text": "t", "lines": None}], files.REUSE)
    flat = reuse.flatten_output(nested)
    row = flat.first()
    assert flat.count() == 1 and (row["problem_id"], row["chunk_index"], row["reference"], row["score"]) == ("P", 3, "gen_1:1", 12.0)
    assert (row["aligned_chunk_start"], row["aligned_chunk_end"], row["aligned_verse_start"], row["aligned_verse_end"]) == (4, 8, 0, 3)
    begin, begin2, alg, alg2, equal = reuse.local_alignment("xxhello world", "hello wrld!")
    assert "xxhello world"[begin:begin + len(alg.replace("-", ""))] == alg.replace("-", "") and (begin2, equal) == (0, 10)


@pytest.mark.parametrize("response, expected", [
    ('```json\n{"matches":[{"reference":"gen_1:1","confidence":1.7}]}\n```', [("gen_1:1", 1.0)]),
    ('{"results":[{"ref":"gen_1:1","score":"0.7"}]}', [("gen_1:1", 0.7)]),
    ('{"matches":[{"reference":"gen_1:1","confidence":null,"score":0.9}]}', [("gen_1:1", 0.5)]),
    ('{"matches":[], "results":[{"reference":"gen_1:1"}]}', []), ('See [{"reference":"gen_1:1"}]', []),
    ('See [{"reference":"gen_1:1"},{"reference":"gen_1:2"}]', [("gen_1:1", 0.5), ("gen_1:2", 0.5)]), ("sorry", []), (None, [])])
def test_responses(spark, response, expected):
    index = spark.createDataFrame([("gen", 1, i) for i in (1, 2, 3)], "book string, chapter int, verse int")
    df = spark.createDataFrame([("p", 0, response)], "problem_id string, chunk_index int, response string")
    got = responses.score_responses(df, index, ALIASES, CODES).collect()
    assert sorted((r["reference"], r["score"]) for r in got) == expected


def test_nearest(spark):
    side = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.8, 0.6]), ("c", [0.0, 1.0])], "reference string, embedding array<float>")
    query = spark.createDataFrame([("q", [2.0, 0.1])], "query_id string, embedding array<float>")
    assert [r["reference"] for r in knn.top_k(query, side, 2, 0.75).orderBy("rank").collect()] == ["a", "b"]
    assert knn.top_k(query, side, 1, 0.1).count() == 1
    one_by_one = knn.top_k(query, side, 2, 0.0, block_rows=1).orderBy("rank").collect()
    assert [r["reference"] for r in one_by_one] == ["a", "b"]
    assert {r["reference"] for r in knn.approximate_neighbours(query, side, 0.7).collect()} <= {"a", "b"}


def test_methods_and_files(spark, tmp_path):
    problems = spark.createDataFrame([("p", "In the beginning God created the heaven and the earth."), ("q", "nothing here to be found at all")], "problem_id string, text string")
    verses = spark.createDataFrame([("gen_1:1", "In the beginning God created the heaven and the earth.")], "reference string, text string")
    got = methods.run_named("reuse", problems, verses, mode="full", min_chars=1).collect()
    assert [(r["problem_id"], r["reference"], r["score"]) for r in got] == [("p", "gen_1:1", 54.0)]
    embed = lambda texts: [[1.0, 0.0] if "God" in t else [0.0, 1.0] for t in texts]
    collection = knn.embed_texts(verses, embed)
    assert [r["problem_id"] for r in methods.run_named("embedding", problems, collection, embed, min_chars=1).collect()] == ["p"]
    complete = lambda system, human: '{"matches":[{"reference":"gen_1:1","confidence":0.9}]}' if "God" in human else 1 / 0
    assert methods.run_named("prompting", problems, verses, ALIASES, CODES, complete).count() == 1
    user = methods.run_user_method(problems, lambda p, t, c: [{"problem_id": p, "reference": c["r"], "extra": 1}], {"r": "gen_1:1"})
    assert user.count() == 2
    (tmp_path / "problems").mkdir()
    (tmp_path / "problems" / "x.txt").write_text("two\nlines")
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.json").write_text('[{"span_start": 0, "span_end": 3, "resolved_references": ["gen_1:1"]}]')
    (tmp_path / "s" / "y.json").write_text('{"not": "a list"}')
    (tmp_path / "v.tsv").write_text("book_code\tchapter_number\tverse_index\ttext\n Gen \t1\t2\tNA\n")
    assert files.read_problems(spark, f"{tmp_path}/problems").collect() == [("x", "two\nlines")]
    assert [(r["problem_id"], r["span_index"], r["span_end"]) for r in files.read_solutions(spark, f"{tmp_path}/s", tolerant=True).collect()] == [("x", 0, 3)]
    assert files.read_verses(spark, f"{tmp_path}/v.tsv").first()["reference"] == "gen_1:2"
