"""Jobs as a whole, and cases in which a shortcut would lose part of them."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from versespark.functions.chunking import chunked, chunked_with_offsets
from versespark.operators import evaluate, knn, reuse, responses, tei
from versespark.plans import queries
from versespark.sources import files

SMALL = "/root/testdata/sf0.01"
NS = 'xmlns="http://www.tei-c.org/ns/1.0"'


def smith_waterman(a: str, b: str) -> int:
    """The best local score, cell by cell: match 2, mismatch -1, gap -2."""
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (2 if x == y else -1), rows[i - 1][j] - 2, rows[i][j - 1] - 2)
    return max(map(max, rows))


def test_alignment_against_brute_force():
    draw = random.Random(1)
    for _ in range(80):
        a, b = ("".join(draw.choice("abcd") for _ in range(draw.randrange(0, 30))) for _ in range(2))
        if draw.random() < 0.5:
            b = b[:5] + a[3:20] + b[5:]
        begin, begin2, alg, alg2, equal = reuse.local_alignment(a, b)
        assert len(alg) == len(alg2) and equal == sum(x == y for x, y in zip(alg, alg2, strict=True))
        assert a[begin:begin + len(alg.replace("-", ""))] == alg.replace("-", "")
        assert b[begin2:begin2 + len(alg2.replace("-", ""))] == alg2.replace("-", "")
        score = sum(2 if x == y else -2 if "-" in (x, y) else -1 for x, y in zip(alg, alg2, strict=True))
        assert score == smith_waterman(a, b)


def test_detect_finds_what_stands_in_the_texts(spark):
    """Every planted verse is found, however long; half a verse is not enough, and an edited one is."""
    draw = random.Random(2)
    words = lambda n: " ".join(f"{draw.choice('bdfgklmn')}{draw.choice('aeiou')}{draw.randrange(1000)}" for _ in range(n))
    verses = [(f"gen_1:{i + 1}", words(draw.randrange(8, 90))) for i in range(20)]
    rows, truth = [], set()
    for i in range(40):
        ref, text = verses[i % 20]
        if i >= 30:
            text = " ".join(text.split()[:len(text.split()) // 4])
        elif i >= 20:
            w = text.split()
            text = " ".join(w[:3] + ["other"] + w[4:])
        if i < 30:
            truth.add((f"p{i}", ref))
        rows.append((f"p{i}", f"{words(40)} {text} {words(30)}"))
    problems = spark.createDataFrame(rows, "problem_id string, text string")
    bible = spark.createDataFrame(verses, "reference string, text string")
    chunks = chunked_with_offsets(problems, "char", char_size=100, char_overlap=50, min_chars=25)
    flat = reuse.flatten_output(reuse.detect(chunks, bible, reuse.ReuseOptions()))
    assert {(r["problem_id"], r["reference"]) for r in reuse.best_pairs(flat).collect()} == truth
    with pytest.raises(ValueError):
        reuse.detect(chunks.limit(0), bible, reuse.ReuseOptions())


def test_grams_of_verses_are_all_found(spark, monkeypatch):
    draw = random.Random(3)
    text = lambda n: "".join(draw.choice("abé😀 ") for _ in range(n))
    rows = spark.createDataFrame([(f"t{i}", "task", text(draw.randrange(0, 60))) for i in range(40)] + [("t", "task", None)]
                                 + [(f"b{i}", "bible", text(draw.randrange(0, 9))) for i in range(10)], "id string, group string, text string")
    want = sorted(map(tuple, reuse.ngrams(rows, 4).join(reuse.ngrams(rows.where("group = 'bible'"), 4).select("gram").distinct(), "gram", "left_semi")
                      .select("id", "gram", "pos").collect()))
    assert want and sorted(map(tuple, reuse.verse_grams(rows, 4).select("id", "gram", "pos").collect())) == want
    monkeypatch.setattr(reuse, "MAP_GRAMS", 0)
    assert sorted(map(tuple, reuse.verse_grams(rows, 4).select("id", "gram", "pos").collect())) == want


def test_frequent_verses(spark):
    """A verse in more chunks than the frequency bound is found once the bound is taken off."""
    verse = "in the beginning was a word of some length"
    chunks = spark.createDataFrame([(f"p{i}", 0, 0, len(verse), verse) for i in range(30)],
                                   "problem_id string, chunk_index int, chunk_start int, chunk_end int, text string")
    bible = spark.createDataFrame([("gen_1:1", verse)], "reference string, text string")
    found = lambda **o: reuse.detect(chunks, bible, reuse.ReuseOptions(**o)).count()
    assert (found(max_df=20), found(max_df=0)) == (0, 30)


def test_detected_pairs_are_gold(spark):
    metrics = queries.QUERIES["score_predictions"](spark, SMALL).first()
    assert metrics["true_positives"] >= 24 and metrics["false_negatives"] <= 2 and metrics["false_positives"] == 0


def test_gold_of_short_and_repeated_verses(spark, tmp_path):
    from versespark.plans import views

    spark.createDataFrame([(1, "a bc. a bc. xy longer verse text here longer verse text here"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "bc."), (1, "longer verse text"), (2, "\\E"), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r)[1:4] for r in views.gold_spans(spark, str(tmp_path)).orderBy("span_index").collect()]
    assert got == [(0, 2, 5), (1, 8, 11), (2, 15, 32), (3, 38, 55)]


def test_tei_without_text(spark, tmp_path):
    deep = f"<TEI {NS}><text><body><p>{'<hi>' * 3000}x{'</hi>' * 3000} <quote source='Gen_1_1'>light</quote></p></body></text></TEI>"
    rows = [("none", f"<TEI {NS}><text/></TEI>"), ("empty", f"<TEI {NS}><text><body/></text></TEI>"), ("bad", "<p>"), ("null", None), ("deep", deep)]
    docs = spark.createDataFrame(rows, "problem_id string, xml string").coalesce(1)
    parsed = tei.paragraphs(docs, {"Gen": "gen"}, ["gen"])
    assert tei.dataset_statistics(parsed).first().asDict() == {
        "files": 5, "files_with_spans": 1, "spans": 1, "verses": 1, "books": 1, "pairs": 1, "parse_errors": 2}
    assert {r["problem_id"]: r["text"] for r in tei.document_texts(parsed).collect()} == {"deep": "x light"}
    only = spark.createDataFrame(rows[:2], "problem_id string, xml string").coalesce(1)
    assert tei.paragraphs(only, {"Gen": "gen"}, ["gen"]).where("para_no < 0").count() == 2
    stats = tei.build_dataset(docs, {"Gen": "gen"}, ["gen"], str(tmp_path / "out"))
    assert stats.first()["files"] == 5
    assert spark.read.parquet(f"{tmp_path}/out/problems").count() == 1 and spark.read.parquet(f"{tmp_path}/out/solutions").count() == 1


def test_range_of_an_unknown_chapter(spark):
    """No range is too long: it is kept as one stretch, and spread only where its references are wanted."""
    index = spark.createDataFrame([("gen", 1, 1), ("gen", 1, 2)], "book string, chapter int, verse int")
    ranges = spark.createDataFrame([("gen", 9, 1, 2_000_000_000), ("gen", 8, 1, 3), ("gen", 1, 1, 2_000_000_000), ("gen", 7, 5, 1)],
                                   "book string, chapter int, verse_start int, verse_end int")
    assert {tuple(r)[:2] + tuple(r)[4:] for r in responses.range_intervals(ranges, index).collect()} == {
        ("gen", 9, 1, 2_000_000_000), ("gen", 8, 1, 3), ("gen", 1, 1, 2)}
    rest = ranges.where("chapter <> 9")
    assert {r["reference"] for r in responses.expand_ranges(rest, index).collect()} == {"gen_8:1", "gen_8:2", "gen_8:3", "gen_1:1", "gen_1:2"}
    assert responses.expand_ranges(ranges.where("chapter = 9"), index).limit(25_000).count() == 25_000
    long = ranges.where("chapter = 9").withColumn("verse_end", F.lit(3_000_000))
    assert responses.expand_ranges(long, index).agg(F.count("*"), F.count_distinct("verse"), F.max("verse")).first()[:] == (3_000_000,) * 3


def test_ranges_meet_runs_with_holes(spark):
    """All verses between, once each, whatever the bins, against plain sets."""
    draw = random.Random(11)
    known = {(b, c): {v for v in range(1, 400) if draw.random() < 0.9} for b in ("gen", "ps") for c in (1, 2)}
    index = spark.createDataFrame([(b, c, v) for (b, c), vs in known.items() for v in [*vs, min(vs)]], "book string, chapter int, verse int")
    rows = [(i, draw.choice(["gen", "ps"]), draw.choice([1, 2, 3]), a := draw.randrange(-5, 420), a + draw.choice([-1, 0, 1, 63, 64, 200])) for i in range(120)]
    ranges = spark.createDataFrame(rows, "n int, book string, chapter int, verse_start int, verse_end int")
    got: dict = {}
    for r in responses.expand_ranges(ranges, index).collect():
        got.setdefault(r["n"], []).append(r["verse"])
    for n, b, c, start, end in rows:
        inside = set(range(start, end + 1))
        want = sorted(inside & known[b, c] if (b, c) in known else inside)
        assert sorted(got.get(n, [])) == want
    for r in responses.range_intervals(ranges, index).where("chapter < 3").collect():
        assert set(range(r["first"], r["last"] + 1)) <= known[r["book"], r["chapter"]]


def test_reference_key_that_is_there(spark):
    rows = [(0, '[{"reference":"gen 1:1"},{"reference":"","ref":"gen 1:2"},{"reference":null,"ref":"gen 1:3"},{"ref":" gen 1:4 "},{"x":1}]')]
    got = responses.extract_matches(spark.createDataFrame(rows, "chunk_index int, response string").withColumn("problem_id", F.lit("p")))
    assert [r["raw_reference"] for r in got.collect()] == ["gen 1:1", "None", "gen 1:4"]


def test_nearest_in_blocks(spark):
    draw = np.random.default_rng(4)
    vectors = draw.normal(size=(60, 8))
    rows = spark.createDataFrame([(f"v{i:02}", x.tolist()) for i, x in enumerate(vectors)] + [("none", None)], "reference string, embedding array<double>")
    asked = rows.withColumn("query_id", F.col("reference"))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = unit @ unit.T
    want = {(f"v{i:02}", k + 1): f"v{j:02}" for i in range(60) for k, j in enumerate(np.argsort(-scores[i], kind="stable")[:3])}
    for block in (1000, 7):
        got = knn.top_k(asked, rows, k=3, threshold=-2.0, block_rows=block, query_rows=block).collect()
        assert {(r["query_id"], r["rank"]): r["reference"] for r in got} == want
        others = {(q, k - 1): ref for (q, k), ref in want.items() if k > 1}
        got = knn.self_top_k(rows, k=2, threshold=-2.0, block_rows=block).collect()
        assert {(r["query_id"], r["rank"]): r["reference"] for r in got} == others
    assert knn.self_top_k(rows.limit(0)).count() == 0 and knn.self_top_k(rows.limit(1)).count() == 0
    assert knn.top_k(asked.limit(0), rows).count() == 0 and knn.top_k(asked, rows.limit(0)).count() == 0


def test_approximate_neighbours_recall(spark):
    draw = np.random.default_rng(5)
    base = draw.normal(size=(40, 16))
    near = base + 0.15 * draw.normal(size=base.shape)
    side = spark.createDataFrame([(f"b{i}", x.tolist()) for i, x in enumerate(base)], "reference string, embedding array<double>")
    asked = spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(near)], "query_id string, embedding array<double>")
    exact = {(r["query_id"], r["reference"]) for r in knn.top_k(asked, side, k=40, threshold=0.9).collect()}
    got = {(r["query_id"], r["reference"]) for r in knn.approximate_neighbours(asked, side, 0.9).collect()}
    assert got <= exact and len(got) >= 0.9 * len(exact) > 30


def test_inverted_file(spark):
    """Nine of ten neighbours with less work than all pairs; a cell with a third of all rows is dealt into blocks; all cells give the exact result."""
    draw = np.random.default_rng(6)
    hearts = draw.normal(size=(12, 16))
    vectors = [hearts[i % 12] + 0.4 * draw.normal(size=16) for i in range(600)] + [hearts[0] + 0.01 * draw.normal(size=16) for _ in range(300)]
    rows = [(f"v{i:03}", x.tolist()) for i, x in enumerate(vectors)] + [("zero", [0.0] * 16), ("none", None)]
    side = spark.createDataFrame(rows, "reference string, embedding array<double>")
    asked = side.where("reference < 'v120' OR reference IN ('zero', 'none')").withColumn("query_id", F.col("reference"))
    exact = knn.top_k(asked, side, k=10, threshold=-1.0).cache()
    index = knn.fit_cells(side, k=10)
    assigned = knn.assign_cells(side, index).cache()
    assert assigned.count() == 901 and len(index.centres) == 30 and 1 <= index.probes < 30
    found = knn.search_cells(asked, assigned, index, k=10, block_rows=40, query_rows=9)
    measured = knn.recall_at(exact, found).first()
    assert measured["neighbours"] == 121 * 10 and measured["recall"] >= 0.9
    assert knn.compared_pairs(asked, assigned, index).first()["compared"] < 121 * 901 / 2
    every = knn.search_cells(asked, assigned, knn.Cells(index.centres, len(index.centres)), k=10, block_rows=100)
    key = lambda df: sorted((r["query_id"], r["rank"], round(r["similarity"], 9)) for r in df.collect())
    assert key(every) == key(exact)
    assert knn.fit_cells(side.where("embedding IS NULL")) is None
    one = knn.fit_cells(side.limit(1))
    assert knn.search_cells(asked, knn.assign_cells(side.limit(1), one), one, k=3).count() == 121


def test_chunk_sizes_are_at_least_one(spark):
    docs = spark.createDataFrame([("p", "abcdef"), ("q", "  "), ("r", None)], "problem_id string, text string")
    assert [r["text"] for r in chunked(docs, "char", char_size=0, char_overlap=-3, min_chars=0).collect()] == list("abcdef")
    assert [r["text"] for r in chunked_with_offsets(docs, "char", char_size=2, char_overlap=-9, min_chars=1).collect()] == ["ab", "cd", "ef"]
    assert [r["problem_id"] for r in chunked_with_offsets(docs, "full", min_chars=0).collect()] == ["p"]


def test_offsets_of_repeated_sentences(spark):
    text = "One two. Three four. One two. Three four."
    docs = spark.createDataFrame([("p", text)], "problem_id string, text string")
    got = [(r["chunk_start"], r["chunk_end"]) for r in chunked_with_offsets(docs, "sentence", min_chars=1).collect()]
    assert got == [(0, 8), (9, 20), (21, 29), (30, 41)]
    windows = chunked_with_offsets(docs, "sentence_window", min_chars=1).collect()
    assert [(r["chunk_start"], text[r["chunk_start"]:r["chunk_end"]]) for r in windows][:2] == [(0, "One two. Three four."), (9, "Three four. One two.")]


def test_upsert_and_order(spark, tmp_path):
    row = "collection_name string, id string, row_index long, document string"
    old = spark.createDataFrame([("c", "a", 0, "old"), ("c", "b", 1, "old")], row)
    new = spark.createDataFrame([("c", "a", 2, "first"), ("c", "a", 3, "second")], row)
    assert {(r["id"], r["document"]) for r in files.upsert(old, new).collect()} == {("a", "second"), ("b", "old")}
    files.write_collections(old, f"{tmp_path}/c")
    files.write_collections(spark.createDataFrame([("d", "x", 0, "n")], row), f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/c").count() == 3
    pairs = spark.createDataFrame([("p", "b", 0.5, "m"), ("p", "a", 0.5, "m"), ("p", "c", 0.9, "m")], files.PREDICTION)
    files.write_results(pairs, None, f"{tmp_path}/r")
    assert [r["reference"] for r in files.in_prediction_order(pairs).collect()] == ["c", "a", "b"]
    assert [r["reference"] for r in files.in_prediction_order(pairs, by_score=False).collect()] == ["a", "b", "c"]
    assert [[x["reference"] for x in r["predictions"]] for r in files.per_problem(pairs).collect()] == [["c", "a", "b"]]
    (tmp_path / "map.tsv").write_text("book_code\twork_name\n\tGenesis\n")
    with pytest.raises(ValueError):
        files.read_book_mapping(spark, str(tmp_path / "map.tsv"))


def test_readers(spark, tmp_path):
    (tmp_path / "solutions").mkdir()
    for name, text in (("a", '[{"span_start":1,"span_end":3,"resolved_references":["gen_1:1"]}]'), ("b", "not json"), ("c", "{}")):
        (tmp_path / "solutions" / f"{name}.json").write_text(text)
    assert [r["problem_id"] for r in files.read_solutions(spark, str(tmp_path / "solutions"), tolerant=True).collect()] == ["a"]
    with pytest.raises(Exception):
        files.read_solutions(spark, str(tmp_path / "solutions")).collect()
    assert files.read_solutions(spark, str(tmp_path / "none"), tolerant=True).count() == 0
    assert files.read_problems(spark, str(tmp_path / "solutions")).count() == 0
    (tmp_path / "verses.tsv").write_text('book_code\tchapter_number\tverse_index\ttext\n Gen \t1\t2\tNA\nps\t3\t4\t\n')
    verses = files.read_verses(spark, str(tmp_path / "verses.tsv"))
    assert {(r["reference"], r["text"]) for r in verses.collect()} == {("gen_1:2", "NA"), ("ps_3:4", "")}
    assert {r["book_code"] for r in files.book_codes(verses).collect()} == {"gen", "ps"}
    (tmp_path / "bad.tsv").write_text("book_code\tchapter_number\tverse_index\ttext\ngen\tone\t2\tx\n")
    with pytest.raises(Exception):
        files.read_verses(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "short.tsv").write_text("book_code\tchapter_number\ttext\ngen\t1\tx\n")
    with pytest.raises(Exception):
        files.read_verses(spark, str(tmp_path / "short.tsv")).collect()
    (tmp_path / "abbrev.json").write_text('{"Gen": "gen", "gen": "other"}')
    assert {tuple(r) for r in files.read_abbreviations(spark, str(tmp_path / "abbrev.json")).collect()} == {("Gen", "gen"), ("gen", "other")}
    (tmp_path / "books.tsv").write_text("book_code\twork_name\nGen\tGenesis 1\n\tlost\nps\tgenesis1\n")
    assert {tuple(r) for r in files.read_book_mapping(spark, str(tmp_path / "books.tsv")).collect()} == {("gen", "gen"), ("genesis1", "ps"), ("ps", "ps")}
    (tmp_path / "rows.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 3}\n')
    assert files.read_jsonl(spark, str(tmp_path / "rows.jsonl"), "a int", skip_bad=True).where("a IS NOT NULL").count() == 2
    metrics = evaluate.score_pairs(spark.createDataFrame([("p", "a")], "problem_id string, reference string"),
                                   spark.createDataFrame([("p", "a")], "problem_id string, reference string"))
    for _ in range(2):
        files.append_run(spark, str(tmp_path / "runs"), "reuse", {"n": 8}, metrics, 1)
    runs = spark.read.parquet(str(tmp_path / "runs"))
    assert runs.count() == 2 and {r["predictions_produced"] for r in runs.collect()} == {1}


def test_ids_of_a_frequent_reference(spark, monkeypatch):
    monkeypatch.setattr(files, "NUMBERED_ROWS", 7)
    rows = [(i, None if i % 10 == 3 else "r" if i % 3 else "s") for i in range(60)]
    got = {r["row_index"]: r["id"] for r in files.unique_ids(spark.createDataFrame(rows, "row_index long, reference string")).collect()}
    seen: dict[str, int] = {}
    for i, ref in rows:
        base = ref or f"row_{i}"
        n = seen.get(base, 0)
        seen[base] = n + 1
        assert got[i] == (f"{base}__{n}" if n else base)


def test_preview_with_verses_and_neighbours(spark):
    from versespark.operators import annotations

    problems = spark.createDataFrame([("p", "say light here"), ("q", "x")], "problem_id string, text string")
    spans = spark.createDataFrame([("p", 0, 4, 9, ["gen_1:1", "gen_1:2"]), ("q", 0, 5, 9, ["gen_1:3"])],
                                  "problem_id string, span_index int, span_start int, span_end int, resolved_references array<string>")
    verses = spark.createDataFrame([("gen_1:1", "light")], "reference string, text string")
    near = spark.createDataFrame([("gen_1:1", "gen_1:9", 0.8732, 1), ("gen_1:1", "gen_1:8", 0.8, 2)], "query_id string, reference string, similarity double, rank int")
    got = annotations.validation_preview(spans, problems, 4, verses, near, most=5).collect()
    assert [(r["document"], r["valid_span"], r["span_length"], r["visual_snippet"]) for r in got] == [("p", True, 5, "say [light] her"), ("q", False, None, "")]
    assert got[0]["resolved_reference_text_pairs"] == "gen_1:1 :: light || gen_1:2 :: [MISSING]"
    assert got[0]["resolved_reference_top_similar"] == "gen_1:1 => [gen_1:9 (0.873), gen_1:8 (0.800)] || gen_1:2 => []"
