"""The TEI data source, the table function, and writers, on small files."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from versespark.operators import annotations, methods, tei
from versespark.sources import collections, files, tei_files

NS = 'xmlns="http://www.tei-c.org/ns/1.0"'
BOOKS, CODES = {"Gen": "gen"}, ["gen"]


def document(draw: random.Random, n: int) -> str:
    parts = []
    for _ in range(n):
        words = [f"w{draw.randrange(50)}" for _ in range(draw.randrange(0, 12))]
        if draw.random() < 0.5:
            words.insert(draw.randrange(len(words) + 1), f'<quote source="{draw.choice(["Gen_1_1", "Gen_1_2-3", "Foo_1_1"])}">a <hi>b</hi> c</quote>')
        if draw.random() < 0.2:
            words.append('<note type="source">drop</note><p>inner &amp; nested</p> tail')
        parts.append(f"<p>{' '.join(words)}</p>")
    return f"<TEI {NS}><teiHeader><p>not body</p><quote source=\"Gen_9_9\">h</quote></teiHeader><text><body><head>no</head>{''.join(parts)}</body></text></TEI>"


def test_tei_source(spark, tmp_path):
    """Files give what their texts give as rows, whatever partition they fall in; broken and empty ones are one row."""
    draw = random.Random(1)
    texts = {f"d{i}": document(draw, draw.randrange(0, 30)) for i in range(12)}
    texts |= {"bad": f"<TEI {NS}><text><body><p>one</p><p>", "bare": f"<TEI {NS}><text/></TEI>", "empty": "", "big": document(draw, 4000)}
    for name, text in texts.items():
        (tmp_path / f"{name}.xml").write_text(text)
    (tmp_path / "other.txt").write_text("no")
    rows = spark.createDataFrame(list(texts.items()), "problem_id string, xml string")
    want = sorted(map(str, tei.paragraphs(rows, BOOKS, CODES).drop("error").collect()))
    for size in (1, 2000, 1 << 26):
        parsed = tei_files.read_tei(spark, str(tmp_path), partitionBytes=str(size))
        assert sorted(map(str, tei.paragraphs(parsed, BOOKS, CODES).drop("error").collect())) == want
        assert parsed.rdd.getNumPartitions() == {1: 16, 1 << 26: 1}.get(size, parsed.rdd.getNumPartitions())
    assert {r["problem_id"] for r in tei.paragraphs(parsed, BOOKS, CODES).where("error IS NOT NULL").collect()} == {"bad", "empty"}
    assert tei.dataset_statistics(tei.paragraphs(parsed, BOOKS, CODES)).first() == tei.dataset_statistics(tei.paragraphs(rows, BOOKS, CODES)).first()
    assert files.read_xml(spark, str(tmp_path)).count() == 15  # whole-text reading gives no row for an empty file
    quotes = {r["problem_id"]: len(r["sources"]) for r in tei.quote_sources(rows).collect()}
    assert quotes["d3"] == texts["d3"].count("<quote") and quotes["bad"] == 0


def test_parsing_holds_one_paragraph(tmp_path):
    """The tree does not grow with the file."""
    import tracemalloc

    block = ("<p>" + "word " * 200 + "</p>").encode()
    blocks = [f"<TEI {NS}><text><body>".encode(), *[block] * 20_000, b"</body></text></TEI>"]
    tracemalloc.start()
    n = sum(1 for _ in tei.parse("p", iter(blocks)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 20_001 and peak < 4 << 20


def test_table_function_is_the_user_method(spark):
    def found(problem_id, text, context):
        if text == "fail":
            raise RuntimeError("bad text")
        return [{"problem_id": problem_id, "reference": w, "score": context["weight"], "method": "mine", "more": 1} for w in text.split()]

    rows = spark.createDataFrame([("a", "x y"), ("b", ""), ("c", "z"), ("d", "fail")], "problem_id string, text string")
    rows.createOrReplaceTempView("user_problems")
    methods.register_method(spark, "my_method", found, {}, setup=lambda context: {**context, "weight": 2})
    got = spark.sql("SELECT * FROM my_method(TABLE(user_problems) PARTITION BY problem_id)")
    assert got.columns == ["problem_id", "reference", "score", "method", "error"]
    assert {tuple(r)[:4] for r in got.where("error IS NULL").collect()} == {
        tuple(r) for r in methods.run_user_method(rows.where("problem_id <> 'd'"), found, {"weight": 2}).collect()}
    assert [tuple(r) for r in got.where("error IS NOT NULL").collect()] == [("d", None, None, None, "bad text")]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("p", "b", 0.5, "m"), ("p", "a", 0.5, "m"), ("p", "c", 0.9, "m"), ("o", "z", 0.1, "m")], files.PREDICTION)
    for by_score, want in ((True, "zcab"), (False, "zabc")):
        files.write_results(rows, rows.limit(1), f"{tmp_path}/r{by_score}", by_score)
        parts = sorted((tmp_path / f"r{by_score}" / "predictions").glob("part-*"))
        assert "".join(json.loads(line)["reference"] for p in parts for line in p.read_text().splitlines()) == want
        assert spark.read.json(f"{tmp_path}/r{by_score}/matches").count() == 1
    files.write_tsv(rows, f"{tmp_path}/t")
    assert spark.read.csv(f"{tmp_path}/t", sep="\t", header=True).count() == 4
    files.write_report(rows.agg(F.count("*").alias("n")), f"{tmp_path}/s")
    assert spark.read.json(f"{tmp_path}/s").first()["n"] == 4
    spans = spark.createDataFrame([("p", 0), ("p", 1), ("q", 0), ("gone", 0), ("gone", 9)], "problem_id string, span_start int")
    problems = spark.createDataFrame([("p",), ("q",), ("q",)], "problem_id string")
    assert [tuple(r) for r in annotations.skipped_spans(spans, problems).collect()] == [("gone", 2)]


def test_upsert_of_buckets(spark, tmp_path, monkeypatch):
    """Only touched buckets are read and written; a stop before the manifest leaves the version before; two writers cannot both succeed."""
    row, folder = "collection_name string, id string, row_index long, document string", str(tmp_path / "c")
    table = lambda rows: spark.createDataFrame(rows, row)
    assert collections.read_collections(spark, folder, row).count() == 0
    old = [(f"c{i % 3}", f"v{i}", i, "old") for i in range(200)] + [("c0", "v0", 500, "newer old"), ("c0", None, 7, None)]
    assert collections.upsert_into(table(old), folder, 16) == list(range(16))
    first = collections.manifest(spark, folder)
    new = [("c1", "v1", 1000, "new"), ("c2", "v2", 1001, "new"), ("c1", "v1", 1002, "newest")]
    touched = collections.upsert_into(table(new), folder)
    second = collections.manifest(spark, folder)
    assert len(touched) <= 2 and all((second["places"][str(b)] == first["places"][str(b)]) == (b not in touched) for b in range(16))
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = key(files.upsert(files.upsert(table([]), table(old)), table(new)))
    assert key(collections.read_collections(spark, folder).select("collection_name", "id", "row_index", "document")) == want
    with monkeypatch.context() as m:
        m.setattr(collections, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            collections.upsert_into(table([("c1", "v1", 9000, "lost")]), folder)
    assert collections.manifest(spark, folder) == second
    with pytest.raises(RuntimeError, match="another job"):
        collections._commit(spark, folder, second)
    assert collections.upsert_into(table([]), folder) == []
    assert collections.vacuum(spark, folder) == len(touched) + 1
    assert key(collections.read_collections(spark, folder).select("collection_name", "id", "row_index", "document")) == want
