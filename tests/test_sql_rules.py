"""Queries and their SQL on tables where another rule than the query's would show."""

from __future__ import annotations

import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from versespark.operators import knn


def both(spark, folder, name: str, **tables) -> tuple[list, list]:
    """The rows of a query and of its SQL over ``tables`` (schema, rows), columns by name."""
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(folder))
    names = sorted(df.columns)
    quoted = ", ".join(f'"{n}"' for n in names)
    theirs = con.execute(f"SELECT {quoted} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, df.select(*names).collect())), sorted(theirs)


def reuse_tables(seed: int) -> dict:
    """Verses that stand in texts whole, edited, with gaps, in part, twice, in one piece shared by two verses, and beside much that repeats."""
    draw = random.Random(seed)
    words = lambda n: [draw.choice("bdfgklmnprst") + draw.choice("aeiou") + draw.choice(["", "n", "rt", "-s", "😀"]) * draw.randrange(2) + draw.choice("bdgk") for _ in range(n)]
    verses = [words(draw.randrange(12, 40)) for _ in range(12)]
    verses[1][4:16] = verses[0][4:16]  # a piece that two verses share
    verses[2] = ["lala"] * 6 + words(12)
    verses[3] = words(9) * 2
    texts = []
    for k in range(48):
        v, at = list(verses[k % 12]), draw.randrange(3, 8)
        if k // 6 == 1:
            v[at] = "other"
        elif k // 6 == 2:
            v[at:at + 1] = []
        elif k // 6 == 3:
            v[at:at] = words(2)
        elif k // 6 == 4:
            v = v[:max(5, len(v) * draw.choice([4, 6, 7]) // 10)]
        elif k // 6 == 5:
            v = v + words(3) + v
        elif k // 6 == 6:
            v = v[:at] + words(70) + v[at:]
        texts.append(" ".join(words(draw.randrange(1, 20)) + v + words(draw.randrange(1, 20))))
    return {"documents": ("doc_id long, text string", [*enumerate(texts), (48, None), (49, "")]), "benchmark": ("item_id long, text string", [(i, " ".join(v)) for i, v in enumerate(verses)])}


def test_error_sets_by_the_alignments(spark, tmp_path):
    """A verse of which a text has a long piece only is no match, in the query and in its SQL."""
    ours, theirs = both(spark, tmp_path, "error_sets", **reuse_tables(1))
    assert ours == theirs
    assert {r[0] for r in ours} == {"tp", "fp"}


def test_scores_by_the_alignments(spark, tmp_path):
    ours, theirs = both(spark, tmp_path, "score_predictions", **reuse_tables(2))
    assert ours == theirs and ours[0][2] > 0


def vector_tables(distinct: int, copies: int) -> dict:
    """Vectors of which each stands ``copies`` times, the first neighbours of each other."""
    draw = random.Random(3)
    vectors = [[draw.gauss(0, 1) for _ in range(64)] for _ in range(distinct)]
    rows = [(i, vectors[i % distinct], 0) for i in range(distinct * copies)]
    return {"embeddings": ("vec_id long, embedding array<float>, label int", rows)}


def test_predictions_equally_near(spark, tmp_path):
    """Equal scores are listed by reference, though their last digits differ."""
    ours, theirs = both(spark, tmp_path, "predictions_per_problem", **vector_tables(1300, 2))
    assert ours == theirs


def test_every_vector_is_asked(spark, tmp_path):
    """All vectors are queries, against all others; equally near ones are taken by reference."""
    tables = vector_tables(300, 7)
    ours, theirs = both(spark, tmp_path, "knn_topk", **tables)
    assert ours == theirs and len(ours) == 2100 * 5


def test_every_problem_has_its_pairs(spark, tmp_path):
    ours, theirs = both(spark, tmp_path, "embedding_best", **vector_tables(300, 7))
    assert ours == theirs and len({r[1] for r in ours}) == 50


def test_every_problem_is_listed(spark, tmp_path):
    ours, theirs = both(spark, tmp_path, "predictions_per_problem", **vector_tables(300, 7))
    assert ours == theirs and len(ours) == 50


def test_copies_are_taken_by_reference(spark):
    """Wherever they stand in their blocks, copies of a vector are equally near to it."""
    schema, rows = vector_tables(300, 7)["embeddings"]
    vectors = spark.createDataFrame(rows, schema).select(F.concat(F.lit("v-"), F.col("vec_id").cast("string")).alias("reference"), "embedding")
    want = {(f"v-{i}", k + 1): name for i in range(2100) for k, name in enumerate(sorted(f"v-{j}" for j in range(i % 300, 2100, 300) if j != i)[:5])}
    found = [knn.self_top_k(vectors, k=5, threshold=0.3, block_rows=97), knn.top_k(
        vectors.withColumn("query_id", F.col("reference")), vectors, k=5, threshold=0.3, exclude_self=True, block_rows=501, query_rows=93)]
    for near in found:
        assert {(r["query_id"], r["rank"]): r["reference"] for r in near.collect()} == want
