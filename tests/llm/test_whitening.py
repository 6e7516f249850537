"""Whitening against numpy over the whole table, and its odd cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from versespark.llm import queries, whitening

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, n long, place string"


def brute(rows):
    """{row number: [(component, n, deviation, whitened, explained)]} with Python integers and numpy's eigenvectors."""
    x = [[math.floor(64.0 * c) + 1_000_000 for c in v] for v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    y = np.array([[(n * r[j] - sums[j]) / n for j in range(d)] for r in x])
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1][:32], q[:, ::-1][:, :32]
    return [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x], y @ q / np.sqrt(e), e / np.trace(y.T @ y / n)


def test_query_against_numpy(spark):
    got = queries.op11_whitened_embeddings(spark, DATA).toPandas()
    table = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    deviation, whitened, explained = brute([list(map(float, v)) for v in table["embedding"]])
    k = whitened.shape[1]
    assert len(got) == len(table) * k and got["n"].eq(len(table)).all() and got["identity_error"].between(0, 1e-4).all()
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[table["vec_id"]].to_numpy()
    sign = np.sign((wide * whitened).sum(axis=0))
    assert np.abs(wide * sign - whitened).max() < 1e-6
    assert np.allclose(got.groupby("component")["explained"].first().to_numpy(), explained, rtol=1e-9)
    assert dict(zip(got["vec_id"], got["deviation"], strict=True)) == dict(zip(table["vec_id"], deviation, strict=True))


def test_results_do_not_depend_on_partitions(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding")
    a, b = (whitening.covariance(rows.repartition(k), "embedding", 64) for k in (1, 7))
    assert np.array_equal(a[0], b[0]) and a[1:] == b[1:]


def test_odd_rows(spark):
    draw = np.random.default_rng(5)
    fine = [draw.standard_normal(3).tolist() for _ in range(40)]
    odd = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 1.0], [1.0, float("inf"), 0.0], [1.0, 2.0], [1.0, 2.0, 3.0, 4.0]]
    rows = [(i if i else None, v, 7, "x") for i, v in enumerate([*fine, fine[3], *odd])]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got.columns == ["vec_id", "place", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    out = got.toPandas()
    assert len(out) == 41 * 3 and set(out["n"]) == {41} and out["vec_id"].isna().sum() == 3 and out["identity_error"].max() < 1e-9
    deviation, whitened, _ = brute([np.float32(v).astype(float).tolist() for v in [*fine, fine[3]]])
    first = out[out["component"] == 1].set_index("vec_id")
    assert first.loc[3, "deviation"] == deviation[3] == first.loc[40, "deviation"]
    assert abs(abs(first.loc[5, "whitened"]) - abs(whitened[5, 0])) < 1e-9


@pytest.mark.parametrize("rows", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, None], [[], []]])
def test_nothing_to_whiten(spark, rows):
    got = whitening.whiten(spark.createDataFrame([(i, v, 1, "") for i, v in enumerate(rows)], SCHEMA))
    assert got.count() == 0 and "whitened" in got.columns


def test_large_entries_and_missing_variance(spark):
    rows = [(i, [float(3 * i), 5.0, 1e15 * (i % 2), 3e30 * (i % 3)], 0, "") for i in range(12)]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA.replace("float", "double"))).toPandas()
    assert set(out["component"]) <= {1, 2, 3} and np.isfinite(out["whitened"]).all() and out["deviation"].isna().all()


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_eigenvectors(d):
    draw = np.random.default_rng(d)
    for v in (np.cov(draw.standard_normal((d, 3 * d + 2))).reshape(d, d), np.eye(d), np.kron(np.eye(d), [[2.0, 1.0], [1.0, 2.0]]), np.ones((d, d))):
        values, axes = whitening.components(v, 32)
        expected = np.linalg.eigvalsh(v)[::-1][:32]
        assert np.allclose(values, expected[:len(values)], rtol=0, atol=1e-13 * expected[0])
        assert np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-13
        assert np.abs(v @ axes - axes * values).max() < 1e-13 * expected[0]
        assert (whitening.below(*whitening.tridiagonal(v)[:2], np.array([1e9, -1e9])) == [len(v), 0]).all()


def test_equal_vectors_far_apart(spark):
    """A third of all rows is one vector."""
    rows = [(i, [0.25, -0.5] if i % 3 == 0 else [i / 7, (i * i) % 11 / 3], 0, "") for i in range(90)]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).where(F.col("vec_id") % 3 == 0).select("component", "whitened").distinct()
    assert out.count() == 2
