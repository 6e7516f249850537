"""Cosine nearest neighbours of vectors, exact and approximate."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import best_scores

#: Rows of the searched side and of the queries that one task holds at once.
BLOCK_ROWS, QUERY_ROWS = 50_000, 2_000
#: Scores that a task computes at once.
SCORES = 1 << 23
#: Pairs that it multiplies one by one at once.
PAIRS = 1 << 16
NEIGHBOUR = "query_id string, reference string, similarity double"


def _stacked(column: pd.Series) -> np.ndarray:
    vectors = np.stack([np.asarray(x, np.float64) for x in column])
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms == 0, 1, norms)


def _dealt(df: DataFrame, column: str, own: str, blocks: int, other: str, copies: int) -> DataFrame:
    """Rows with a vector, dealt into ``blocks`` by a hash of ``column``, each beside every block of the other side."""
    return df.select(F.col(column).cast("string").alias(column), "embedding").where("embedding IS NOT NULL").withColumns(
        {own: F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))})


def _best(scores: np.ndarray, ids: np.ndarray, names: np.ndarray, asked: np.ndarray, vectors: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` best columns of each row; ties are ordered by name. The last digits of a product of matrices depend on a vector's place
    in it, so what may be among the best is multiplied again pair by pair: equal vectors are equally near."""
    starts = np.arange(0, scores.shape[1], max(1, scores.shape[1] // 64))
    tops = np.maximum.reduceat(scores, starts, axis=1)
    tops[np.isnan(tops)] = -np.inf
    # k stretches of columns have a score that high, so the k best have.
    edge = np.partition(tops, -k, axis=1)[:, -k] if tops.shape[1] >= k else np.full(len(scores), -np.inf)
    at, columns = np.nonzero((scores >= edge[:, None] - 1e-12) & (scores > -np.inf))
    near = [(asked[at[i:i + PAIRS]] * vectors[columns[i:i + PAIRS]]).sum(axis=1) for i in range(0, len(at), PAIRS)]
    near = np.concatenate(near) if near else np.zeros(0)
    order = np.lexsort((pd.factorize(names, sort=True)[0][columns], -near, at))
    at, columns, near = at[order], columns[order], near[order]
    kept = np.arange(len(at)) - np.searchsorted(at, at) < k
    return pd.DataFrame({"query_id": ids[at[kept]], "reference": names[columns[kept]], "similarity": near[kept]})


def _none() -> pd.DataFrame:
    return pd.DataFrame({"query_id": [], "reference": [], "similarity": []}).astype({"query_id": str, "reference": str, "similarity": float})


def _searcher(k: int, exclude_self: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The ``k`` best rows of a block for each query of a block, by exact cosine; ties go to the smaller reference."""
    def search(part: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found, names = [_none()], rows["reference"].to_numpy()
        vectors = _stacked(rows["embedding"]) if len(rows) else None
        step = max(1, SCORES // max(1, len(rows)))
        for start in range(0, len(part) if len(rows) else 0, step):
            asked = part.iloc[start:start + step]
            ids = asked["query_id"].to_numpy()
            own = _stacked(asked["embedding"])
            scores = own @ vectors.T
            if exclude_self:
                scores[ids[:, None] == names[None, :]] = -np.inf
            found.append(_best(scores, ids, names, own, vectors, k))
        return pd.concat(found, ignore_index=True)

    return search


def self_top_k(rows: DataFrame, k: int = 2, threshold: float = 0.45, threshold_first: bool = True, block_rows: int = QUERY_ROWS * 2) -> DataFrame:
    """(query_id, reference, similarity, rank): the ``k`` nearest other rows of each row (reference, embedding), as ``top_k`` of a table with itself.

    Rows are dealt into blocks by a hash; each pair of blocks is multiplied once, in one task, which keeps k rows for the rows of both.
    """
    k = max(1, k)
    blocks = max(1, -(-rows.count() // block_rows))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        low, high = int(frame["low"].iloc[0]), int(frame["high"].iloc[0])
        part, others = frame[frame["block"] == low], frame[frame["block"] == high]
        found, names = [_none()], others["reference"].to_numpy()
        vectors = _stacked(others["embedding"]) if len(others) else None
        step = max(1, SCORES // max(1, len(others)))
        for start in range(0, len(part) if len(others) else 0, step):
            asked = part.iloc[start:start + step]
            ids = asked["reference"].to_numpy()
            own = _stacked(asked["embedding"])
            scores = own @ vectors.T
            scores[ids[:, None] == names[None, :]] = -np.inf
            found.append(_best(scores, ids, names, own, vectors, k))
            if low < high:
                found.append(_best(scores.T, names, ids, vectors, own, k))
        return pd.concat(found, ignore_index=True)

    dealt = rows.select(F.col("reference").cast("string").alias("reference"), "embedding").where("embedding IS NOT NULL").withColumn(
        "block", F.pmod(F.xxhash64("reference"), F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        "reference", "embedding", "block", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"))
    return _ranked(dealt.groupBy("low", "high").applyInPandas(search, NEIGHBOUR), k, threshold, threshold_first)


def _ranked(found: DataFrame, k: int, threshold: float, threshold_first: bool) -> DataFrame:
    near = F.col("similarity") >= threshold
    found = found.where(near) if threshold_first else found
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "reference")
    return found.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & near)


def top_k(queries: DataFrame, side: DataFrame, k: int = 5, threshold: float = 0.45, exclude_self: bool = False,
          threshold_first: bool = False, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, reference, similarity, rank): the ``k`` nearest rows of ``side`` of each query.

    ``queries``: (query_id, embedding), ``side``: (reference, embedding); rows without a vector take no part. The k nearest
    are taken first and the threshold applied to them, or the other way round with ``threshold_first``; ties go to the
    smaller reference. Both sides are dealt into blocks of about ``query_rows`` and ``block_rows``; a task multiplies one
    block of each and keeps k rows a query, and a window over those merges them. No vector reaches the driver.
    """
    k = max(1, k)
    query_blocks, side_blocks = max(1, -(-queries.count() // query_rows)), max(1, -(-side.count() // block_rows))
    asked = _dealt(queries, "query_id", "q", query_blocks, "s", side_blocks).groupBy("q", "s")
    found = asked.cogroup(_dealt(side, "reference", "s", side_blocks, "q", query_blocks).groupBy("q", "s")).applyInPandas(
        _searcher(k, exclude_self), NEIGHBOUR)
    return _ranked(found, k, threshold, threshold_first)


#: An inverted file is fitted on so many rows at most, chosen by a hash of their reference, and has so many cells at most.
SAMPLE_ROWS, MOST_CELLS = 20_000, 4096
#: Rows of the sample whose neighbours decide how many cells a query probes.
PROBED_ROWS = 512


class Cells(NamedTuple):
    """An inverted file's cells: their centres (unit vectors) and how many of the nearest a query probes."""

    centres: np.ndarray
    probes: int


def fit_cells(side: DataFrame, k: int = 10, recall: float = 0.97, cells: int = 0, seed: int = 1) -> Cells | None:
    """Cells from k-means by cosine on a bounded sample of ``side`` (reference, embedding); None if it has no vector.

    There are as many cells as the square root of the rows, ``MOST_CELLS`` at most. ``probes`` is the least number of cells by which the ``k`` nearest
    neighbours of sampled rows, within the sample, are found at the wanted rate; in the whole table neighbours are nearer, so it errs high.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = side.where("embedding IS NOT NULL").where(F.exists("embedding", lambda x: x != 0))
    sample = rows.withColumn("_order", F.xxhash64(F.col("reference").cast("string"), F.lit(seed))).orderBy("_order").limit(SAMPLE_ROWS).select("embedding")
    vectors = sample.toPandas()["embedding"]
    if not len(vectors):
        return None
    unit = _stacked(vectors)
    k_cells = min(cells or int(round(rows.count() ** 0.5)), MOST_CELLS, len(unit))
    if k_cells < 2:
        return Cells(unit.mean(axis=0, keepdims=True), 1)
    frame = side.sparkSession.createDataFrame([(x,) for x in unit.tolist()], "embedding array<double>").select(array_to_vector("embedding").alias("features"))
    centres = np.array(KMeans(k=k_cells, seed=seed, maxIter=10, distanceMeasure="cosine").fit(frame).clusterCenters())
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    cell = (unit @ centres.T).argmax(axis=1)
    asked = unit[:PROBED_ROWS]
    near = np.argsort(-(asked @ unit.T), axis=1, kind="stable")[:, :k]
    order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel())
    return Cells(centres, int(needed[min(needed.size - 1, int(np.ceil(recall * needed.size)))]) + 1)


def _nearest_cells(df: DataFrame, column: str, centres: np.ndarray, most: int) -> DataFrame:
    """(``column``, embedding, cell): each row with a vector beside its ``most`` nearest cells, the centres broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                scores = _stacked(frame["embedding"]) @ shared.value.T
                order = np.argpartition(-scores, most - 1, axis=1)[:, :most] if most < scores.shape[1] else np.tile(np.arange(scores.shape[1]), (len(frame), 1))
                yield frame.assign(cells=list(order.astype(np.int32)))

    rows = df.select(F.col(column).cast("string").alias(column), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding IS NOT NULL")
    found = rows.mapInPandas(run, f"{column} string, embedding array<double>, cells array<int>")
    return found.select(column, "embedding", F.explode("cells").alias("cell"))


def assign_cells(side: DataFrame, index: Cells) -> DataFrame:
    """(reference, embedding, cell): every row of ``side`` that has a vector, in the cell of its nearest centre; the inverted file, to be written once."""
    return _nearest_cells(side, "reference", index.centres, 1)


def search_cells(queries: DataFrame, assigned: DataFrame, index: Cells, k: int = 10, threshold: float = -1.0, exclude_self: bool = False,
                 threshold_first: bool = False, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, reference, similarity, rank) as ``top_k``, among the rows of the cells that a query probes; similarities are exact.

    A cell of many rows, or probed by many queries, is dealt into blocks of about ``block_rows`` and ``query_rows``, so no cell has to fit a task.
    """
    k = max(1, k)
    asked = _nearest_cells(queries, "query_id", index.centres, index.probes)
    blocks = lambda df, name, rows: df.groupBy("cell").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    # A row a cell, MOST_CELLS at most.
    sizes = F.broadcast(blocks(assigned, "s_blocks", block_rows).join(blocks(asked, "q_blocks", query_rows), "cell"))

    def dealt(df: DataFrame, column: str, own: str, other: str) -> DataFrame:
        return df.join(sizes, "cell").select(column, "embedding", "cell", F.pmod(F.xxhash64(column), f"{own}_blocks").cast("int").alias(own),
                                             F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(other)).groupBy("cell", "q", "s")

    found = dealt(asked, "query_id", "q", "s").cogroup(dealt(assigned, "reference", "s", "q")).applyInPandas(_searcher(k, exclude_self), NEIGHBOUR)
    return _ranked(found, k, threshold, threshold_first)


def compared_pairs(queries: DataFrame, assigned: DataFrame, index: Cells) -> DataFrame:
    """(compared): the pairs whose similarity ``search_cells`` computes."""
    asked = _nearest_cells(queries, "query_id", index.centres, index.probes).groupBy("cell").agg(F.count("*").alias("a"))
    return asked.join(assigned.groupBy("cell").agg(F.count("*").alias("b")), "cell").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("compared"))


def recall_at(exact: DataFrame, found: DataFrame) -> DataFrame:
    """(neighbours, recall): how many of the exact (query_id, reference) rows are found; 1 if there are none."""
    hit = exact.select("query_id", "reference").join(found.select("query_id", "reference").withColumn("hit", F.lit(1)), ["query_id", "reference"], "left")
    return hit.agg(F.count("*").alias("neighbours"), F.coalesce(F.count("hit") / F.count("*"), F.lit(1.0)).alias("recall"))


def approximate_neighbours(queries: DataFrame, side: DataFrame, threshold: float, bucket: float = 0.5, tables: int = 8, seed: int = 1) -> DataFrame:
    """(query_id, reference, similarity) by locality-sensitive hashing of unit vectors; some pairs may be missed."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector

    def unit(df: DataFrame) -> DataFrame:
        vectors = df.withColumn("v", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))
        return Normalizer(inputCol="v", outputCol="unit").transform(vectors).drop("v")

    a, b = unit(queries), unit(side)
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(b)
    pairs = model.approxSimilarityJoin(a, b, (2 * (1 - threshold)) ** 0.5, "distance")
    return pairs.select("datasetA.query_id", "datasetB.reference", (1 - F.col("distance") ** 2 / 2).alias("similarity"))


def embed_texts(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """Add ``embedding`` by a pluggable ``embed(texts)``, in batches, order kept; null text counts as empty."""
    columns = rows.columns
    schema = rows.withColumn("embedding", F.lit(None).cast("array<float>")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = ["" if t is None else t for t in frame["text"]]
            vectors = [v for i in range(0, len(texts), batch) for v in embed(texts[i:i + batch])]
            yield frame[columns].assign(embedding=vectors)

    return rows.mapInPandas(run, schema)


def embedding_pairs(neighbours: DataFrame) -> DataFrame:
    """Best score of each (problem, reference) over its chunks; ``neighbours`` has (problem_id, reference, similarity)."""
    return best_scores(neighbours.withColumnRenamed("similarity", "score")).withColumn("method", F.lit("embedding"))
