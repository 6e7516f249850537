"""Pairs of (problem, reference) and their score against gold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.refs import normalize_reference, strip

PAIR = ["problem_id", "reference"]


def prediction_pairs(predictions: DataFrame) -> DataFrame:
    """Distinct pairs; ids are trimmed, empty ids and references dropped."""
    rows = predictions.select(strip(F.coalesce("problem_id", F.lit(""))).alias("problem_id"), normalize_reference(F.col("reference")).alias("reference"))
    return rows.where("problem_id <> '' AND reference <> ''").distinct()


def truth_pairs(spans: DataFrame) -> DataFrame:
    """Distinct pairs of gold spans; ids are not trimmed and empty references stay."""
    rows = spans.select("problem_id", F.explode("resolved_references").alias("reference"))
    return rows.select("problem_id", normalize_reference(F.col("reference")).alias("reference")).distinct()


def best_scores(scored: DataFrame) -> DataFrame:
    """The best score of each pair."""
    return scored.groupBy(*PAIR).agg(F.max("score").alias("score"))


def error_sets(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Distinct pairs with ``kind``: tp, fp or fn, by one full outer join."""
    p, t = predicted.select(*PAIR, F.lit(True).alias("p")), truth.select(*PAIR, F.lit(True).alias("t"))
    kind = F.when(F.col("p") & F.col("t"), "tp").when(F.col("p"), "fp").otherwise("fn")
    return p.join(t, PAIR, "full").select(*PAIR, kind.alias("kind"))


def score_pairs(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of metrics; a zero denominator gives 0."""
    counts = error_sets(predicted, truth).agg(*[F.count_if(F.col("kind") == k).cast("double").alias(k) for k in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rows = counts.select(tp.alias("true_positives"), fp.alias("false_positives"), fn.alias("false_negatives"),
                         ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return rows.withColumn("f1", ratio(2 * p * r, p + r))


def first_problems(problems: DataFrame, n: int) -> DataFrame:
    return problems.join(problems.select("problem_id").distinct().orderBy("problem_id").limit(n), "problem_id", "left_semi")


def subset(rows: DataFrame, problems: DataFrame) -> DataFrame:
    return rows.join(problems.select("problem_id").distinct(), "problem_id", "left_semi")


def evaluate(predictions: DataFrame, spans: DataFrame, problems: DataFrame | None = None) -> DataFrame:
    truth = truth_pairs(spans)
    return score_pairs(prediction_pairs(predictions), subset(truth, problems) if problems is not None else truth)
