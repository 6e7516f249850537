"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a Boolean column (true: the text is rejected) over measures of the text. The cascade is
one COALESCE: the first rule that rejects ends the evaluation of a row. Before it is built, every
rule's own cost (seconds beside the measures that all rules share) and rejections are measured on a
bounded random sample, and rules are ordered by rejections per second. The order changes the time
only: a row is kept when no rule rejects it, whatever the order.

Defined cases: a null text counts as empty (no words, rejected); an empty table gives no rows; equal
rows get equal results; extra columns are carried or dropped as the caller selects; clashing
names cannot occur, since measures live in one struct column named ``_q``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS

#: Rows of the sample on which rules are timed. It sets the order of the rules, never a result.
SAMPLE_ROWS = 1500
#: Runs of each rule, and the least cost that a clock can tell.
TIMES, LEAST_SECONDS = 3, 0.002
WINDOW = 8


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable holds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+"))


def window_hashes(words: Column) -> Column:
    """64-bit hashes of the windows of eight words, by doubling: pairs, then fours, then eights."""
    def doubled(hashes: Column, step: int) -> Column:
        return _bind(hashes, lambda h: F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - step, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get(h, i + step))))

    single = F.transform(words, lambda w: F.xxhash64(w))
    return doubled(doubled(doubled(single, 1), 2), 4)


def covered_words(hashes: Column) -> Column:
    """Words lying in windows whose hash occurs twice or more in the text.

    The windows are sorted by (hash, place) and the places of equal neighbours are covered from
    left to right; all steps are linear or n log n in the text.
    """
    def beside(s: Column, x: Column, i: Column) -> Column:
        return F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))

    def covered(places: Column) -> Column:
        return F.aggregate(F.transform(places, lambda p, i: F.least(
            F.lit(WINDOW), F.coalesce(F.get(places, i + 1), p + F.lit(WINDOW)) - p)),
            F.lit(0), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    alike = _bind(pairs, lambda s: F.filter(s, lambda x, i: beside(s, x, i - 1) | beside(s, x, i + 1)))
    return _bind(F.sort_array(F.transform(alike, lambda x: x["i"])), covered)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_q``, a struct of the base measures.

    Windows are compared by 64-bit hashes; most texts repeat none, which one pass over a primitive
    array tells. The generators keep the optimizer from copying the measures into every rule.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    counts = F.struct(
        _bind(words_of(text), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), window_hashes(w).alias("hashes"))).alias("w"),
        _bind(lines, lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"))
    repeats = F.size(F.array_distinct("_m.w.hashes")) < F.size("_m.w.hashes")
    whole = F.struct(
        F.col("_m.w.n_words").alias("n_words"),
        F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.col("_m.l.n_lines").alias("n_lines"), F.col("_m.l.n_dup_lines").alias("n_dup_lines"),
        F.when(repeats, covered_words(F.col("_m.w.hashes"))).otherwise(0).cast("long").alias("n_repeat_words"))
    return (docs.select("*", F.explode(F.array(counts)).alias("_m"))
            .select("*", F.explode(F.array(whole)).alias("_q")).drop("_m"))


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])


def rules(text: Column, q: Column) -> dict[str, Column]:
    """Name -> true if the rule rejects the text. Thresholds are ratios, written without division."""
    text, n = F.coalesce(text, F.lit("")), q["n_words"]
    return {
        "too_short": n < 20,
        "repeats": 100 * q["n_repeat_words"] > 30 * n,
        "symbols": 10 * q["n_symbols"] > n,
        "dup_lines": 2 * q["n_dup_lines"] > q["n_lines"],
        "word_length": (q["word_chars"] < 2 * n) | (q["word_chars"] > 20 * n),
        "capitals": 10 * F.regexp_count(text, F.lit("[A-Z]")) > 4 * q["word_chars"],
        "digits": 10 * F.regexp_count(text, F.lit("[0-9]")) > 3 * q["word_chars"],
        "exclaims": 10 * F.regexp_count(text, F.lit("[!?]")) > 3 * n,
    }


def rule_order(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, int]]:
    """(rule, seconds, rejections) on a sample of about ``sample_rows`` rows, best rejection per cost first.

    The measures that the base needs anyway are made once and kept; a rule's cost is the median of ``TIMES`` runs over them
    less that of a rule that does nothing.
    """
    total = docs.count()
    sample = docs.select("text")
    if total > sample_rows:
        sample = sample.sample(fraction=sample_rows / total, seed=42)
    sample = measured(sample.repartition(4)).persist()
    try:
        tests = {"": F.lit(True), **rules(F.col("text"), F.col("_q"))}
        runs: dict[str, list[float]] = {name: [] for name in tests}
        hits = {}
        for k in range(TIMES + 1):  # the first run fills the cache and compiles
            for name, test in tests.items():
                began = time.perf_counter()
                hits[name] = sample.agg(F.count_if(test)).first()[0]
                if k:
                    runs[name].append(time.perf_counter() - began)
    finally:
        sample.unpersist()
    costs = {name: max(LEAST_SECONDS, median(runs[name]) - median(runs[""])) for name in tests if name}
    return sorted(((name, cost, hits[name]) for name, cost in costs.items()), key=lambda x: (-x[2] / x[1], x[0]))


def cascade(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``_q`` (measures) and ``rejected_by`` (the rule that ended the cascade, else null)."""
    order = [name for name, _, _ in rule_order(docs, sample_rows)]

    def chain(row: Column) -> Column:
        tests = rules(row["text"], row["q"])
        return F.coalesce(*[F.when(tests[name], F.lit(name)) for name in order])

    # One lambda holds the cascade: as generated code its many patterns took the compiler gigabytes.
    return measured(docs).withColumn("rejected_by", _bind(F.struct("text", F.col("_q").alias("q")), chain))
