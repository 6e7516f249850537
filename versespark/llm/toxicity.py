"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: density, count and strength of lexicon words and word stems, hits near a second-person word,
capitals, exclamation and question marks, obfuscated words (and lexicon words behind the obfuscation), length. The lexicon
is learned from labelled rows: words and stems whose log-odds of standing in toxic texts are significant.
Trees come from Spark's own learner; a part of the training rows that neither lexicon nor trees have seen
calibrates their probability (a tenth of the raw probability is mixed in to keep the order within a calibrated step).

At most about ``TRAIN_ROWS`` labelled rows, drawn by a hash of doc_id, are used for fitting; every text is scored whole.

Defined cases: null texts count as empty; rows without doc_id are scored and never trained on; without
training rows of both labels every score is the share of toxic rows, smoothed; repeated rows agree; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, written

TRAIN_ROWS = 20_000
CALIBRATE_SHARE = 0.2
LEXICON_SIZE = 5_000
LEAST_DOCS = 3
LEAST_Z = 3.0
STEMS = (4, 5)
NEAR = 5
ROUNDS, DEPTH = 20, 3
#: Second-person words of the languages at hand, and signs that stand for letters.
SECOND_PERSON = frozenset("""you your yours yourself u ur tu te ti toi ton ta tes vous votre vos du dich dir dein
deine deinen deinem deiner ihr euch euer eure tú usted ustedes vosotros vuestro vuestra tuyo tuya""".split())
UNMASK = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})
MASKED = re.compile(rb"[A-Za-z][@$*0-9!]+[A-Za-z]")
EDGES = ".,;:!?\"'()[]{}<>|#*$%&-_/\\«»¿¡…“”„"
NAMES = ["word_density", "word_hits", "stem_density", "stem_hits", "strongest", "near_second_person",
         "capitals", "shouts", "masked", "unmasked_hits", "length"]


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; rows with 0 are held out of training."""
    return F.crc32(doc_id.cast("string")) % 5


def words_of(text: str) -> list[str]:
    return [w for w in [w.strip(EDGES) for w in text.lower().split()] if w]


def stems_of(word: str) -> list[str]:
    """The beginnings of a longer word, told from words by a leading blank."""
    return [" " + word[:n] for n in STEMS if len(word) > n]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and stems (marked by a leading blank) that a text holds, once each."""
    for batch in batches:
        for part in slices(batch, "text"):
            units, toxic = [], []
            for text, label in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                held = set(words_of(text or ""))
                held |= {s for w in held for s in stems_of(w)}
                units += held
                toxic += [label] * len(held)
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array(toxic, pa.int32())], names=["unit", "toxic"])


def lexicon(train: DataFrame) -> dict[str, float]:
    """Unit -> log-odds, of at most LEXICON_SIZE units; counted in Spark."""
    totals = train.agg(F.sum("toxic"), F.count("*")).first()
    bad, good = totals[0], totals[1] - totals[0]
    t, c = F.col("t"), F.col("n") - F.col("t")
    odds = F.log((t + 0.5) / (bad + 1 - t + 0.5)) - F.log((c + 0.5) / (good + 1 - c + 0.5))
    units = train.select("text", "toxic").mapInArrow(_units, "unit string, toxic int").groupBy("unit").agg(
        F.sum("toxic").alias("t"), F.count("*").alias("n")).where(t >= LEAST_DOCS)
    rows = units.select("unit", odds.alias("odds"), (odds / F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))).alias("z"))
    rows = rows.where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "unit").limit(LEXICON_SIZE)
    return {r["unit"]: float(r["odds"]) for r in rows.collect()}


def measured(text: str, known: dict[str, float]) -> list[float]:
    data = text.encode()
    words = words_of(text)
    n = max(1, len(words))
    hits = [(i, known[w]) for i, w in enumerate(words) if w in known]
    stems = [(i, max(known[s] for s in stems_of(w) if s in known)) for i, w in enumerate(words)
             if len(w) > STEMS[0] and any(s in known for s in stems_of(w))]
    places = np.array(sorted({i for i, _ in hits} | {i for i, _ in stems}), np.int64)
    near = 0
    if places.size:
        persons = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON], np.int64)
        if persons.size:
            at = np.searchsorted(persons, places)
            after = np.abs(persons[np.minimum(at, persons.size - 1)] - places)
            before = np.abs(persons[np.maximum(at - 1, 0)] - places)
            near = int((np.minimum(after, before) <= NEAR).sum())
    letters = np.frombuffer(data, np.uint8)
    upper = int(((letters >= 65) & (letters <= 90)).sum())
    lower = int(((letters >= 97) & (letters <= 122)).sum())
    masked = len(MASKED.findall(data))
    unmasked = sum(w.translate(UNMASK) in known for w in words if not w.isalpha()) if masked else 0
    return [len(hits) / n, math.log1p(len(hits)), len(stems) / n, math.log1p(len(stems)),
            max([x for _, x in hits] + [x for _, x in stems], default=0.0), math.log1p(near),
            upper / max(1, upper + lower), (data.count(b"!") + data.count(b"?")) / n, masked / n,
            math.log1p(unmasked), math.log1p(len(words))]


def features(docs: DataFrame, known: dict[str, float]) -> DataFrame:
    """The columns of ``docs`` but its text, and the features."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    kept = [c for c in docs.columns if c != "text"]
    schema = docs.select(*kept).schema
    for name in NAMES:
        schema = schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = np.array([measured(t or "", shared.value) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], *[pa.array(rows[:, i]) for i in range(len(NAMES))]],
                    names=[*kept, *NAMES])

    return docs.mapInArrow(run, schema)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, calibrate) of the bounded sample of labelled rows outside the held-out fold."""
    labelled = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold(F.col("doc_id")) != 0).select(
        "doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    n = labelled.count()
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * min(1.0, TRAIN_ROWS / max(1, n)))
    calibrate = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(1000)) < int(1000 * CALIBRATE_SHARE)
    # Bounded by TRAIN_ROWS, so it can be broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic", calibrate.alias("calibrate"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    train = written(training_rows(docs, labels), "toxicity-train")
    fitting = train.where("NOT calibrate")
    seen = {r["toxic"]: r["count"] for r in fitting.groupBy("toxic").count().collect()}
    if len(seen) < 2:
        share = (seen.get(1, 0) + 0.5) / (sum(seen.values()) + 1)
        return docs.select("doc_id", F.lit(share).alias("score"))
    known = lexicon(fitting)
    assembler = VectorAssembler(inputCols=NAMES, outputCol="features")
    table = assembler.transform(written(features(train, known).coalesce(6), "toxicity-features"))
    trees = GBTClassifier(labelCol="toxic", maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.2, seed=7).fit(
        table.where("NOT calibrate").select("features", F.col("toxic").cast("double").alias("toxic")))
    raw = vector_to_array("probability")[1]
    checked = trees.transform(table.where("calibrate")).select(
        raw.alias("raw"), F.col("toxic").cast("double").alias("label"))
    out = trees.transform(assembler.transform(features(docs, known))).select("doc_id", raw.alias("raw"))
    if checked.select("label").distinct().count() < 2:
        return out.select("doc_id", F.col("raw").alias("score"))
    steps = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="step").fit(checked)
    return steps.transform(out).select("doc_id", (0.9 * F.col("step") + 0.1 * F.col("raw")).alias("score"))
