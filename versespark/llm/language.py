"""Language ID by compression: the language whose raw-content dictionary packs a text smallest.

``fit`` builds one zstandard raw-content dictionary per language from a bounded sample of labelled
rows (whole texts in hash order, ``SAMPLE_BYTES`` a language, or an equal share of ``ALL_BYTES`` where there are very many). ``classify``
cuts every whole text into pieces of ``PIECE`` bytes, so that a long text does not become its own
dictionary, compresses each piece with every dictionary and adds up. The smallest total wins, ties go to
the label with more training rows; ``score`` is the saving against the runner-up, and a row is rejected under ``MIN_MARGIN``.

Defined cases: null texts and texts without a letter are ``und``, score 0, rejected; without training rows
every row is ``und``; with one language its score is 1; repeated rows agree; ``classify`` keeps the input's columns,
those named like a result column are replaced, and ``confident`` keeps all of them as they are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

SAMPLE_BYTES = 128 << 10
SAMPLE_ROWS = 600
ALL_BYTES = 64 << 20
PIECE = 4096
LEVEL = 9
MIN_MARGIN = 0.005
LETTER = r"\p{L}"


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3; rows with 1 are held out of training."""
    return F.crc32(doc_id.cast("string")) % 3


def fit(labelled: DataFrame) -> dict[str, bytes]:
    """Language -> dictionary, most frequent first, from (doc_id, text, lang) rows; only the bounded sample reaches the driver."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL AND length(text) > 0").select(
        "lang", "text", F.xxhash64("doc_id", "lang").alias("h"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return {}
    most = min(SAMPLE_BYTES, ALL_BYTES // len(counts))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, SAMPLE_ROWS / r["count"])))])
    drawn = rows.where(F.pmod("h", F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    upto = Window.partitionBy("lang").orderBy("h", "text").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(upto), F.lit(0)))
    out: dict[str, bytes] = {r["lang"]: b"" for r in counts}
    for lang, text in drawn.where(F.col("before") < most).select("lang", "text").sort("lang", "h").toLocalIterator():
        out[lang] += text.lower().encode() + b"\n"
    return {k: v[:most] for k, v in out.items() if v}


def judged_rows(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """(row, lang_pred, score, rejected): every row of ``docs`` as one struct, so that no name of its columns clashes."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"),
                       F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("has_letter"))
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL("lang_pred string, score double, rejected boolean")])
    shared = docs.sparkSession.sparkContext.broadcast(list(dictionaries.items()))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packers = []
        for lang, content in shared.value:
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            packers.append((lang, zstandard.ZstdCompressor(
                level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False,
                write_dict_id=False)))

        def judge(data: bytes) -> tuple[str, float]:
            sizes = sorted(
                (sum(len(packer.compress(data[i:i + PIECE])) for i in range(0, len(data), PIECE)), order, lang)
                for order, (lang, packer) in enumerate(packers))
            return sizes[0][2], 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0

        for batch in batches:
            for part in slices(batch, "text"):
                found = [judge(f" {text.as_py().lower()} ".encode()) if ok.as_py() and packers else ("und", 0.0)
                         for text, ok in zip(part.column("text"), part.column("has_letter"), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64()),
                     pa.array([x == "und" or s < MIN_MARGIN for x, s in found], pa.bool_())],
                    names=schema.names)

    return rows.mapInArrow(judged, schema)


def classify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``."""
    names = ("lang_pred", "score", "rejected")
    return judged_rows(docs, dictionaries).select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in names], *names)


def confident(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language the compressors cannot tell, columns as they are."""
    fitted = fit(docs.where(fold(F.col("doc_id")) != 1))
    return judged_rows(docs, fitted).where("NOT rejected").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the rows outside the held-out fold, then classify every row."""
    return classify(docs, fit(docs.where(fold(F.col("doc_id")) != 1)))
