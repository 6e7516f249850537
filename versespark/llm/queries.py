"""The registered queries opN_<name>: thin digests of the operators over the whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html, language, licenses, passages, periodic, pieces, quality, sharding, simhash, toxicity, whitening
from .common import read


def op1_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_recurring", "n_signed")


def op2_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality.cascade(read(spark, sf_dir, "documents").select("doc_id", "text"))
    q, failed = F.col("_q"), quality.base_failed(F.col("_q"))
    return kept.select(
        "doc_id", q["n_words"].alias("n_words"), q["word_chars"].alias("word_chars"),
        q["n_symbols"].alias("n_symbols"), q["n_dup_lines"].alias("n_dup_lines"),
        q["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"),
        (~failed & F.col("rejected_by").isNull()).alias("kept"))


def op3_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(read(spark, sf_dir, "documents")).withColumn(
        "n_words", F.col("end_word") - F.col("start_word"))


def op4_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents go through both passes; the digests are of the texts that came out in the shards."""
    docs, text = read(spark, sf_dir, "documents"), F.coalesce("text", F.lit(""))
    records = docs.select(*[c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns])
    return sharding.shuffled(records, ["doc_id"]).select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op5_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", (F.coalesce(toxicity.fold(F.col("doc_id")), F.lit(1)) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fitted = language.fit(docs.where(language.fold(F.col("doc_id")) != 1))
    return language.classify(docs.select("doc_id", "text"), fitted).select(
        "doc_id", (F.coalesce(language.fold(F.col("doc_id")), F.lit(0)) == 1).alias("held_out"),
        "lang_pred", "score", "rejected")


def op11_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_backtracking_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), piece_model_path())
    return coded.select("doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``runs`` stand by start, then period, so of equal exponents the first is kept."""
    found = periodic.detect(read(spark, sf_dir, "documents").select("doc_id", "text"), periodic.folded)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {f.__name__: f for f in (
    op1_template_removal, op2_quality_cascade, op3_compact_windows, op4_two_pass_shuffle, op5_string_tiling,
    op6_simhash_covering, op7_license_scan, op8_boosted_toxicity, op9_segment_tree_bpe, op10_compression_language,
    op11_whitened_embeddings, op12_backtracking_pieces, op13_periodic_runs)}
