"""Text reuse: shared character n-grams, passages, local alignment, nested output and its reshaping."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.refs import aligned_end, chunk_id, parse_chunk_id, parse_verse_id, verse_id
from ..sources.shared import written
from .alignment import Alignment, chains, local_alignment, local_alignments  # noqa: F401
from .evaluate import PAIR, best_scores


@dataclass(frozen=True)
class ReuseOptions:
    """Parameters of a reuse job. Unset ones keep their default; ``max_df`` 0 is no bound; ``beam`` and ``pcopy`` have no meaning here."""

    n: int = 8
    min_match: int = 3
    min_align: int = 20
    min_df: int = 1
    max_df: int = 750
    gap: int = 350
    src_overlap: float = 0.70
    dst_overlap: float = 0.5
    beam: int = 1000
    pcopy: float = 0.75

    @classmethod
    def of(cls, **given) -> ReuseOptions:
        unknown = given.keys() - asdict(cls()).keys()
        if unknown:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        return cls(**{k: v for k, v in given.items() if v is not None})


def records(chunks: DataFrame, verses: DataFrame) -> DataFrame:
    """Chunks (problem_id, chunk_index, chunk_start, chunk_end, text) and verses (reference, text) in one table."""
    task = chunks.select(chunk_id(F.col("problem_id"), F.col("chunk_index")).alias("id"), F.lit("task").alias("group"), "*")
    bible = verses.select(verse_id(F.col("reference")).alias("id"), F.lit("bible").alias("group"), "reference", "text")
    return task.unionByName(bible, allowMissingColumns=True)


def ngrams(rows: DataFrame, n: int) -> DataFrame:
    """(id, group, gram, pos): every character n-gram with its place."""
    places = F.when(F.length("text") >= n, F.sequence(F.lit(1), F.greatest(F.length("text") - (n - 1), F.lit(1))))
    grams = F.transform(places, lambda i: F.substring(F.col("text"), i, F.lit(n)))
    return rows.select("id", "group", F.posexplode(grams).alias("pos", "gram"))


#: Hashes of verse n-grams up to this number go to the tasks as a bit map of fixed size; beyond, all n-grams meet in a join.
MAP_GRAMS, MAP_BITS = 8_000_000, 27


def gram_hashes(texts: list[str], n: int) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """All texts end to end, a hash in ``MAP_BITS`` bits of each n-gram that lies within a text, its row and its place there."""
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    hashes = np.zeros(max(0, points.size - n + 1), np.uint64)
    for j in range(n):
        hashes *= np.uint64(0x9E3779B97F4A7C15)
        hashes += points[j:j + hashes.size]
    row = np.repeat(np.arange(sizes.size), sizes)
    place = np.arange(points.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = place[:hashes.size] <= (sizes[row] - n)[:hashes.size]
    row, place, hashes = row[:hashes.size][inside], place[:hashes.size][inside], hashes[inside]
    hashes ^= hashes >> np.uint64(31)
    return whole, hashes * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - MAP_BITS), row, place


def verse_grams(rows: DataFrame, n: int) -> DataFrame:
    """(id, group, gram, pos): the n-grams that some verse has.

    The verses are the small side. Their n-grams mark a bit map of fixed size, by which a helper leaves out most
    others before any row is made of them; the join that follows is exact.
    """
    bible = ngrams(rows.where("group = 'bible'"), n)
    places = rows.where("group = 'bible'").agg(F.sum(F.greatest(F.length("text") - (n - 1), F.lit(0)))).first()[0] or 0
    marks = rows.where("group = 'bible'").select("text").mapInArrow(_marks(n), "mark int").distinct()
    spark = rows.sparkSession
    if places > MAP_GRAMS:
        return ngrams(rows, n).join(bible.select("gram").distinct(), "gram", "left_semi")
    bits = np.zeros(1 << MAP_BITS, bool)
    for batch in marks.toArrow().to_batches():
        bits[batch.column(0).to_numpy()] = True
    packed = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = packed.value
        for batch in batches:
            whole, hashes, row, place = gram_hashes([t or "" for t in batch.column("text").to_pylist()], n)
            at = np.flatnonzero(table[hashes >> np.uint64(3)] >> (hashes & np.uint64(7)).astype(np.uint8) & 1)
            row, place = row[at], place[at]
            sizes = np.fromiter((len(t or "") for t in batch.column("text").to_pylist()), np.int64, batch.num_rows)
            starts = (np.cumsum(sizes) - sizes)[row] + place
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row)), batch.column("group").take(pa.array(row)), pa.array(place.astype(np.int32)),
                 pa.array([whole[k:k + n] for k in starts.tolist()], pa.string())], names=["id", "group", "pos", "gram"])

    held = rows.select("id", "group", "text").mapInArrow(marked, "id string, group string, pos int, gram string")
    return held.join(bible.select("gram").distinct(), "gram", "left_semi")


def _marks(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, hashes, _, _ = gram_hashes([t or "" for t in batch.column("text").to_pylist()], n)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes).astype(np.int32))], names=["mark"])
    return run


def document_frequency(grams: DataFrame) -> DataFrame:
    return grams.select("id", "gram").distinct().groupBy("gram").agg(F.count("*").alias("df"))


#: Ids that share a frequent n-gram meet in groups of about this size.
POSTINGS = 10_000


def _frequent(held: DataFrame, options: ReuseOptions) -> DataFrame:
    """(gram, df) of the n-grams in the frequency range."""
    inside = F.col("df") >= options.min_df
    return document_frequency(held).where(inside & (F.col("df") <= options.max_df) if options.max_df else inside)


def _side(held: DataFrame, group: str, name: str, *places: str) -> DataFrame:
    return held.where(F.col("group") == group).select("gram", F.col("id").alias(name), *[F.col(p).alias(f"{name}_{p}") for p in places])


def _joined(held: DataFrame, options: ReuseOptions, *places: str) -> DataFrame:
    kept = _frequent(held, options).select("gram")
    return _side(held, "bible", "verse", *places).join(kept, "gram").join(_side(held, "task", "chunk", *places), "gram")


def shared_grams(held: DataFrame, options: ReuseOptions) -> DataFrame:
    """(verse, chunk, gram, verse_pos, chunk_pos): verse and chunk places of each shared n-gram; ``held`` from ``verse_grams``."""
    return _joined(held, options, "pos").select("verse", "chunk", "gram", "verse_pos", "chunk_pos")


def _rare_first(held: DataFrame, options: ReuseOptions) -> DataFrame:
    """(id, group, grams): the n-grams of each text that has ``min_match`` of them, the rarest first, as structs of df and gram."""
    rows = held.select("id", "group", "gram").distinct().join(_frequent(held, options), "gram")
    return rows.groupBy("id", "group").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("grams")).where(
        F.size("grams") >= options.min_match)


def candidate_pairs(held: DataFrame, options: ReuseOptions) -> DataFrame:
    """(verse, chunk, shared): pairs that share at least ``min_match`` distinct n-grams in the frequency range.

    With a bound on the frequency all n-grams meet. Without one (``max_df`` 0) the result is as exact, and the frequent n-grams do not meet
    as a rule: all texts order their n-grams by rarity, and two that share ``min_match`` share one besides the last ``min_match`` - 1 of
    either. Pairs are found by those before, and all n-grams of a pair found are then counted. The texts of a
    frequent n-gram are dealt into groups of about ``POSTINGS``.
    """
    if options.max_df:
        pairs = _joined(held.select("id", "group", "gram").distinct(), options)
        return pairs.groupBy("verse", "chunk").agg(F.count("*").alias("shared")).where(F.col("shared") >= options.min_match)
    texts = written(_rare_first(held, options), "rare-first")
    verse, chunk = (texts.where(F.col("group") == g).select(F.col("id").alias(name), F.col("grams").alias(f"{name}_grams"))
                    for g, name in (("bible", "verse"), ("task", "chunk")))
    groups = F.expr(f"int(g.df div {POSTINGS})")
    first = lambda side, name: side.select(name, F.explode(F.slice(f"{name}_grams", 1, F.size(f"{name}_grams") - (max(1, options.min_match) - 1))).alias("g"))
    dealt = first(chunk, "chunk").select("chunk", "g.gram", F.pmod(F.xxhash64("chunk"), groups + 1).cast("int").alias("part"))
    copied = first(verse, "verse").select("verse", "g.gram", F.explode(F.sequence(F.lit(0), groups)).alias("part"))
    found = copied.join(dealt, ["gram", "part"]).select("verse", "chunk").distinct()
    counted = found.join(verse, "verse").join(chunk, "chunk").select(
        "verse", "chunk", F.size(F.array_intersect("verse_grams.gram", "chunk_grams.gram")).cast("long").alias("shared"))
    return counted.where(F.col("shared") >= options.min_match)


def pair_hits(held: DataFrame, options: ReuseOptions) -> DataFrame:
    """(verse, chunk, hits): the candidate pairs with all places at which they share an n-gram in the frequency range, as chunk place * 2^32 + verse place."""
    if options.max_df:
        shared = _joined(held, options, "pos")
    else:
        pairs = written(candidate_pairs(held, options).select("verse", "chunk"), "pairs")
        shared = pairs.join(_side(held, "bible", "verse", "pos"), "verse").join(_side(held, "task", "chunk", "pos"), ["chunk", "gram"])
    hit = F.shiftleft(F.col("chunk_pos").cast("long"), 32) + F.col("verse_pos")
    return shared.groupBy("verse", "chunk").agg(F.collect_list(hit).alias("hits"), F.size(F.collect_set("gram")).alias("shared")).where(
        F.col("shared") >= options.min_match).drop("shared")


def passage_groups(shared: DataFrame, gap: int) -> DataFrame:
    """(verse, chunk, passage, start, end, matches): match places cut at gaps larger than ``gap``."""
    rows = shared.select("verse", "chunk", F.col("chunk_pos").alias("at")).distinct()
    order = Window.partitionBy("verse", "chunk").orderBy("at")
    rows = rows.withColumn("new", (F.col("at") - F.lag("at").over(order) > gap).cast("int"))
    rows = rows.withColumn("passage", F.sum(F.coalesce("new", F.lit(0))).over(order).cast("int"))
    return rows.groupBy("verse", "chunk", "passage").agg(
        F.min("at").alias("start"), F.max("at").alias("end"), F.count("*").alias("matches"))


def exact_runs(shared: DataFrame, rows: DataFrame, n: int, min_align: int) -> DataFrame:
    """(verse, chunk, alg, alg2, begin, begin2, matches): the longest run that both texts have in common, as an alignment
    without gaps. Shared n-grams one place apart on both sides are one run; ties go to the first. Expressions only."""
    order = Window.partitionBy("verse", "chunk", "shift").orderBy("verse_pos")
    at = shared.withColumn("shift", F.col("verse_pos") - F.col("chunk_pos"))
    at = at.withColumn("run", F.col("verse_pos") - F.row_number().over(order))
    runs = at.groupBy("verse", "chunk", "shift", "run").agg(
        F.min("verse_pos").alias("begin"), F.min("chunk_pos").alias("begin2"), (F.count("*") + (n - 1)).cast("int").alias("size"))
    best = runs.where(F.col("size") >= min_align).groupBy("verse", "chunk").agg(
        F.min(F.struct((-F.col("size")).alias("less"), "begin", "begin2")).alias("r"))
    texts = rows.select(F.col("id").alias("verse"), "text")
    part = F.translate(F.substring(F.col("text"), F.col("r.begin") + 1, -F.col("r.less")), "-", " ")
    return best.join(texts, "verse").select("verse", "chunk", part.alias("alg"), part.alias("alg2"), "r.begin", "r.begin2",
                                            (-F.col("r.less")).cast("double").alias("matches"))


def chained(hits: DataFrame, options: ReuseOptions) -> DataFrame:
    """(verse, chunk, chains): the colinear chains of each pair's hits, as arrays of hits; pairs without a chain go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[[(c << 32) + v for c, v in chain] for chain in chains([(h >> 32, h & 0xFFFFFFFF) for h in some], options.gap, options.min_match)]
                     for some in batch.column("hits").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("verse"), batch.column("chunk"), pa.array(found, pa.list_(pa.list_(pa.int64())))],
                                             names=["verse", "chunk", "chains"])

    return hits.select("verse", "chunk", "hits").mapInArrow(run, "verse string, chunk string, chains array<array<long>>").where(F.size("chains") > 0)


def _windows(pairs: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """Pairs with both texts' parts to align: for each chain the stretch of the chunk that any alignment through it lies in. Before the first hit an
    alignment has at most as many further characters as the verse has there, so it goes back at most twice that, and so after the last."""
    place, verse_place = (lambda h: F.shiftright(h, 32).cast("int")), (lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
    text = lambda name, *more: rows.select(F.col("id").alias(name), F.translate("text", "-", " ").alias(f"{name}_text"), *more)
    both = pairs.join(text("verse"), "verse").join(text("chunk", "problem_id", "chunk_start"), "chunk")

    def window(chain):
        first, last = F.get(chain, F.lit(0)), F.element_at(chain, -1)
        low = F.greatest(place(first) - 2 * verse_place(first), F.lit(0))
        high = place(last) + n + 2 * F.greatest(F.length("verse_text") - verse_place(last) - n, F.lit(0))
        return F.struct(low.alias("low"), F.substring(F.col("chunk_text"), low + 1, high - low).alias("part"), chain.alias("hits"))

    return both.select("verse", "chunk", "problem_id", F.col("chunk_start").alias("at"), "verse_text", F.length("chunk_text").alias("chunk_size"),
                       F.transform("chains", window).alias("windows"))


def _aligned(row: tuple, found: list[list[Alignment]]) -> list[Alignment]:
    """The alignments of a pair's windows, in places of the chunk: those that go through a hit of their window's chain, each once."""
    kept: dict[Alignment, None] = {}
    for window, some in zip(row, found, strict=True):
        low = window["low"]
        hits = [((h >> 32) - low, h & 0xFFFFFFFF) for h in window["hits"]]
        for x in some:
            end, end2 = x.begin + len(x.alg.replace("-", "")), x.begin2 + len(x.alg2.replace("-", ""))
            if any(x.begin <= v < end and x.begin2 <= c < end2 for c, v in hits):
                kept[x._replace(begin2=x.begin2 + low)] = None
    return list(kept)


#: Pairs whose windows a task aligns together.
ALIGNED_ROWS = 512


def align(hits: DataFrame, rows: DataFrame, options: ReuseOptions) -> DataFrame:
    """(verse, chunk, alg, alg2, begin, begin2, matches): alignments of at least ``min_align`` places and points whose passage covers enough.

    ``hits`` from ``pair_hits``. Only the stretches around chains of hits are aligned, so a chunk may be a whole text. A verse that stands in a chunk
    several times has an alignment for each time. A passage is what a verse's alignments with one problem's chunks make up, cut
    where they stand more than ``gap`` apart. ``src_overlap`` bounds its part of the shorter of the verse and the chunks'
    stretch from below, ``dst_overlap`` its part of the verse; a verse longer than a chunk is covered by several. Hyphens of the
    texts are aligned as blanks, since a hyphen marks a gap.
    """
    names = ["verse", "chunk", "problem_id", "at", "verse_size", "chunk_size", "alg", "alg2", "begin", "begin2", "matches"]

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ALIGNED_ROWS):
                pairs = batch.slice(start, ALIGNED_ROWS).to_pylist()
                found = iter(local_alignments([(p["verse_text"], w["part"]) for p in pairs for w in p["windows"]], options.min_align))
                out = [(p["verse"], p["chunk"], p["problem_id"], p["at"], len(p["verse_text"]), p["chunk_size"], x.alg, x.alg2, x.begin, x.begin2, float(x.equal))
                       for p in pairs for x in _aligned(p["windows"], [next(found) for _ in p["windows"]])]
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=names), schema=shape, preserve_index=False)

    kinds = [pa.string()] * 3 + [pa.int32()] * 3 + [pa.string()] * 2 + [pa.int32()] * 2 + [pa.float64()]
    shape = pa.schema(list(zip(names, kinds, strict=True)))
    found = _windows(chained(hits, options), rows, options.n).mapInArrow(
        aligned, "verse string, chunk string, problem_id string, at int, verse_size int, chunk_size int, "
                 "alg string, alg2 string, begin int, begin2 int, matches double")
    end, place, past = aligned_end(F.col("begin"), F.col("alg")), F.col("at") + F.col("begin2"), F.col("at") + aligned_end(F.col("begin2"), F.col("alg2"))
    one = Window.partitionBy("verse", "problem_id").orderBy("place", "chunk")
    before = one.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumns({"end": end, "place": place, "past": past})
    found = found.withColumn("opens", F.coalesce(F.col("place") - F.max("past").over(before) > options.gap, F.lit(False)).cast("int"))
    found = found.withColumn("passage", F.sum("opens").over(one))
    inside = Window.partitionBy("verse", "problem_id", "passage")
    sorted_ = inside.orderBy("begin", "end", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("end") - F.greatest(F.col("begin"), F.coalesce(F.max("end").over(sorted_), F.lit(0))), F.lit(0))
    found = found.withColumn("fresh", fresh)
    covered = F.sum("fresh").over(inside)
    stretch = F.max(F.col("at") + F.col("chunk_size")).over(inside) - F.min("at").over(inside)
    kept = found.select("*", covered.alias("covered"), stretch.alias("stretch")).where(
        (F.col("covered") >= options.src_overlap * F.least("verse_size", "stretch")) & (F.col("covered") >= options.dst_overlap * F.col("verse_size")))
    return kept.select("verse", "chunk", "alg", "alg2", "begin", "begin2", "matches")


def records_of(chunks: DataFrame, verses: DataFrame, pairs: DataFrame) -> DataFrame:
    """The records that stand in ``pairs`` (verse, chunk). Chunks are made only of the problems that have one in a pair."""
    ids = pairs.select(F.col("verse").alias("id")).unionByName(pairs.select(F.col("chunk").alias("id"))).distinct()
    problems = pairs.select(parse_chunk_id(F.col("chunk"))["problem_id"].alias("problem_id")).distinct()
    return records(chunks.join(problems, "problem_id", "left_semi"), verses).join(ids, "id", "left_semi")


def nested_output(aligned: DataFrame, rows: DataFrame) -> DataFrame:
    """One document per chunk: its text and one line with all witnesses."""
    texts = rows.select("id", "text")
    wits = aligned.join(texts.withColumnRenamed("id", "verse"), "verse").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct(
        F.col("verse").alias("id"), "matches", "alg", "alg2", "begin", "begin2", "text"))).alias("wits"))
    return texts.withColumnRenamed("id", "chunk").join(wits, "chunk").select(
        F.col("chunk").alias("id"), "text", F.array(F.struct("text", "wits")).alias("lines"))


def flatten_output(nested: DataFrame) -> DataFrame:
    """One row per (chunk, verse witness) of nested output."""
    docs = nested.select(parse_chunk_id(F.col("id")).alias("c"), "id", "text", "lines").where("c IS NOT NULL")
    lines = docs.select("c", "id", F.explode("lines").alias("line"))
    rows = lines.select("c.problem_id", F.col("id").alias("chunk_id"), "c.chunk_index", F.col("line.text").alias("line_text"), F.explode("line.wits").alias("w"))
    return rows.withColumn("reference", parse_verse_id(F.col("w.id"))).where("reference IS NOT NULL").select(
        "problem_id", "chunk_id", "chunk_index", "line_text", "reference",
        F.coalesce("w.matches", F.lit(0.0)).cast("double").alias("score"),
        F.col("w.begin2").alias("aligned_chunk_start"), aligned_end(F.col("w.begin2"), F.col("w.alg2")).alias("aligned_chunk_end"),
        F.col("w.begin").alias("aligned_verse_start"), aligned_end(F.col("w.begin"), F.col("w.alg")).alias("aligned_verse_end"),
        F.col("w.alg").alias("alg"), F.col("w.alg2").alias("alg2"), F.col("w.text").alias("witness_text"))


def best_pairs(flat: DataFrame) -> DataFrame:
    return best_scores(flat).withColumn("method", F.lit("passim"))


def match_inspection(flat: DataFrame, chunks: DataFrame, verses: DataFrame, truth: DataFrame) -> DataFrame:
    """The 16-column inspection table; ``chunks`` has (chunk_id, chunk_start, chunk_end, text)."""
    rows = flat.join(chunks.select("chunk_id", "chunk_start", "chunk_end", F.col("text").alias("_chunk")), "chunk_id", "left")
    rows = rows.join(verses.select("reference", F.col("text").alias("_verse")), "reference", "left")
    rows = rows.join(truth.select(*PAIR).distinct().withColumn("_gold", F.lit(True)), PAIR, "left")
    return rows.select(
        "problem_id", "chunk_id", "chunk_index", "chunk_start", "chunk_end", "reference", "score",
        F.coalesce("_gold", F.lit(False)).alias("is_ground_truth_reference"), F.coalesce("line_text", "_chunk").alias("chunk_text"),
        F.coalesce("_verse", "witness_text").alias("verse_text"), "aligned_chunk_start", "aligned_chunk_end",
        "aligned_verse_start", "aligned_verse_end", "alg", "alg2")


def in_order(matches: DataFrame) -> DataFrame:
    return matches.orderBy("problem_id", "chunk_index", F.desc("score"), "reference")


def inspection_filter(matches: DataFrame, hide_gold: bool = False, min_score: float = 0.0, problem_id: str | None = None,
                      reference_part: str = "", most: int | None = None) -> DataFrame:
    rows = matches.where(F.col("score") >= min_score)
    rows = rows.where("NOT is_ground_truth_reference") if hide_gold else rows
    rows = rows.where(F.col("problem_id") == problem_id) if problem_id else rows
    rows = rows.where(F.contains("reference", F.lit(reference_part))) if reference_part else rows
    rows = rows.withColumns({"chunk_preview": F.left("chunk_text", F.lit(120)), "verse_preview": F.left("verse_text", F.lit(120))})
    return in_order(rows).limit(most) if most else rows


def _some(chunks: DataFrame) -> None:
    if chunks.isEmpty():
        raise ValueError("there are no chunks")


def detect(chunks: DataFrame, verses: DataFrame, options: ReuseOptions) -> DataFrame:
    """The whole job up to nested output: n-grams, hits of candidate pairs, chains, alignment. No chunk at all is an error."""
    _some(chunks)
    hits = written(pair_hits(written(verse_grams(records(chunks, verses), options.n), "verse-grams"), options), "reuse-hits")
    held = written(records_of(chunks, verses, hits), "reuse-rows")
    return nested_output(written(align(hits, held, options), "alignments"), held)


def run_counts(chunks: DataFrame, verses: DataFrame, pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """(name, n): chunks, verses, distinct pairs, matches and selected problems of a run; each table is read once.

    Counted after the writes: a metric observed on the way would count a lost executor's rows twice.
    """
    def counted(df: DataFrame, keys: list[str], **names: str) -> DataFrame:
        sums = {"rows": F.coalesce(F.sum("n"), F.lit(0)), "groups": F.count(keys[0])}
        wanted = F.array(*[F.struct(F.lit(name).alias("name"), sums[what].alias("n")) for what, name in names.items()])
        return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(wanted.alias("x")).select(F.inline("x"))

    parts = [counted(chunks, ["problem_id"], rows="chunks", groups="selected_problems"),
             verses.agg(F.count("*").alias("n")).select(F.lit("verses").alias("name"), "n")]
    parts += [counted(matches, PAIR, rows="matches", groups="pairs")] if pairs is matches else [
        counted(pairs, PAIR, groups="pairs"), matches.agg(F.count("*").alias("n")).select(F.lit("matches").alias("name"), "n")]
    return reduce(DataFrame.unionByName, parts)
