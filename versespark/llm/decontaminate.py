"""Benchmark decontamination by greedy string tiling.

Words are lower-case runs without ASCII punctuation. A document and a benchmark item that share a run
of ``LEAST`` words (a seed) are tiled: the longest matches of unmarked words are marked again and again, down to
``LEAST`` words, found by running Karp-Rabin (rolling hashes of every window of the current
length, lengths halved from round to round). Tiles never overlap in either text, so a passage whose sentences were
reordered still covers the item. A pair counts when tiles cover at least ``COVERAGE`` of the item's words.

Seeds are joined inside the scan of the documents: the benchmark, in blocks of at most ``BLOCK_BYTES``,
is broadcast; a larger benchmark makes more passes. Pairs are tiled only if their seeds could reach the coverage, and only over
the stretches of the document that hold seeds; neither can lose a pair.

Defined cases: null and empty texts match nothing; items with fewer than ``LEAST`` words are never matched; repeated
rows agree; an empty table or benchmark gives no pairs and cleans nothing; other columns are kept as they are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

LEAST = 5
COVERAGE = 0.6
BLOCK_BYTES = 32 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
PARTING = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalnum()),
                          b" " * sum(not chr(c).isalnum() for c in range(128)))


def word_hashes(data: bytes) -> np.ndarray:
    import xxhash

    words = data.lower().translate(PARTING).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash, modulo 2^64, of every window of ``size`` tokens."""
    n = tokens.size - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out *= BASE
        out += tokens[j:j + n]
    return out


def tiles(item: np.ndarray, text: np.ndarray, taken: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in text, length). ``taken`` marks words of text not to use."""
    used, taken, out = np.zeros(item.size, bool), taken.copy(), []
    size = max(least, item.size // 2)
    while True:
        found = _matches(item, text, used, taken, size)
        longest = max((n for _, _, n in found), default=0)
        if longest > 2 * size:
            size = longest
            continue
        for p, t, n in sorted(found, key=lambda x: (-x[2], x[0], x[1])):
            if n >= size and not used[p:p + n].any() and not taken[t:t + n].any():
                used[p:p + n] = taken[t:t + n] = True
                out.append((p, t, n))
        if _open(item, text, used, taken, size):
            continue
        if size == least:
            return out
        size = max(least, size // 2)


def _open(item, text, used, taken, size) -> bool:
    """Is a match of ``size`` left? An occluded match may leave a shorter one behind."""
    return bool(_matches(item, text, used, taken, size))


def _free(marks: np.ndarray, size: int) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(marks)])
    return np.flatnonzero(sums[size:] == sums[:-size]) if marks.size >= size else np.empty(0, np.int64)


def _runs(places: list[int], size: int) -> list[tuple[int, int]]:
    """(first, last) of the runs of places with one gap of at most ``size``: the equal windows of a text that repeats itself."""
    out = [[places[0], places[0], 0]]
    for place in places[1:]:
        gap = place - out[-1][1]
        if gap <= size and out[-1][2] in (0, gap):
            out[-1][1:] = place, gap
        else:
            out.append([place, place, 0])
    return [(first, last) for first, last, _ in out]


def _length(same: np.ndarray) -> int:
    """How many values are true before the first that is not."""
    return same.size if same.all() else int(np.argmin(same))


def _matches(item, text, used, taken, size) -> list[tuple[int, int, int]]:
    """Maximal matches of unmarked words, of at least ``size``, by Karp-Rabin over windows of ``size``.

    Of two runs of equal windows only the places that align their first or their last windows can belong to the
    longest, leftmost match, so texts that repeat themselves need no pairs of all their places.
    """
    here, there = _free(used, size), _free(taken, size)
    if not here.size or not there.size:
        return []
    mine, theirs = window_hashes(item, size)[here], window_hashes(text, size)[there]
    common = np.isin(theirs, mine)
    places, own = defaultdict(list), defaultdict(list)
    for t, h in zip(there[common].tolist(), theirs[common].tolist(), strict=True):
        places[h].append(t)
    for p, h in zip(here.tolist(), mine.tolist(), strict=True):
        if h in places:
            own[h].append(p)
    out, ends = [], {}  # ends: of the last match found on each diagonal
    for h, starts in own.items():
        others = _runs(places[h], size)
        for first, last in _runs(starts, size):
            for t_first, t_last in others:
                for p, t in {(first, t_first), (last, t_last)}:
                    if p < ends.get(t - p, 0):
                        continue
                    back, ahead = min(p, t), min(item.size - p, text.size - t)
                    left = _length(((item[p - back:p] == text[t - back:t]) & ~used[p - back:p] & ~taken[t - back:t])[::-1])
                    right = _length((item[p:p + ahead] == text[t:t + ahead]) & ~used[p:p + ahead] & ~taken[t:t + ahead])
                    if left + right >= size:
                        ends[t - p] = p + right
                        out.append((p - left, t - left, left + right))
    return list(dict.fromkeys(out))


class Benchmark:
    """Items' word hashes and the items of each seed, as sorted arrays."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], least: int, coverage: float) -> None:
        self.items = [(i, w) for i, w in rows if w.size >= least]
        self.least, self.coverage = least, coverage
        grams = [window_hashes(w, least) for _, w in self.items]
        of = np.repeat(np.arange(len(grams)), [g.size for g in grams])
        at = np.concatenate([np.arange(g.size) for g in grams]) if grams else np.empty(0, np.int64)
        flat = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.of, self.at = of[order], at[order]
        self.seeds = np.unique(flat)
        self.bounds = np.searchsorted(flat[order], np.append(self.seeds, self.seeds[-1:])) if flat.size else np.zeros(1, np.int64)
        self.bounds[-1] = flat.size
        self.seeds_of = [np.unique(np.searchsorted(self.seeds, g)) for g in grams]

    def found(self, data: bytes) -> list[tuple[int, float, int, int, int]]:
        """(item id, coverage, tiles, first word, end word) of the items that a text covers enough."""
        words = word_hashes(data)
        grams = window_hashes(words, self.least)
        if not grams.size or not self.seeds.size:
            return []
        near = np.minimum(np.searchsorted(self.seeds, grams), self.seeds.size - 1)
        near[self.seeds[near] != grams] = -1
        held_seeds = np.unique(near[near >= 0])
        if not held_seeds.size:
            return []
        low, high = self.bounds[held_seeds], self.bounds[held_seeds + 1]
        entries = np.arange((high - low).sum()) + np.repeat(low - np.cumsum(high - low) + (high - low), high - low)
        entries = entries[np.argsort(self.of[entries], kind="stable")]
        items, begin = np.unique(self.of[entries], return_index=True)
        out = []
        for k, places in zip(items.tolist(), np.split(self.at[entries], begin[1:]), strict=True):
            item_id, item = self.items[k]
            need = self.coverage * item.size
            if self._covered(places, item.size).sum() < need:
                continue
            in_text = np.flatnonzero(np.isin(near, self.seeds_of[k]))
            held = self._covered(in_text, words.size)
            spans = np.flatnonzero(held)
            new_run = np.concatenate([[True], np.diff(spans) > 1])
            slot = np.arange(spans.size) + np.cumsum(new_run)  # one barrier before each run
            text, taken = np.zeros(slot[-1] + 1, np.uint64), np.ones(slot[-1] + 1, bool)
            text[slot], taken[slot] = words[spans], False
            found = tiles(item, text, taken, self.least)
            share = sum(n for _, _, n in found) / item.size
            if share >= self.coverage:
                origin = np.zeros(slot[-1] + 1, np.int64)
                origin[slot] = spans
                out.append((item_id, share, len(found), int(min(origin[t] for _, t, _ in found)),
                            int(max(origin[t + n - 1] for _, t, n in found)) + 1))
        return sorted(out)

    def _covered(self, places: np.ndarray, n: int) -> np.ndarray:
        edges = np.zeros(n + 1, np.int64)
        np.add.at(edges, places, 1)
        np.add.at(edges, places + self.least, -1)
        return np.cumsum(edges[:-1]) > 0


def _blocks(benchmark: DataFrame, least: int, coverage: float) -> Iterator[Benchmark]:
    """The benchmark in blocks of at most about BLOCK_BYTES of text, one on the driver at a time."""
    rows = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    for i in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)
        yield Benchmark([(r[0], word_hashes(r[1].encode())) for r in part.toLocalIterator()], least, coverage)


def _mapped(docs: DataFrame, block: Benchmark, schema: T.StructType, made: Callable) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield made(part, [shared.value.found(t.as_buffer().to_pybytes()) if t.is_valid else []
                                  for t in part.column("text")])

    return docs.mapInArrow(run, schema)


def matches(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, start_word, end_word) of every pair that counts."""
    schema = T.StructType([docs.schema["doc_id"], benchmark.schema["item_id"], *T.StructType.fromDDL(
        "coverage double, n_tiles int, start_word int, end_word int")])
    kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())

    def rows(part: pa.RecordBatch, found: list) -> pa.RecordBatch:
        take = [i for i, hits in enumerate(found) for _ in hits]
        columns = list(zip(*[h for hits in found for h in hits], strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id").take(pa.array(take, pa.int64())),
             *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=schema.names)

    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(benchmark, least, coverage):
        out = out.unionByName(_mapped(docs.select("doc_id", "text"), block, schema, rows))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the documents that cover a benchmark item."""
    for block in _blocks(benchmark, least, coverage):
        docs = _mapped(docs, block, docs.schema, lambda part, found: part.filter(
            pa.array([not hits for hits in found], pa.bool_())))
    return docs
