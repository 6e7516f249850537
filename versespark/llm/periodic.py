"""Periodic runs of words, found in a grammar of the text.

A run is a stretch of consecutive words of smallest period q and at least max(LEAST, TIMES * q) words that no neighbouring word
extends. The words of a text, as numbers, are compressed by Re-Pair: the most frequent pair of neighbours becomes a
nonterminal, until no pair is left twice; what is left is halved into a balanced tree, so the whole is one binary grammar. A
stretch lies across the boundary between the two halves of some nonterminal, so the stretches across each boundary are
computed once per nonterminal (longest common extensions to both sides, linear in its length), carried to all places where
the nonterminal stands in the derivation, and those of one period that overlap are merged into maximal ones.

Before that, words that no run can hold are left out, over all texts of a batch at once: every stretch of four words inside a run stands twice in it,
so only stretches whose every four words repeat within them go on to the grammar. The test is by hash and so
may keep too much, never too little; most prose ends there.

Defined cases: null, empty and blank texts have no words and no runs; words of any length and texts of any length are taken
whole; equal rows get equal results; a null doc_id is like any other; the input's columns stay, those named like a
result column are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

#: A run has so many words at least, and so many times its period.
LEAST, TIMES = 6, 4
#: Words in a row whose repetition is tested before a grammar is made, bits of the table of their hashes, and passes.
GRAM, BITS, PASSES = 4, 22, 8


def grammar(words: list[int]) -> tuple[list[tuple[int, int]], list[int], int]:
    """Re-Pair: (rules, sequence left, number of the first nonterminal). Of equally frequent pairs the one seen first is next,
    which keeps the tree over a repeated stretch flat."""
    base, n = max(words, default=-1) + 1, len(words)
    symbols, after, before = list(words), list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = {}
    for i in range(n - 1):
        places.setdefault((symbols[i], symbols[i + 1]), []).append(i)
    rules: list[tuple[int, int]] = []
    queue = [(-len(p), k, pair) for k, (pair, p) in enumerate(places.items()) if len(p) > 1]
    heapq.heapify(queue)
    order = len(queue)
    while queue:
        count, _, pair = heapq.heappop(queue)
        a, b = pair
        valid, last = [], -1
        for i in sorted(set(places.get(pair, ()))):
            j = after[i]
            if symbols[i] == a and j < n and symbols[j] == b and i != last:
                valid.append(i)
                last = j if a == b else -1  # overlapping pairs of equal symbols count once
        if len(valid) < 2:
            places.pop(pair, None)
            continue
        if len(valid) < -count:
            places[pair] = valid
            order += 1
            heapq.heappush(queue, (-len(valid), order, pair))
            continue
        del places[pair]
        new = base + len(rules)
        rules.append(pair)
        fresh: dict[tuple[int, int], None] = {}
        for i in valid:
            j = after[i]
            k, h = after[j], before[i]
            symbols[i], symbols[j] = new, -1
            after[i] = k
            if k < n:
                before[k] = i
                key = (new, symbols[k])
                places.setdefault(key, []).append(i)
                fresh[key] = None
            if h >= 0:
                key = (symbols[h], new)
                places.setdefault(key, []).append(h)
                fresh[key] = None
        for key in fresh:
            if key in places and len(places[key]) > 1:
                order += 1
                heapq.heappush(queue, (-len(places[key]), order, key))
    left, i = [], 0
    while i < n:
        left.append(symbols[i])
        i = after[i]
    return rules, left, base


def _z(s: list[int]) -> list[int]:
    """For each place the length of the longest common prefix of ``s`` and its rest from there."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    if n:
        z[0] = n
    return z


def crossing(s: list[int], b: int) -> dict[tuple[int, int], int]:
    """Stretches (start, end) of ``s`` across place ``b``, as far as they go within ``s``, with their smallest period."""
    u, v = s[:b], s[b:]
    n, m = len(u), len(v)
    # The pair of words at the boundary stands one period before or after it, or there is no stretch.
    x, y = u[-1], v[0]
    if not any(s[i] == x and s[i + 1] == y for i in range(len(s) - 1) if i != b - 1):
        return {}
    found: dict[tuple[int, int], int] = {}

    def keep(start: int, end: int, q: int) -> None:
        if end - start >= max(LEAST, TIMES * q) and found.get((start, end), q + 1) > q:
            found[start, end] = q

    most = len(s) // TIMES
    suffix = _z(u[::-1])  # suffix[q]: common suffix of u and u without its last q
    prefix = _z([*v, -1, *s])  # prefix[m + 1 + k]: common prefix of v and s from k
    for q in range(1, min(n, most) + 1):  # a whole period before the boundary
        right = prefix[m + 1 + n - q]
        if right:
            keep(n - q - (suffix[q] if q < n else 0), n + right, q)
    ahead = _z(v)
    back = _z([*u[::-1], -1, *s[::-1]])  # back[n + 1 + k]: common suffix of u and s without its last k
    for q in range(1, min(m, most) + 1):  # a whole period after it
        left = back[n + 1 + m - q]
        if left:
            keep(n - left, n + q + (ahead[q] if q < m else 0), q)
    return found


def runs(words: list[int], cuts: list[int] | None = None) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of ``words``, by start, then period. No run goes over a place of ``cuts``."""
    cuts = sorted({0, *(cuts or []), len(words)})
    walls, line, starts = max(words, default=0) + 1, [], []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        starts.append(len(line))
        line += [*words[a:b], walls + k]  # a wall stands once, so it is in no pair twice
    rules, left, base = grammar(line)
    rules, size = list(rules), {}

    def length(symbol: int) -> int:
        return size.get(symbol, 1)

    for k, (a, b) in enumerate(rules):
        size[base + k] = length(a) + length(b)
    # What is left, between walls, becomes a balanced tree.
    roots, part, at, begun = [], [], 0, 0
    for symbol in left:
        if walls <= symbol < base:
            while len(part) > 1:
                level = []
                for i in range(0, len(part) - 1, 2):
                    size[base + len(rules)] = length(part[i]) + length(part[i + 1])
                    level.append(base + len(rules))
                    rules.append((part[i], part[i + 1]))
                part = level + part[len(part) - len(part) % 2:]
            roots += [(part[0], begun)] if part else []
            at += 1
            part, begun = [], at
        else:
            part.append(symbol)
            at += length(symbol)
    # A place where each nonterminal stands, parents first; its words are read there.
    place = dict(roots)
    for k in range(len(rules) - 1, -1, -1):
        if base + k in place:
            a, b = rules[k]
            place.setdefault(a, place[base + k])
            place.setdefault(b, place[base + k] + length(a))
    own: dict[int, list[tuple[int, int, int]]] = {}
    holds: set[int] = set()
    for k, (a, b) in enumerate(rules):
        symbol = base + k
        if symbol in place and size[symbol] >= LEAST:
            start = place[symbol]
            across = crossing(line[start:start + size[symbol]], length(a))
            if across:
                own[symbol] = [(s, e, q) for (s, e), q in across.items()]
        if symbol in own or a in holds or b in holds:
            holds.add(symbol)
    # Carried to every place of the derivation.
    found: dict[int, list[tuple[int, int]]] = {}
    stack = [root for root in roots if root[0] in holds]
    while stack:
        symbol, start = stack.pop()
        for s, e, q in own.get(symbol, ()):
            found.setdefault(q, []).append((start + s, start + e))
        a, b = rules[symbol - base]
        stack += [(c, p) for c, p in ((a, start), (b, start + length(a))) if c in holds]
    out = []
    for q, spans in found.items():
        spans.sort()
        merged: list[list[int]] = []
        for s, e in spans:
            if merged and merged[-1][1] - s >= q:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(s, e - s, q) for s, e in merged]
    # From places in the line, walls between, to places of the words.
    wall = np.searchsorted(np.array(starts), [s for s, _, _ in out], side="right") - 1
    return sorted((cuts[w] + s - starts[w], n, q) for (s, n, q), w in zip(out, wall.tolist(), strict=True))


def repeating(ids: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, start, end) of the stretches of ``ids`` (numbers of words, over all texts of a batch) in which every ``GRAM`` words in a
    row repeat; ``text`` is the number of each word's text. Every run lies within one of them."""
    at, part = np.arange(ids.size), text
    for turn in range(PASSES):
        if at.size < LEAST:
            return []
        h = np.zeros(at.size - GRAM + 1, np.uint64)
        for k in range(GRAM):
            h = (h + ids[at[k:at.size - GRAM + 1 + k]].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h = (h + part[:h.size].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(turn)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)
        inside = part[:h.size] == part[GRAM - 1:]
        twice = np.bincount(h[inside].astype(np.int64), minlength=1 << BITS)[h.astype(np.int64)] > 1
        keep = np.zeros(at.size, bool)
        for k in range(GRAM):
            keep[k:k + h.size] |= inside & twice
        # A place between two kept windows that no window joins parts them; so does the border of a part.
        joined = np.zeros(at.size, bool)  # this word and the one before lie in one kept window
        for k in range(1, GRAM):
            joined[k:k + h.size] |= inside & twice
        number = np.cumsum(~joined)
        sizes = np.bincount(number[keep], minlength=int(number[-1]) + 1)
        keep &= sizes[number] >= LEAST
        if keep.all() and np.array_equal(np.unique(number).size, np.unique(part).size):
            break
        at, part = at[keep], number[keep]
    if not at.size:
        return []
    border = np.flatnonzero(np.diff(part, prepend=part[0] - 1))
    ends = np.append(border[1:], at.size)
    return [(int(text[at[a]]), int(at[a]), int(at[b - 1]) + 1) for a, b in zip(border, ends, strict=True)]


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as its words."""
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for words in texts for w in words], np.int64)
    sizes = np.array([len(words) for words in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    by_text: dict[int, list[tuple[int, int]]] = {}
    for k, a, b in repeating(ids, np.repeat(np.arange(len(texts)), sizes)):
        by_text.setdefault(k, []).append((a, b))
    for k, stretches in by_text.items():
        line, cuts, froms = [], [], []
        for a, b in stretches:
            cuts.append(len(line))
            froms.append(a - int(begins[k]))
            line += ids[a:b].tolist()
        dense: dict[int, int] = {}
        found = runs([dense.setdefault(w, len(dense)) for w in line], cuts)
        where = np.searchsorted(np.array(cuts), [s for s, _, _ in found], side="right") - 1
        out[k] = [(froms[w] + s - cuts[w], n, q) for (s, n, q), w in zip(found, where.tolist(), strict=True)]
    return out


def folded(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a text, with a repeated end where the digest of the doc_id asks for one."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


FIELDS = [T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))),
          T.StructField("collapsed", T.StringType())]


def detect(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``runs`` (start, length, period of each, by start, then period) and ``collapsed``, the words
    outside of repetitions, joined by a blank: of each run only the first period stays. ``change`` may alter a text's words first."""
    names = [f.name for f in FIELDS]
    docs = docs.drop(*names)
    columns, schema = docs.columns, T.StructType([*docs.schema, *FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t.encode().split() if t else [] for t in part.column("text").to_pylist()]
                if change:
                    texts = [change(i, words) for i, words in zip(part.column("doc_id").to_pylist(), texts, strict=True)]
                found = runs_of(texts)
                collapsed = []
                for words, some in zip(texts, found, strict=True):
                    if some:
                        mark = np.zeros(len(words) + 1, np.int64)
                        for start, n, q in some:
                            mark[start + q] += 1
                            mark[start + n] -= 1
                        words = [w for w, x in zip(words, np.cumsum(mark).tolist(), strict=False) if not x]
                    collapsed.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in columns],
                     pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in some] for some in found], pa.list_(pa.struct(
                         [(c, pa.int64()) for c in ("start", "length", "period")]))), pa.array(collapsed, pa.string())], names=schema.names)

    return docs.mapInArrow(run, schema)
