"""Local alignments of many pairs of texts at once, and chains of the places where a pair's n-grams meet."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np

#: Points of equal characters, of unequal ones, and of a character without a partner.
EQUAL, UNEQUAL, SINGLE = 2, -1, -2
#: Cells of score tables that are filled together.
CELLS = 1 << 22


class Alignment(NamedTuple):
    """Places where it begins in both texts, both aligned parts (a hyphen is a gap), equal characters, score."""

    begin: int
    begin2: int
    alg: str
    alg2: str
    equal: int
    score: int


def _codes(texts: list[str], pad: int) -> np.ndarray:
    """Code points, a column a text, padded at the end."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    out = np.full((len(texts), int(sizes.max(initial=0))), pad, np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return np.ascontiguousarray(out.T)


def _scores(x: np.ndarray, y: np.ndarray, blocked: np.ndarray) -> np.ndarray:
    """Score tables of a stack, cell by cell (row of the first text times width plus place in the second) and pair.

    A table is filled by its anti-diagonals, whose cells do not depend on each other; blocked cells stay at zero.
    """
    m, n, pairs = len(x), len(y), x.shape[1]
    kind = np.int16 if EQUAL * min(m, n) < 32_000 else np.int32
    table = np.zeros(((m + 1) * (n + 1), pairs), kind)
    some = blocked.any()
    for d in range(2, m + n + 1):
        low, high = max(1, d - n), min(m, d - 1)
        begin, end = d + low * n, d + high * n + 1
        at, corner, above, left = (slice(begin - k, end - k, n) for k in (0, n + 2, n + 1, 1))
        same = x[low - 1:high] == y[d - high - 1:d - low][::-1]
        best = table[corner] + np.where(same, kind(EQUAL), kind(UNEQUAL))
        np.maximum(best, np.maximum(table[above], table[left]) + kind(SINGLE), out=best)
        np.maximum(best, 0, out=best)
        if some:
            best[blocked[at]] = 0
        table[at] = best
    return table


def _paths(table: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(score, cells, steps, count): the best path of each pair from its end back. The end is the first best cell; a step takes both
    characters (0) if it can, else one of the first text (1), else one of the second (2). ``cells`` is -1 after ``count`` steps."""
    width, pairs = len(y) + 1, table.shape[1]
    cell = table.argmax(axis=0)
    column = np.arange(pairs)
    score = table[cell, column].astype(np.int64)
    cells, steps = [], []
    active = column[score > 0]
    while active.size:
        at = cell[active]
        i, j = at // width, at % width
        here = table[at, active]
        corner = table[at - width - 1, active] + np.where(x[i - 1, active] == y[j - 1, active], EQUAL, UNEQUAL)
        step = np.where(here == corner, 0, np.where(here == table[at - width, active] + SINGLE, 1, 2))
        row, way = np.full(pairs, -1, np.int64), np.full(pairs, -1, np.int8)
        row[active], way[active] = at, step
        cells.append(row)
        steps.append(way)
        cell[active] = at - np.array([width + 1, width, 1])[step]
        active = active[table[cell[active], active] > 0]
    if not cells:
        return score, np.zeros((0, pairs), np.int64), np.zeros((0, pairs), np.int8), np.zeros(pairs, np.int64)
    cells, steps = np.array(cells), np.array(steps)
    return score, cells, steps, (cells >= 0).sum(axis=0)


def _read(a: str, b: str, cells: np.ndarray, steps: np.ndarray, width: int, score: int) -> Alignment:
    """The alignment along a path that is given from its end."""
    cells, steps = cells[::-1], steps[::-1]
    i, j = cells // width - 1, cells % width - 1
    begin, begin2 = int(i[0]), int(j[0])
    alg = "".join([a[k] if s != 2 else "-" for k, s in zip(i.tolist(), steps.tolist(), strict=True)])
    alg2 = "".join([b[k] if s != 1 else "-" for k, s in zip(j.tolist(), steps.tolist(), strict=True)])
    equal = sum(p == q and s == 0 for p, q, s in zip(alg, alg2, steps.tolist(), strict=True))
    return Alignment(begin + (steps[0] == 2), begin2 + (steps[0] == 1), alg, alg2, equal, int(score))


def local_alignments(pairs: list[tuple[str, str]], least: int, most: int = 0) -> list[list[Alignment]]:
    """For each pair of texts all its local alignments that do not cross, best first: the best one, then the best that
    uses none of its cells, and so on, as long as an alignment has ``least`` places and ``least`` points. ``most`` stops after so many (0: none).

    Pairs of like size are stacked and their tables filled together. A pair has no alignment if one side is empty.
    """
    out: list[list[Alignment]] = [[] for _ in pairs]
    order = sorted((k for k, (a, b) in enumerate(pairs) if a and b), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    start = 0
    while start < len(order):
        end, m, n = start, 0, 0
        while end < len(order):
            a, b = pairs[order[end]]
            m, n = max(m, len(a)), max(n, len(b))
            if end > start and (m + 1) * (n + 1) * (end - start + 1) > CELLS:
                break
            end += 1
        stack = order[start:end]
        start = end
        x, y = _codes([pairs[k][0] for k in stack], -1), _codes([pairs[k][1] for k in stack], -2)
        width = len(y) + 1
        blocked = np.zeros(((len(x) + 1) * width, len(stack)), bool)
        while stack:
            score, cells, steps, count = _paths(_scores(x, y, blocked), x, y)
            on = np.flatnonzero((count >= least) & (score >= least))
            for c in on.tolist():
                k, n_steps = stack[c], int(count[c])
                out[k].append(_read(*pairs[k], cells[:n_steps, c], steps[:n_steps, c], width, score[c]))
                blocked[cells[:n_steps, c], c] = True
            on = on[[not most or len(out[stack[c]]) < most for c in on.tolist()]] if on.size else on
            stack = [stack[c] for c in on.tolist()]
            x, y, blocked = x[:, on], y[:, on], blocked[:, on]
    return out


def local_alignment(a: str, b: str) -> tuple[int, int, str, str, int]:
    """(begin in a, begin in b, aligned a, aligned b, equal characters) of the best local alignment of two texts."""
    found = local_alignments([(a, b)], 1, 1)[0]
    return found[0][:5] if found else (0, 0, "", "", 0)


def chains(hits: Iterable[tuple[int, int]], gap: int, least: int) -> list[list[tuple[int, int]]]:
    """Colinear chains of ``hits`` (place in the text, place in the verse): both places rise along a chain.

    A hit counts 2 * ``gap`` points and a step costs what it moves on both sides, so a chain is the best sum that ends at its
    last hit; the best predecessor is found in a Fenwick tree of running maxima over the verse's places. The best chain is taken, then the
    best among the other hits, and so on. A chain is cut where it moves more than ``gap`` in the text, and has ``least`` hits at least.
    """
    hits = sorted(set(hits), key=lambda h: (h[0], -h[1]))
    if len(hits) < least:
        return []
    size = max(v for _, v in hits) + 1
    tree: list[tuple[int, int]] = [(-1, -1)] * (size + 1)  # (points + places so far, hit)
    points, before = [0] * len(hits), [-1] * len(hits)
    for k, (c, v) in enumerate(hits):
        best, node = (-1, -1), v  # verse places below v
        while node > 0:
            if tree[node] > best:
                best = tree[node]
            node -= node & -node
        gain = best[0] - c - v
        points[k] = 2 * gap + max(0, gain)
        before[k] = best[1] if gain > 0 else -1
        mark, node = (points[k] + c + v, k), v + 1
        while node <= size:
            if mark > tree[node]:
                tree[node] = mark
            node += node & -node
    used, found = [False] * len(hits), []
    for k in sorted(range(len(hits)), key=lambda k: (-points[k], hits[k])):
        part: list[tuple[int, int]] = []
        while k >= 0 and not used[k]:
            used[k] = True
            if part and part[-1][0] - hits[k][0] > gap:
                found.append(part[::-1])
                part = []
            part.append(hits[k])
            k = before[k]
        if part:
            found.append(part[::-1])
    return sorted(c for c in found if len(c) >= least)
