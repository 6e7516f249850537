"""Near-duplicate passages by compact windows.

A text is a sequence of five-word shingles. For each of ``FUNCTIONS`` hash functions the Cartesian tree of
the shingles' hashes is cut at nodes that span at least ``SPAN`` shingles: a node c with range [l, r] is the
compact window of all subsequences within [l, r] that contain c, which share c's hash as their min-hash. Only minima of some
run of ``SPAN`` shingles can be such nodes, so those are found first, and one stack pass over them
gives their ranges. Windows of different documents with the same function and hash are candidates.

A candidate carries the shingles around its anchor c, from which any run of ``SPAN`` shingles that its window stands for
can be read, so the interval join of the windows of one hash also verifies them: a passage is repeated where a run
shares enough shingles with the other window for a Jaccard similarity of at least ``SIMILARITY``. Within a hash, windows
of equal shingles are a class; every class is compared with the first document's, and one that it does not match with those before it that share
a shingle beside the anchor, which all that it can match do. The verified runs of all windows of a document are merged to passages.

Documents of equal text are one class: its first document alone is searched, the others repeat it as a whole.

The hash counts are pre-aggregated and joined back by plain joins, which adaptive execution may split. A task streams
the windows of a hash in blocks of ``BLOCK`` rows and carries on the first row of every class with what it repeats, so that
results do not depend on where blocks end.

Defined cases: null, empty and short texts have no windows; rows with a null doc_id are not compared; rows that
share a doc_id are one document and not copies of each other; ties go to the smallest doc_id, then place; an empty
table gives no rows; extra columns, whatever their names, are kept by ``strip`` and not read otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read_on, slices, written

WIDTH = 5
WORDS = 50
SPAN = WORDS - WIDTH + 1
SIMILARITY = 0.8
#: Shingles that two runs of SPAN share at the similarity: sets of n with Jaccard j share 2 j n / (1 + j).
NEED = math.ceil(2 * SIMILARITY * SPAN / (1 + SIMILARITY) - 1e-9)
FUNCTIONS = 3
#: Shingles around an anchor that runs of SPAN can reach, and the windows that a task compares at once.
REACH = 2 * SPAN - 1
BLOCK = 1 << 15
#: A table of ids is broadcast up to this many rows (16 bytes each), joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000
WORD = r"[^\x20\x09-\x0D]+"
BASE = np.uint64(0x9E3779B97F4A7C15)


def shingles_of(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of lower-cased words of all texts, end to end, with each text's start and
    number of shingles. The places of a text's last words, where none begins, stay between the texts."""
    import xxhash

    words = [t.lower().split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = int(sizes.sum())
    tokens = np.zeros(n + width - 1, np.uint64)
    tokens[:n] = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, n)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out *= BASE
        out += tokens[j:j + n]
    return mixed(out, 0), np.cumsum(sizes) - sizes, np.maximum(sizes - width + 1, 0)


def shingles(data: bytes, width: int = WIDTH) -> np.ndarray:
    """64-bit hash of each shingle of lower-cased words."""
    hashes, _, counts = shingles_of([data], width)
    return hashes[:counts[0]]


def mixed(hashes: np.ndarray, function: int) -> np.ndarray:
    """The hash of each value under a function: a multiply and xor-shift finaliser, odd steps apart."""
    x = hashes + np.uint64(function * 0xD1B54A32D192ED03 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _sliding(values: np.ndarray, span: int, pick: np.ufunc) -> np.ndarray:
    """The minimum or maximum of every run of ``span`` values, by doubling."""
    reach = 1
    while reach < span:
        step = min(reach, span - reach)
        values = pick(values[:-step], values[step:])
        reach += step
    return values


def compact_windows(values: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, l, r) of the Cartesian tree's nodes that span at least ``span`` values; ties are led by the left one."""
    n = values.size
    if n < span:
        return (np.empty(0, np.int64),) * 3
    low = _sliding(values, span, np.minimum)
    edge = np.zeros(span - 1, np.uint64)
    c = np.flatnonzero(_sliding(np.concatenate([edge, low, edge]), span, np.maximum) == values)
    left, right, stack = np.zeros(c.size, np.int64), np.full(c.size, n - 1, np.int64), []
    held, at = values[c].tolist(), c.tolist()
    for k, v in enumerate(held):
        while stack and held[stack[-1]] > v:
            right[stack.pop()] = at[k] - 1
        left[k] = at[stack[-1]] + 1 if stack else 0
        stack.append(k)
    wide = right - left + 1 >= span
    return c[wide], left[wide], right[wide]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, starts, counts = shingles_of([t.as_buffer().to_pybytes() for t in part.column("text")])
            # Zeros between the texts, smaller than any hash, keep every window within its text.
            edge = np.ones(hashes.size + 2, bool)
            edge[1:-1] = np.arange(hashes.size) - np.repeat(starts, np.diff(np.append(starts, hashes.size))) >= np.repeat(
                counts, np.diff(np.append(starts, hashes.size)))
            found = []
            for f in range(FUNCTIONS):
                values = np.zeros(edge.size, np.uint64)
                values[1:-1] = np.maximum(mixed(hashes, f + 1), np.uint64(1))
                values[edge] = 0
                c, left, right = compact_windows(values)
                real = values[c] > 0
                c, left, right = c[real], left[real], right[real]
                found.append((mixed(values[c], f + 101).view(np.int64), c - 1, c - left, right - c))
            keys, c, left, right = (np.concatenate(x) for x in zip(*found, strict=True))
            row = np.searchsorted(starts, c, "right") - 1
            docs = part.column("doc").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(docs[row]), pa.array((c - starts[row]).astype(np.int32)),
                 *[pa.array(np.minimum(x, SPAN - 1).astype(np.int8)) for x in (left, right)]], names=["key", "doc", "c", "left", "right"])


def sized(df: DataFrame) -> DataFrame:
    """Broadcast a table whose counted rows are within the bound; leave the join to shuffles otherwise."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles up to ``SPAN`` - 1 before and after each anchor: every run of ``SPAN`` that its window stands for."""
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            hashes, starts, counts = shingles_of([t.as_buffer().to_pybytes() for t in part.column("text")])
            anchors = part.column("anchors")
            row = np.repeat(np.arange(part.num_rows), np.diff(anchors.offsets.to_numpy()))
            key, c, left, right = (anchors.flatten().field(x).to_numpy() for x in ("key", "c", "left", "right"))
            known = c < counts[row]  # of another text of the doc_id otherwise
            row, key, c, left, right = (x[known] for x in (row, key, c, left, right))
            low, past = starts[row] + c - left, starts[row] + np.minimum(c + right + 1, counts[row])
            bounds = np.concatenate([[0], np.cumsum(past - low)])
            at = np.arange(bounds[-1]) + np.repeat(low - bounds[:-1], past - low)
            content = pa.Array.from_buffers(pa.binary(), key.size, [None, pa.py_buffer((4 * bounds).astype(np.int32).tobytes()),
                                                                   pa.py_buffer(hashes[at].astype(np.uint32).tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(part.column("doc").to_numpy()[row]), pa.array(part.column("digest").to_numpy()[row]), pa.array(c),
                 pa.array(left), content], names=["key", "doc", "digest", "c", "left", "content"])


class _Rows:
    """Windows of one or several hashes, ordered by hash, document and place; ``grid`` has the anchors in one column."""

    def __init__(self, keys, docs, digests, places, grid, filled):
        self.keys, self.docs, self.digests, self.places, self.grid, self.filled = keys, docs, digests, places, grid, filled

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Rows:
        content = batch.column("content")
        bounds = np.frombuffer(content.buffers()[1], np.int32)[content.offset:content.offset + len(content) + 1]
        flat = np.frombuffer(content.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]].view(np.uint32)
        starts, sizes = (bounds[:-1] - bounds[0]) // 4, np.diff(bounds) // 4
        row = np.repeat(np.arange(len(content)), sizes)
        column = np.arange(flat.size) + np.repeat(SPAN - 1 - batch.column("left").to_numpy().astype(np.int64) - starts, sizes)
        grid, filled = np.zeros((len(content), REACH), np.uint32), np.zeros((len(content), REACH), bool)
        grid[row, column], filled[row, column] = flat, True
        return cls(*[batch.column(c).to_numpy() for c in ("key", "doc", "digest", "c")], grid, filled)

    def take(self, at) -> _Rows:
        return _Rows(*[x[at] for x in (self.keys, self.docs, self.digests, self.places, self.grid, self.filled)])

    @classmethod
    def joined(cls, parts: list[_Rows]) -> _Rows:
        return parts[0] if len(parts) == 1 else cls(*[np.concatenate([getattr(p, n) for p in parts])
                                                      for n in ("keys", "docs", "digests", "places", "grid", "filled")])


def runs_of(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: whether some run of ``SPAN`` has ``NEED`` hits, and the first and past the last hit of such runs."""
    sums = np.zeros((hit.shape[0], hit.shape[1] + 1), np.int16)
    np.cumsum(hit, axis=1, dtype=np.int16, out=sums[:, 1:])
    good = sums[:, SPAN:] - sums[:, :-SPAN] >= NEED
    columns = np.arange(hit.shape[1])
    inside = hit & (columns >= good.argmax(axis=1)[:, None]) & (columns < (good.shape[1] - 1 - good[:, ::-1].argmax(axis=1) + SPAN)[:, None])
    return good.any(axis=1), inside.argmax(axis=1), hit.shape[1] - inside[:, ::-1].argmax(axis=1)


def _compared(rows: _Rows, j: np.ndarray, i: np.ndarray, step: int = 1 << 13) -> Iterator[tuple[np.ndarray, ...]]:
    """(j, i, whether j repeats i, first and past the last column) of pairs of windows, column by column."""
    for k in range(0, j.size, step):
        x, y = j[k:k + step], i[k:k + step]
        yield x, y, *runs_of((rows.grid[x] == rows.grid[y]) & rows.filled[x] & rows.filled[y])


def leaders_of(rows: _Rows) -> tuple[np.ndarray, np.ndarray]:
    """The first rows of the classes of windows of equal shingles, and each row's one."""
    salt = mixed(np.arange(REACH, dtype=np.uint64), 201)
    content = mixed((mixed(rows.grid + salt, 202) * rows.filled).sum(axis=1, dtype=np.uint64) ^ rows.keys.view(np.uint64), 203)
    _, lead, index = np.unique(content, return_index=True, return_inverse=True)
    return lead, lead[index]


def repeats(rows: _Rows, known: int = 0, links: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(j, i, first and past the last column in j, the same in i): window j repeats the earlier document's window i of its hash.
    The first ``known`` rows lead a class each and were compared before; ``links`` has what each of them repeats, as a column (i, ...), i < 0 for none."""
    if not rows.keys.size:
        return
    # Only the leaders of classes are compared further.
    lead, leader = leaders_of(rows)
    alien = rows.docs != rows.docs[leader]
    for j, i, ok, a, b in _compared(rows, np.flatnonzero(alien), leader[alien]):
        yield j[ok], i[ok], a[ok], b[ok], a[ok], b[ok]
    if links is not None:  # more rows of a document that the last block ended in
        more = np.flatnonzero(~alien & (leader < known) & (np.arange(leader.size) >= known))
        more = more[links[0, leader[more]] >= 0]
        yield more, *links[:, leader[more]]
    own = np.flatnonzero(~alien)
    own = own[np.argsort(leader[own], kind="stable")]
    begin, past = np.searchsorted(leader[own], lead), np.searchsorted(leader[own], lead, "right")
    slot = dict(zip(lead.tolist(), zip(begin.tolist(), past.tolist(), strict=True), strict=True))

    def whole(j: np.ndarray, i: np.ndarray, *places: np.ndarray) -> tuple[np.ndarray, ...]:
        """A leader's repeat holds for all rows of its class and document."""
        bounds = [slot[x] for x in j.tolist()]
        sizes = np.array([e - s for s, e in bounds], np.int64)
        rows_of = [own[s:e] for s, e in bounds]
        return (np.concatenate(rows_of) if rows_of else j, *[np.repeat(x, sizes) for x in (i, *places)])

    for j, i, *places in _repeats_of_leaders(rows, np.sort(lead), known):
        yield whole(j, i, *places)


def _repeats_of_leaders(rows: _Rows, lead: np.ndarray, known: int) -> Iterator[tuple[np.ndarray, ...]]:
    keys, docs = rows.keys[lead], rows.docs[lead]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([starts, [lead.size]]))
    head = np.repeat(starts, sizes)
    left = np.zeros(lead.size, bool)
    others = np.flatnonzero((docs != docs[head]) & (lead >= known))
    at = np.zeros(rows.keys.size, np.int64)
    at[lead] = np.arange(lead.size)
    for j, i, ok, a, b in _compared(rows, lead[others], lead[head[others]]):
        left[at[j[~ok]]] = True
        yield j[ok], i[ok], a[ok], b[ok], a[ok], b[ok]
    # What does not stand like the first: a word more or less, or another passage. Windows that share too few shingles
    # with all other documents of their hash go first.
    some = np.flatnonzero(np.repeat(np.logical_or.reduceat(left, starts), sizes))
    if not some.size:
        return
    group = np.repeat(np.arange(starts.size, dtype=np.uint64), sizes)[some]
    filled = rows.filled[lead[some]]
    _, value = np.unique(((group << np.uint64(32))[:, None] | rows.grid[lead[some]])[filled], return_inverse=True)
    names, doc = np.unique(docs[some], return_inverse=True)
    holders = np.bincount(np.unique(value * names.size + np.repeat(doc, filled.sum(axis=1))) // names.size)
    shared = np.zeros(filled.shape, bool)
    shared[filled] = holders[value] > 1
    fit = some[runs_of(shared)[0]]
    if not fit.size:
        return
    of_group = np.searchsorted(starts, fit, "right") - 1
    cuts = np.flatnonzero(np.concatenate([[True], of_group[1:] != of_group[:-1], [True]]))
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        near = fit[s:e]
        yield from _first_alike(rows, lead[near], lead[near[left[near]]])


class _Near:
    """Windows by the shingles beside their anchor. A run of ``SPAN`` holds the anchor and misses at most ``SPAN`` - ``NEED`` shingles; of the next
    ones on the anchor's side with the longer part of the run, one more than that, at least one stands in any window that the run repeats."""

    def __init__(self, rows: _Rows, windows: np.ndarray) -> None:
        beside = SPAN - NEED + 1
        columns = np.concatenate([np.arange(SPAN - 1 - beside, SPAN - 1), np.arange(SPAN, SPAN + beside)])
        there = rows.filled[np.ix_(windows, columns)]
        values, holders = rows.grid[np.ix_(windows, columns)][there], np.repeat(np.arange(windows.size), there.sum(axis=1))
        order = np.argsort(values, kind="stable")
        self.values, first = np.unique(values[order], return_index=True)
        self.holders, self.bounds = holders[order], np.append(first, values.size)

    def sharing(self, values: np.ndarray, most: int) -> np.ndarray | None:
        """The windows that have one of the values beside their anchor; None if that means to read over ``most`` entries."""
        if not self.values.size:
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.values, values), self.values.size - 1)
        at = at[self.values[at] == values]
        low, past = self.bounds[at], self.bounds[at + 1]
        if (past - low).sum() > most:
            return None
        return np.unique(np.concatenate([self.holders[a:b] for a, b in zip(low.tolist(), past.tolist(), strict=True)])) if at.size else at


def _first_alike(rows: _Rows, firsts: np.ndarray, later: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Of the windows ``later`` those that repeat one of the windows ``firsts`` of a document before, each with the first of them.

    One first after the other meets those that share a shingle beside the anchor, or all that are left where these are fewer;
    what it finds is not compared again. So windows that resemble each other take one comparison each.
    """
    index, open_ = _Near(rows, later), np.ones(later.size, bool)
    waiting, found = np.arange(later.size), 0
    for i in firsts.tolist():
        if 2 * found > waiting.size:
            waiting, found = waiting[open_[waiting]], 0
        if not waiting.size:
            return
        mine, own = np.unique(rows.grid[i][rows.filled[i]], return_inverse=True)
        some = index.sharing(mine, waiting.size)
        some = waiting if some is None else some
        some = some[open_[some]]
        some = some[rows.docs[later[some]] > rows.docs[i]]
        for k in range(0, some.size, 1 << 12):
            at = some[k:k + (1 << 12)]
            grid, filled = rows.grid[later[at]], rows.filled[later[at]]
            value = np.minimum(np.searchsorted(mine, grid), mine.size - 1)
            hit = (mine[value] == grid) & filled
            enough = hit.sum(axis=1) >= NEED
            at, value, hit = at[enough], value[enough], hit[enough]
            if not at.size:
                continue
            held = np.zeros((at.size, mine.size), bool)
            held[np.nonzero(hit)[0], value[hit]] = True
            theirs = np.zeros(hit.shape, bool)
            theirs[:, rows.filled[i]] = held[:, own]
            (ok, a, b), (too, c, d) = runs_of(hit), runs_of(theirs)
            m = np.flatnonzero(ok & too)
            open_[at[m]] = False
            found += m.size
            yield later[at[m]], np.full(m.size, i), a[m], b[m], c[m], d[m]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of repeats (first_doc_id set) and of what they repeat (null) from windows that stand by hash."""
    def spans_of(rows: _Rows, known: int = 0, links: np.ndarray | None = None) -> tuple[pa.Table, np.ndarray]:
        found = [np.stack(part) for part in repeats(rows, known, links)]
        j, i, a, b, c, d = np.concatenate(found, axis=1) if found else np.zeros((6, 0), np.int64)
        at, low, past = np.concatenate([j, i]), np.concatenate([a, c]), np.concatenate([b, d])
        base = rows.places[at].astype(np.int64) - (SPAN - 1)
        table = pa.table({"doc_id": rows.docs[at], "digest": rows.digests[at],
                          "first_doc_id": pa.array(np.concatenate([rows.docs[i], rows.docs[i]]), mask=np.arange(at.size) >= j.size),
                          "start_word": (base + low).astype(np.int32), "end_word": (base + past + WIDTH - 1).astype(np.int32)})
        return table.group_by(table.column_names, use_threads=False).aggregate([]), np.stack([j, i, a, b, c, d])

    held: list[_Rows] = []  # of the last key, of which more may come: leaders of earlier blocks, then the last rows
    waiting, known, links = 0, 0, None
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK // 4):
            part = batch.slice(k, BLOCK // 4)
            keys = part.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if held and (cut or held[0].keys[0] != keys[-1]):
                yield from spans_of(_Rows.joined([*held, _Rows.of(part.slice(0, cut))]) if cut else _Rows.joined(held), known, links)[0].to_batches()
                held, waiting, known, links = [], 0, 0, None
            elif cut:
                yield from spans_of(_Rows.of(part.slice(0, cut)))[0].to_batches()
            held.append(_Rows.of(part.slice(cut)))
            waiting += len(keys) - cut
            if waiting >= BLOCK:
                block = _Rows.joined(held)
                spans, found = spans_of(block, known, links)
                yield from spans.to_batches()
                # A window that repeats an earlier one may be the only one that a later window resembles, so it goes on too.
                lead = np.sort(leaders_of(block)[0])
                repeated = np.full((5, block.keys.size), -1)
                if links is not None:
                    repeated[:, :known] = links
                repeated[:, found[0]] = found[1:]
                links = repeated[:, lead]
                links[0] = np.where(links[0] < 0, -1, np.searchsorted(lead, links[0]))
                held, waiting, known = [block.take(lead)], 0, lead.size
    if held:
        yield from spans_of(_Rows.joined(held), known, links)[0].to_batches()


def windows_of(docs: DataFrame) -> DataFrame:
    """(key, doc, digest, c, left, content): the windows of (doc, text) whose hash stands in several documents."""
    windows = docs.select("doc", "text").mapInArrow(_windows, "key long, doc long, c int, left byte, right byte")
    keys = windows.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("last")).where("last <> least").select("key")
    # The window table is made twice, from the same scan, rather than stored. What is joined back is written, so that
    # the join's sides are plain exchanges whose hot keys adaptive execution may split.
    anchors = windows.join(written(keys, "passage-keys"), "key").groupBy("doc").agg(
        F.collect_list(F.struct("key", "c", "left", "right")).alias("anchors"))
    return docs.join(written(anchors, "passage-anchors"), "doc").mapInArrow(
        _contexts, "key long, doc long, digest long, c int, left byte, content binary")


def _merged(spans: DataFrame, *keys: str) -> DataFrame:
    """One row for each run of spans that overlap or touch."""
    order = Window.partitionBy(*keys).orderBy("start_word", "end_word")
    past = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = spans.withColumn("opens", F.when(F.col("start_word") <= past, 0).otherwise(1))
    runs = flagged.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).drop("run")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, first_doc_id, start_word, end_word, is_first, digest): passages of WORDS words or more that
    stand in several documents. Every repeat names an earlier document that it repeats; that document's own
    passage is listed too (is_first). ``digest`` tells texts apart where rows share a doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where("doc IS NOT NULL AND text IS NOT NULL")
    docs = docs.withColumn("digest", F.xxhash64("text"))
    same = docs.select("doc", "digest", F.xxhash64(F.lit(1), "text").alias("of"))
    texts = written(same.groupBy("digest", "of").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("last <> first"), "passage-texts")
    copies = written(same.join(texts, ["digest", "of"]).where("doc <> first").select("doc", "digest", "first"), "passage-copies")
    searched = read_on(docs, copies, ["doc", "digest"], BROADCAST_ROWS)
    sizes = docs.join(sized(texts.select(F.col("first").alias("doc"), "digest")), ["doc", "digest"], "left_semi").groupBy("doc", "digest").agg(
        F.min(F.regexp_count("text", F.lit(WORD))).cast("int").alias("words"))
    sizes = written(sizes.where(F.col("words") >= WORDS).withColumnRenamed("doc", "first"), "passage-sizes")

    found = windows_of(searched).repartition("key").sortWithinPartitions("key", "doc", "c").mapInArrow(
        _verified, "doc_id long, digest long, first_doc_id long, start_word int, end_word int").distinct()
    found = written(found, "passage-spans")
    whole = [F.lit(0).alias("start_word"), F.col("words").alias("end_word")]
    wide = copies.join(sizes, ["first", "digest"])
    repeats_ = _merged(found.where("first_doc_id IS NOT NULL"), "doc_id", "digest", "first_doc_id").unionByName(
        wide.select(F.col("doc").alias("doc_id"), "digest", F.col("first").alias("first_doc_id"), *whole))
    firsts = _merged(found.where("first_doc_id IS NULL").drop("first_doc_id").unionByName(
        sizes.select(F.col("first").alias("doc_id"), "digest", *whole)), "doc_id", "digest")
    columns = ["doc_id", "first_doc_id", "start_word", "end_word", "is_first", "digest"]
    return repeats_.withColumn("is_first", F.lit(False)).select(*columns).unionByName(
        firsts.withColumn("first_doc_id", F.col("doc_id")).withColumn("is_first", F.lit(True)).select(*columns))


def strip(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` without the repeats (the first document keeps its passage); ``n_chars`` follows the text if there."""
    import re

    spans = written(passages.where("NOT is_first").groupBy("doc_id", "digest").agg(
        F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("spans")), "passage-cuts")
    # Rows travel as one column each, so that no name of theirs meets one of ours.
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    same = (F.col("row.doc_id") == F.col("doc_id")) & (F.xxhash64("row.text") == F.col("digest"))
    both = rows.join(sized(spans), same, "left").select("row", F.col("row.text").alias("text"), "spans")
    columns, word = docs.columns, re.compile(WORD.encode())

    def cut(data: bytes, spans: list[dict]) -> str:
        places = [m.span() for m in word.finditer(data)]
        out, at = [], 0
        for s in spans:
            first, last = places[s["start_word"]][0], places[min(s["end_word"], len(places)) - 1][1]
            out.append(data[at:max(at, first)])
            at = max(at, last)
        return (b"".join(out) + data[at:]).decode().strip()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [cut(t.as_buffer().to_pybytes(), s) if s and t.is_valid else t.as_py()
                         for t, s in zip(part.column("text"), part.column("spans").to_pylist(), strict=True)]
                fields = part.column("row").flatten()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(texts, pa.string()) if c == "text" else x for c, x in zip(columns, fields, strict=True)], names=columns)

    out = both.mapInArrow(kept, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
