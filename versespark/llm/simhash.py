"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has one bit per place, set when the bit is set in over half of the hashes of the text's word
shingles. For radius r, each bit place i gets a non-zero vector m(i) of r + 1 bits, in turn; mask v (any
non-zero vector of r + 1 bits) holds the places with <m(i), v> = 1. Two fingerprints that differ in at most r
places differ in places whose vectors span at most r dimensions, so some v is orthogonal to them all,
and under that mask the two agree: every pair within the radius collides in some table.

Equal fingerprints are one node. A bucket of up to ``PAIRWISE`` nodes is compared pair by pair. A larger one
is done exactly without pairs: its nodes also stand at each fingerprint one bit away; nodes within radius 2 meet at one in between, and all that meet are
within the radius, so a star to the smallest keeps every link's component. That needs r <= 2.

Defined cases: null and empty texts have fingerprint zero and link like any other; a text with
fewer words than a shingle is one shingle; rows with a null doc_id never name a component (null if
alone); repeated rows agree; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, slices, written

PAIRWISE = 24
BITS = 64


def masks(bits: int = BITS, radius: int = 2) -> list[int]:
    """The covering masks, as unsigned integers."""
    size = 1 << (radius + 1)
    return [sum(1 << i for i in range(bits) if (((1 + i % (size - 1)) & v).bit_count() & 1))
            for v in range(1, size)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of ``width`` words of a lower-cased text, repeats included."""
    import xxhash

    words = data.lower().split()
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    digest = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False))
    return np.fromiter((digest(g, 42) for g in grams), np.uint64, len(words) - width + 1)


def majority_bits(hashes: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Which of the 64 bits are set in over half of the hashes, lowest first."""
    counts = np.zeros(64, np.int64)
    for i in range(0, hashes.size, step):
        block = hashes[i:i + step].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return 2 * counts > hashes.size


def packed(bits: np.ndarray, width: int = BITS) -> list[int]:
    """Signed longs of ``width`` bits each; bits that do not fill one are left out."""
    rows = bits[:bits.size // width * width].reshape(-1, width)
    full = np.zeros((len(rows), 64), bool)
    full[:, :width] = rows
    return np.packbits(full, axis=1, bitorder="little").view("<i8").ravel().tolist()


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of every whole text, as a signed long."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fps = [packed(majority_bits(shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else b"", width)))[0]
                       for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps, pa.int64())],
                                                 names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(hashed, schema)


def links(nodes: DataFrame, bits: int = BITS, radius: int = 2, prints: int = 1, pairwise: int = PAIRWISE) -> DataFrame:
    """Edges (a, b) between nodes (node: long, fps: array of ``prints`` longs) that join all nodes of which some
    fingerprint of the one is within the radius of the same fingerprint of the other.

    Each edge joins two nodes within the radius, and any two within it are joined by edges.
    """
    if radius > 2:
        raise ValueError("large buckets are exact up to radius 2")
    cover = [signed(m) for m in masks(bits, radius)]
    each = nodes.select("node", F.posexplode("fps").alias("print", "fp")).where(F.col("print") < prints)
    # Nodes of one fingerprint are a star around their first; the search runs over distinct fingerprints only.
    # Tables that are joined back are written first, so that adaptive execution sees their size and may split hot keys.
    firsts = written(each.groupBy("print", "fp").agg(F.min("node").alias("first")), "print-firsts")
    equal = each.join(firsts, ["print", "fp"]).where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))

    masked = F.explode(F.array(*[F.xxhash64("print", F.lit(j), F.col("fp").bitwiseAND(F.lit(m))) for j, m in enumerate(cover)]))
    rows = firsts.select(masked.alias("key"), F.col("first").alias("node"), "print", "fp")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(written(sizes, "bucket-sizes"), "key")
    far = lambda x, y: F.bit_count(x.bitwiseXOR(y))

    small = rows.where(F.col("n") <= pairwise).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("node", "print", "fp"))).alias("m"))
    small = small.select("m", F.explode("m").alias("x")).select("x", F.explode(F.filter("m", lambda y: (
        (y["node"] > F.col("x.node")) & (y["print"] == F.col("x.print")) & (far(y["fp"], F.col("x.fp")) <= radius)))).alias("y"))

    flips = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(bits)])
    large = rows.where(F.col("n") > pairwise).select("print", "node", "fp").distinct()
    large = large.select("print", "node", "fp", F.explode(flips).alias("flip"))
    large = large.select("print", "node", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    heads = large.groupBy("print", "z").agg(F.min("node").alias("head"), F.count("*").alias("k")).where("k > 1").drop("k")
    stars = large.join(written(heads, "link-heads"), ["print", "z"]).where("node <> head")
    return (small.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
            .unionByName(stars.select(F.col("head").alias("a"), F.col("node").alias("b"))).unionByName(equal).distinct())


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every document; fingerprints link within the radius."""
    prints = written(fingerprints(docs, width), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "fingerprint-nodes")
    known = nodes.where("node IS NOT NULL").select("node", F.array("fp").alias("fps"))
    parts = nodes.join(components(links(known, BITS, radius)), "node", "left").select(
        "fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(parts, "fp").select("doc_id", "fp", "component_id")


#: Similar documents: fingerprints of the shingles around a text's smallest ones find candidates; a sketch, a fingerprint of
#: its whole set of five-word shingles, decides all but the close cases, and those are decided by the sets themselves.
SHINGLE, WINDOWS, AROUND = 5, 6, 3
SKETCH_WORDS, DEVIATIONS = 8, 2.5
#: Rows of a key that a task compares with as many others at once.
BLOCK = 1 << 15
#: Bytes of shingle sets that stand on either side of a cell of close pairs, and of a cell of a group of parts.
CELL_BYTES, GROUP_BYTES = 1 << 18, 1 << 19


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of each text's five-word shingles, in order; fewer words are one shingle, none are none."""
    from .passages import shingles_of

    hashes, starts, counts = shingles_of(texts, SHINGLE)
    return [hashes[a:a + n] if n else shingle_hashes(t, SHINGLE) for t, a, n in zip(texts, starts.tolist(), counts.tolist(), strict=True)]


def majorities(hashes: np.ndarray, there: np.ndarray) -> np.ndarray:
    """The fingerprint of each row of a few hashes, those that are ``there``."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(*hashes.shape, 8), axis=2, bitorder="little")
    counts = (bits * there[:, :, None]).sum(axis=1, dtype=np.uint8)
    return np.packbits(2 * counts.astype(np.int32) > there.sum(axis=1)[:, None], axis=1, bitorder="little").view("<i8").ravel()


def window_prints(sets: list[np.ndarray]) -> np.ndarray:
    """For each text (no set is empty) and each of ``WINDOWS`` functions the fingerprint of the shingles around the one with
    the smallest hash.

    Similar texts have that shingle in common in as many cases as their Jaccard similarity, and an edit elsewhere leaves its surroundings
    alone; so edits all over and blocks that are added, cut or replaced are found alike.
    """
    from .passages import mixed

    hashes, sizes = np.concatenate(sets), np.array([x.size for x in sets])
    starts, out = np.cumsum(sizes) - sizes, []
    row = np.repeat(np.arange(sizes.size), sizes)
    for f in range(WINDOWS):
        values = mixed(hashes, 50 + f)
        least = np.flatnonzero(values == np.minimum.reduceat(values, starts)[row])
        least = least[np.unique(row[least], return_index=True)[1]]
        places = least[:, None] + np.arange(-AROUND, AROUND + 1)
        there = (places >= starts[:, None]) & (places < (starts + sizes)[:, None])
        out.append(majorities(mixed(hashes[np.clip(places, 0, hashes.size - 1)], 60), there))
    return np.stack(out, axis=1)


def bit_planes(words: np.ndarray) -> list[np.ndarray]:
    """Of the number of words of a row that have a bit set, the binary digits of every bit, lowest first."""
    digits, waiting = [], list(words.T)
    while waiting:
        carried = []
        while len(waiting) > 1:
            a, b = waiting.pop(), waiting.pop()
            both, either = a & b, a ^ b
            if waiting:
                c = waiting.pop()
                both, either = both | c & either, either ^ c
            waiting.append(either)
            carried.append(both)
        digits.append(waiting[0])
        waiting = carried
    return digits


def sketches_of(sets: list[np.ndarray], block: int = 15, run: int = 255) -> np.ndarray:
    """For each text (no set is empty) ``SKETCH_WORDS`` fingerprints of the set of its shingles, each under another function.

    Bits are counted in blocks of 15 words by bitwise adders, the blocks' counts added up by text.
    """
    from .passages import mixed

    sets = [np.unique(x) for x in sets]
    sizes = np.array([x.size for x in sets])
    blocks = -(-sizes // block)
    firsts = np.cumsum(blocks) - blocks
    place = np.arange(sizes.sum()) + np.repeat(block * firsts - (np.cumsum(sizes) - sizes), sizes)
    words, mask = np.zeros(block * blocks.sum(), np.uint64), np.zeros(block * blocks.sum(), np.uint64)
    words[place], mask[place] = np.concatenate(sets), np.uint64(2**64 - 1)
    # Runs of so many blocks that their counts fit a byte, then texts.
    runs = np.unique(np.concatenate([firsts, np.arange(0, blocks.sum(), run)]))
    of_text = np.searchsorted(runs, firsts)
    out = []
    for f in range(1, SKETCH_WORDS + 1):
        counts = np.zeros((sizes.size, 64), np.int64)
        for digit, plane in enumerate(bit_planes(np.ascontiguousarray((mixed(words, f) & mask).reshape(-1, block).T).T)):
            bits = np.unpackbits(np.ascontiguousarray(plane).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += np.add.reduceat(np.add.reduceat(bits, runs, axis=0, dtype=np.uint8).astype(np.int64), of_text, axis=0) << digit
        out.append(np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view("<i8").ravel())
    return np.stack(out, axis=1)


def similarity_prints(docs: DataFrame) -> DataFrame:
    """(doc_id, fps, sketch) of every whole text."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("fps array<long>, sketch array<long>")])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column("text")])
                some = [i for i, x in enumerate(sets) if x.size]
                columns = []
                for made, width in ((window_prints, WINDOWS), (sketches_of, SKETCH_WORDS)):
                    values = np.zeros((len(sets), width), np.int64)
                    if some:
                        values[some] = made([sets[i] for i in some])
                    columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * width, pa.int32()), pa.array(values.ravel())))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(hashed, schema)


def differing_share(similarity: float) -> float:
    """Share of differing SimHash bits at which two equal-sized sets have the Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def differing_bits(similarity: float) -> tuple[int, int]:
    """Differing bits of a sketch up to which two sets surely have the similarity, and beyond which they surely have not."""
    bits, share = 64 * SKETCH_WORDS, differing_share(similarity)
    spread = DEVIATIONS * (bits * share * (1 - share)) ** 0.5
    return int(bits * share - spread), int(bits * share + spread)


def candidate_keys(nodes: DataFrame, bits: int = BITS, radius: int = 2) -> tuple[DataFrame, DataFrame]:
    """(key, node): the keys that ``nodes`` (node, fps) share with others, and (key, n): how many nodes have each. Nodes with an equal fingerprint
    share its own key; fingerprints within the radius, the key of a covering mask. Masks are searched over distinct fingerprints only."""
    each = nodes.select("node", F.posexplode("fps").alias("print", "fp"))
    values = written(each.groupBy("print", "fp").agg(F.count("*").alias("n")), "print-values")
    masked = F.explode(F.array(*[F.xxhash64("print", F.lit(j), F.col("fp").bitwiseAND(F.lit(signed(m))))
                                 for j, m in enumerate(masks(bits, radius))]))
    keyed = values.select("print", "fp", masked.alias("key"), "n")
    shared = written(keyed.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"), "print-keys")
    near = keyed.join(shared, "key").select("print", "fp", "key", "n")
    same = values.where("n > 1").select("print", "fp", F.xxhash64("print", F.lit(-1), "fp").alias("key"), "n")
    buckets = written(same.unionByName(near), "print-buckets")
    return each.join(buckets, ["print", "fp"]).select("key", "node"), buckets.groupBy("key").agg(F.sum("n").alias("n"))


def _pairs(keys: np.ndarray, nodes: np.ndarray, sides: np.ndarray, sketches: np.ndarray, sure: int, most: int,
           pairwise: int, spanning: bool = False) -> Iterator[np.ndarray]:
    """(a, b, d): pairs of rows of a key that differ in d <= ``most`` bits.

    Rows of a key stand together. Small keys give all such pairs. In a larger one a row that is surely similar to one
    that was reached is reached from it, so that chains of sure pairs are parts; of rows of different parts all pairs
    are given, where a key has two sides only those between them. ``spanning`` gives of these each row's nearest and as many as
    join what all of them join: at most two for each row.
    """
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ends = np.concatenate([starts[1:], [keys.size]])
    sizes = ends - starts
    differing = lambda x, y: np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int32)
    left = np.repeat(np.where(sizes <= pairwise, ends, 0), sizes)
    for step in range(1, pairwise):
        i = np.flatnonzero(left > np.arange(keys.size) + step)
        if not i.size:
            break
        d = differing(sketches[i], sketches[i + step])
        yield np.stack([nodes[i], nodes[i + step], d])[:, d <= most]
    parts = np.arange(keys.size)
    for start, end in zip(starts[sizes > pairwise].tolist(), ends[sizes > pairwise].tolist(), strict=True):
        waiting, reached = np.arange(start, end), []
        while waiting.size:
            if not reached:
                reached, first, waiting = [int(waiting[0])], int(waiting[0]), waiting[1:]
                parts[first] = first
                continue
            at = reached.pop()
            d = differing(sketches[waiting], sketches[at])
            hit = d <= sure
            if hit.any():
                found = waiting[hit]
                parts[found] = first
                reached += found.tolist()
                yield np.stack([np.full(found.size, nodes[at]), nodes[found], d[hit]])
                waiting = waiting[~hit]
        own, side = parts[start:end], sides[start:end]
        largest, two = start + np.argmax(np.bincount(own - start)), side.min() < side.max()
        nearest, partner, groups = np.full(own.size, most + 1), np.full(own.size, -1), own.copy()
        for at in (start + np.flatnonzero(own != largest)).tolist():
            others = (own != parts[at]) & ((own == largest) | (np.arange(start, end) > at))
            others = start + np.flatnonzero(others & (side != sides[at]) if two else others)
            d = differing(sketches[others], sketches[at])
            near = d <= most
            if not near.any():
                continue
            others, d = others[near], d[near]
            if not spanning:
                yield np.stack([np.full(others.size, nodes[at]), nodes[others], d])
                continue
            row, rows = at - start, others - start
            nearer = d < nearest[rows]
            nearest[rows[nearer]], partner[rows[nearer]] = d[nearer], row
            if d.min() < nearest[row]:
                nearest[row], partner[row] = d.min(), rows[d.argmin()]
            met, first_met = np.unique(groups[rows], return_index=True)
            met, first_met = met[met != groups[row]], first_met[met != groups[row]]
            if met.size:
                yield np.stack([np.full(met.size, nodes[at]), nodes[others[first_met]], d[first_met]])
                groups[np.isin(groups, met)] = groups[row]
        some = np.flatnonzero(partner >= 0)
        if some.size:
            yield np.stack([nodes[start + some], nodes[start + partner[some]], nearest[some]])


def candidate_pairs(rows: DataFrame, sure: int, most: int, pairwise: int = PAIRWISE, block: int = BLOCK, sizes: DataFrame | None = None,
                    spanning: bool = False) -> DataFrame:
    """Pairs (a, b, d) from rows (key, node, s0, s1, ...): rows of a key with d <= ``most`` differing bits, all of them but those that chains of pairs
    with d <= ``sure`` join. ``sizes`` has the rows of each key, (key, n), and is counted if it is not given. With ``spanning`` the number of pairs grows
    with the rows: a large key gives of those with d > ``sure`` each row's nearest and a forest that joins the same rows as all of them.

    Keys of more than ``block`` rows are dealt into blocks by a hash, and each pair of blocks is a key of its own, with two sides.
    """
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last key's rows, of which more may come

        def edges_of(pieces: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            data = np.concatenate(pieces, axis=1)
            held.clear()
            for a, b, d in _pairs(*data[:3], np.ascontiguousarray(data[3:].T).view(np.uint64), sure, most, pairwise, spanning):
                low, high = np.minimum(a, b), np.maximum(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (low, high)] + [pa.array(d, pa.int32())], names=["a", "b", "d"])

        for batch in batches:
            if not batch.num_rows:
                continue
            data = np.stack([c.to_numpy() for c in batch.columns])
            cut = int(np.searchsorted(data[0], data[0, -1]))
            if held and (cut or held[0][0, 0] != data[0, -1]):
                yield from edges_of([*held, data[:, :cut]])
            elif cut:
                yield from edges_of([data[:, :cut]])
            held.append(data[:, cut:])
        if held:
            yield from edges_of([*held])

    sizes = rows.groupBy("key").agg(F.count("*").alias("n")) if sizes is None else sizes
    # Of all keys' rows, one large key for every ``block`` of them at most.
    large = F.broadcast(written(sizes.where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).alias("blocks")), "large-keys"))
    blocks = F.coalesce("blocks", F.lit(1)).cast("long")
    dealt = rows.join(large, "key", "left").withColumns({"blocks": blocks, "side": F.pmod(F.xxhash64("node"), blocks)})
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cell = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other")))
    dealt = dealt.select(cell.alias("key"), "node", "side", *[c for c in rows.columns if c not in ("key", "node")])
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(linked, "a long, b long, d int").groupBy("a", "b").agg(F.min("d").alias("d"))


def sets_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, items): the set of five-word shingles of each text whose doc_id is in ``nodes`` (node), written."""
    from .passages import sized

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [np.unique(x.astype(np.uint32)).tobytes()
                        for x in shingle_sets([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column("text")])]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], names=["node", "items"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    return written(texts.join(sized(nodes), "node").mapInArrow(made, "node long, items binary"), "close-sets")


def similar_pairs(pairs: DataFrame, docs: DataFrame, similarity: float, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """The pairs (a, b) of doc_ids whose sets of five-word shingles have the Jaccard similarity.

    Both ends of a pair are dealt by hash, and their numbers make its cell; a set goes once to each cell that has a pair of it.
    """
    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        if min(x.size, y.size) < similarity * max(x.size, y.size) - 1e-9:
            return False
        both = np.intersect1d(x, y, assume_unique=True).size
        return both >= similarity * (x.size + y.size - both) - 1e-9

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, list[np.ndarray]] = {}  # of one cell; rows that share a doc_id have one each
        last = None
        for batch in batches:
            keep, items = np.zeros(batch.num_rows, bool), batch.column("items")
            for k, (cell, is_pair, a, b) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("cell", "is_pair", "a", "b")], strict=True)):
                if cell != last:
                    sets, last = {}, cell
                if is_pair:
                    keep[k] = any(alike(x, y) for x in sets.get(a, ()) for y in sets.get(b, ()))
                else:
                    sets.setdefault(a, []).append(np.frombuffer(items[k].as_py(), np.uint32))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = sets_of(_ends(pairs), docs)
    side = max(1, -(-(sets.agg(F.sum(F.length("items"))).first()[0] or 0) // cell_bytes))
    number = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
    dealt = pairs.select((number("a") * side + number("b")).alias("cell"), "a", "b")
    needed = dealt.select("cell", F.col("a").alias("node")).distinct().unionByName(dealt.select("cell", F.col("b").alias("node")).distinct()).distinct().join(sets, "node")
    rows = needed.select("cell", F.lit(False).alias("is_pair"), F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "items").unionByName(
        dealt.select("cell", F.lit(True).alias("is_pair"), "a", "b", F.lit(None).cast("binary").alias("items")))
    return rows.repartition("cell").sortWithinPartitions("cell", "is_pair").mapInArrow(compared, "a long, b long").distinct()


def _joined(parts: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """(a, b): parts to join, so that rows of a cell whose sets have the similarity are in one; where a cell has two sides, rows of different sides.

    A row is compared with all rows at once that are not joined to it yet and whose size does not rule the similarity out.
    """
    sizes, found = np.array([x.size for x in sets]), []
    order = np.lexsort((sizes, sides))
    labels, sizes, sets = parts[order], sizes[order], [sets[i] for i in order]
    first = int((sides == sides.min()).sum()) % sides.size  # rows of the first of two sides, 0 if there is one
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    words, items = np.unique(np.concatenate(sets), return_inverse=True)
    items, held = items.astype(np.int32), np.zeros(words.size, bool)
    for at in range(first or sizes.size):
        low = max(at + 1, first + int(np.searchsorted(sizes[first:], similarity * sizes[at] - 1e-9)))
        high = first + int(np.searchsorted(similarity * sizes[first:] - 1e-9, sizes[at], "right"))
        others = low + np.flatnonzero(labels[low:high] != labels[at])
        if not others.size:
            continue
        own, start = items[bounds[at]:bounds[at + 1]], bounds[others[0]]
        held[own] = True
        counts = np.concatenate([[0], np.cumsum(held[items[start:bounds[others[-1] + 1]]], dtype=np.int32)])
        held[own] = False
        both = counts[bounds[others + 1] - start] - counts[bounds[others] - start]
        met = np.unique(labels[others[both >= similarity * (sizes[at] + sizes[others] - both) - 1e-9]])
        found += [(int(labels[at]), x) for x in met.tolist()]
        labels[np.isin(labels, met)] = labels[at]
    return found


def joined_parts(members: DataFrame, docs: DataFrame, similarity: float, cell_bytes: int = GROUP_BYTES) -> DataFrame:
    """(a, b): parts to join, from ``members`` (group, part, node), so that documents of a group whose sets of five-word shingles have
    the Jaccard similarity are in one part.

    All pairs of different parts are decided where their sets meet, and only what joins parts is given. A group's sets are dealt into blocks of
    ``cell_bytes``, and each pair of blocks is a cell; rows of its largest part only meet those of the others.
    """
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last cell's rows, of which more may come

        def decided() -> list[tuple[int, int]]:
            _, parts, sides, items = zip(*held, strict=True)
            held.clear()
            if min(parts) == max(parts):
                return []
            return _joined(np.array(parts), np.array(sides), [np.frombuffer(x, np.uint32) for x in items], similarity)

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], names=["a", "b"])

        for batch in batches:
            found = []
            for row in zip(*[batch.column(c).to_pylist() for c in ("cell", "part", "side", "items")], strict=True):
                if held and held[0][0] != row[0]:
                    found += decided()
                held.append(row)
            yield batch_of(found)
        if held:
            yield batch_of(decided())

    rows = members.join(sets_of(members.select("node").distinct(), docs), "node")
    sizes = rows.groupBy("group", "part").agg(F.sum(F.length("items")).alias("bytes")).groupBy("group").agg(
        F.sum("bytes").alias("bytes"), F.max(F.struct("bytes", "part")).alias("largest"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / cell_bytes)).cast("long")
    # Of all sets, one large group for every ``cell_bytes`` of them at most.
    large = F.broadcast(written(sizes.where(F.col("bytes") > cell_bytes).select(
        "group", F.col("largest.part").alias("largest"), blocks(F.col("bytes") - F.col("largest.bytes")).alias("first"),
        blocks(F.col("largest.bytes")).alias("rest")), "large-groups"))
    first, rest, number = F.coalesce("first", F.lit(1).cast("long")), F.coalesce("rest", F.lit(0).cast("long")), F.xxhash64("node")
    in_largest = F.coalesce(F.col("part") == F.col("largest"), F.lit(False))
    dealt = rows.join(large, "group", "left").select(
        "group", "part", "items", F.when(in_largest, first + F.pmod(number, F.greatest(rest, F.lit(1)))).otherwise(F.pmod(number, first)).alias("side"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.when(in_largest, first).otherwise(first + rest) - 1)).alias("other"))
    dealt = dealt.select(F.xxhash64("group", F.least("side", "other"), F.greatest("side", "other")).alias("cell"), "part", "side", "items")
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(joined, "a long, b long").distinct()


def similar_documents(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every document with a doc_id; documents link from the Jaccard similarity of their
    five-word shingles on.

    At the similarity a candidate window stands in both texts in 4 of 5 cases for each of the six functions; where it
    does, an edit beside it must not change more than two bits of its fingerprint. Sketches decide outside
    ``DEVIATIONS`` standard deviations; the pairs between are decided by the exact similarity, all whose ends are not joined already:
    they are not listed, as their number grows with the square of a group; what they connect is a group, and its sets meet in blocks.
    """
    known = docs.where("doc_id IS NOT NULL")
    prints = written(similarity_prints(known), "similarity-prints")
    nodes = prints.groupBy("fps", "sketch").agg(F.min("doc_id").cast("long").alias("node"))
    nodes = written(nodes, "similarity-nodes")
    sure, most = differing_bits(similarity)
    sketches = nodes.select("node", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH_WORDS)])
    keys, sizes = candidate_keys(nodes)
    rows = keys.join(sketches, "node").select("key", "node", *[f"s{i}" for i in range(SKETCH_WORDS)])
    pairs = written(candidate_pairs(rows, sure, most, sizes=sizes, spanning=True), "similar-candidates")
    close = pairs.where(F.col("d") > sure)
    led = [components(pairs.where(F.col("d") <= sure).select("a", "b"), "sure-components")]
    # A row's nearest pairs join most of what there is to join; then all pairs are decided between parts that close pairs connect.
    open_ = close.withColumns({"a_part": F.col("a"), "b_part": F.col("b")})
    open_ = written(_led(_led(open_, "a_part", led[0]), "b_part", led[0]).where("a_part <> b_part"), "open-pairs")
    alike = written(similar_pairs(_nearest(open_), known, similarity), "alike-pairs")
    led.append(components(open_.join(alike, ["a", "b"]).select(F.col("a_part").alias("a"), F.col("b_part").alias("b"))))
    left = _led(_led(open_, "a_part", led[1]), "b_part", led[1]).select(F.col("a_part").alias("a"), F.col("b_part").alias("b"))
    groups = components(left, "open-groups").select(F.col("node").alias("part"), F.col("component").alias("group"))
    members = _led(_led(_ends(close).withColumn("part", F.col("node")), "part", led[0]), "part", led[1]).join(groups, "part")
    members = written(members.select("group", "part", "node"), "group-members")
    led.append(components(joined_parts(members, known, similarity)))
    parts = nodes.withColumn("component_id", F.col("node"))
    for leaders in led:
        parts = _led(parts, "component_id", leaders)
    return prints.join(parts.drop("node"), ["fps", "sketch"]).select("doc_id", "component_id")


def _led(df: DataFrame, column: str, parts: DataFrame) -> DataFrame:
    """``df`` with the component of its ``column`` in ``parts`` (node, component), if it has one, in its place."""
    to = parts.select(F.col("node").alias(column), F.col("component").alias("leader"))
    return df.join(to, column, "left").withColumn(column, F.coalesce("leader", column)).drop("leader")


def _ends(pairs: DataFrame) -> DataFrame:
    """(node): the ends of pairs (a, b)."""
    return pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct()).distinct()


def _nearest(pairs: DataFrame) -> DataFrame:
    """(a, b): the nearest of the pairs (a, b, d) of each of their ends."""
    ends = pairs.select(F.col("a").alias("node"), "d", "a", "b").unionByName(pairs.select(F.col("b").alias("node"), "d", "a", "b"))
    return ends.groupBy("node").agg(F.min(F.struct("d", "a", "b")).alias("pair")).select("pair.a", "pair.b").distinct()


def first_of_each(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of similar documents, that of the smallest doc_id.

    Rows without a doc_id stay; of rows that repeat a kept doc_id all stay, unless they are equal.
    """
    from .passages import sized

    repeats = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    unlike = docs
    if not repeats.isEmpty():  # only rows that share their doc_id with others are compared as a whole
        again = sized(repeats)
        unlike = docs.join(again, "doc_id", "left_anti").unionByName(docs.join(again, "doc_id", "left_semi").distinct()).select(docs.columns)
    gone = similar_documents(docs, similarity).where("doc_id <> component_id").select("doc_id").distinct()
    return unlike.join(sized(written(gone, "similar-gone")), "doc_id", "left_anti").select(docs.columns)
