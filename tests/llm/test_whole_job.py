"""Cases in which a shortcut would lose part of the job."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from versespark.llm import common, passages, simhash


def test_similar_pairs_behind_an_unlike_first(spark):
    """Rows of one key link by their own sketches, whatever the first row looks like; in blocks of any size."""
    draw = random.Random(6)
    bits = lambda n: sum(1 << i for i in draw.sample(range(64), n))
    far = [[draw.getrandbits(64) for _ in range(8)] for _ in range(40)]
    sketches = [far[0], far[1], [w ^ bits(2) for w in far[1]], *far[2:12]]
    # A chain: each next to the one before it, and far from the smallest.
    for _ in range(12):
        sketches.append([w ^ bits(7) for w in sketches[-1]])
    order = list(range(len(sketches)))
    draw.shuffle(order)
    sketches = [sketches[0], *[sketches[i] for i in order if i]]
    rows = spark.createDataFrame([(k, i, *[simhash.signed(w) for w in s]) for k in (7, 8) for i, s in enumerate(sketches)],
                                 "key long, node long, " + ", ".join(f"s{i} long" for i in range(8)))
    arrays = np.array(sketches, np.uint64)
    apart = np.bitwise_count(arrays[:, None] ^ arrays[None]).sum(axis=2)
    for pairwise in (30, 4):
        pairs = simhash.candidate_pairs(rows, 57, 98, pairwise=pairwise)
        found = {(r["a"], r["b"]): r["d"] for r in pairs.collect()}
        assert all(d == apart[a][b] <= 98 for (a, b), d in found.items())
        if pairwise > len(sketches):
            assert set(found) == {(a, b) for a in range(len(sketches)) for b in range(a + 1, len(sketches)) if apart[a][b] <= 98}
        sure = pairs.where("d <= 57").select("a", "b")
        got = {r["node"]: r["component"] for r in common.components(sure).collect()}
        want = list(range(len(sketches)))
        for _ in want:
            want = [min(want[j] for j in np.flatnonzero(apart[i] <= 57)) for i in range(len(want))]
        assert [got.get(i, i) for i in range(len(want))] == want
        assert len(set(want)) < len(want)


def edited(words, kind, share, draw):
    n = max(1, round(share * len(words)))
    if kind == "words":
        places = set(draw.sample(range(len(words)), n))
        return [f"e{draw.random()}" if i in places else w for i, w in enumerate(words)]
    if kind == "appended":
        return words + [f"e{draw.random()}" for _ in range(n)]
    if kind == "cut":
        return words[n:]
    at = draw.randrange(len(words) - n)
    return words[:at] + [f"e{draw.random()}" for _ in range(n)] + words[at + n:]


def test_similar_documents_against_brute_force(spark):
    """Links and their components at the exact similarity of 0.8, for edits of all kinds and sizes."""
    draw, rows = random.Random(11), []
    for g in range(150):
        words = [f"w{draw.randrange(40)}" for _ in range(draw.randrange(60, 400))]
        rows.append((len(rows), words))
        for kind in ("words", "appended", "cut", "replaced"):
            rows.append((len(rows), edited(words, kind, draw.choice((0.005, 0.01, 0.02, 0.03) if kind == "words" else (0.02, 0.08, 0.15, 0.3)), draw)))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for _, w in rows]
    links = [(i, j) for g in range(0, len(rows), 5) for i in range(g, g + 5) for j in range(i + 1, g + 5)
             if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    want = list(range(len(rows)))
    for _ in range(5):
        for i, j in links:
            want[i] = want[j] = min(want[i], want[j])
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    assert all(want[i] <= c for i, c in got.items())  # no component joins what the similarity does not
    assert sum(got[i] == got[j] for i, j in links) >= 0.97 * len(links)


@pytest.mark.parametrize("block", [1 << 17, 8, 3])
def test_chains_over_block_borders(spark, block):
    """A chain of rows that drifts away from its first stays one component, wherever the blocks of its key end; unlike rows stay apart."""
    draw = np.random.default_rng(15)
    rows = []
    for chain in range(2):
        bits = draw.integers(0, 2, 512, dtype=np.uint8)
        for _ in range(40):
            bits[draw.choice(512, 10, replace=False)] ^= 1
            rows.append((7, len(rows), *np.packbits(bits, bitorder="little").view(np.int64).tolist()))
    rows += [(9, i, *draw.integers(-2**62, 2**62, 8).tolist()) for i in range(100, 140)]
    frame = spark.createDataFrame(rows, ["key", "node", *[f"s{i}" for i in range(8)]]).coalesce(1)
    sure, most = simhash.differing_bits(0.8)
    edges = simhash.candidate_pairs(frame, sure, most, pairwise=4, block=block).collect()
    root = list(range(140))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b, d in edges:
        assert d <= most
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert {find(i) for i in range(40)} == {0} and {find(i) for i in range(40, 80)} == {40} and len({find(i) for i in range(100, 140)}) == 40


@pytest.mark.parametrize("block", [1 << 15, 16])
def test_every_close_pair_of_a_large_key(spark, block):
    """A row's nearest partner may fail the exact similarity where another does not: all pairs between parts are given, wherever a key's blocks end."""
    draw = np.random.default_rng(18)
    base, sketches = draw.integers(0, 2, 512, dtype=np.uint8), []
    for k in range(40):
        bits = base.copy()
        bits[draw.choice(512, 43, replace=False)] ^= 1  # two of them differ in about 79 bits
        sketches += [np.packbits(bits, bitorder="little").view(np.uint64)] if k % 8 else [np.packbits(bits, bitorder="little").view(np.uint64)] * 2
    frame = spark.createDataFrame([(7, i, *s.view(np.int64).tolist()) for i, s in enumerate(sketches)], ["key", "node", *[f"s{i}" for i in range(8)]])
    sure, most = simhash.differing_bits(0.8)
    apart = np.bitwise_count(np.array(sketches)[:, None] ^ np.array(sketches)[None]).sum(axis=2)
    found = {(r["a"], r["b"]): r["d"] for r in simhash.candidate_pairs(frame, sure, most, pairwise=4, block=block).collect()}
    close = {(a, b) for a in range(len(sketches)) for b in range(a + 1, len(sketches)) if sure < apart[a, b] <= most}
    assert len(close) > 500 and close <= set(found)
    assert all(d == apart[p] for p, d in found.items())


@pytest.mark.parametrize("cell_bytes", [1 << 18, 500])
def test_similar_pairs_in_cells(spark, cell_bytes):
    """Pairs are decided by the exact similarity, however their cells are cut; of rows that share a doc_id any may be the similar one."""
    draw = random.Random(19)
    base = [f"w{draw.randrange(10 ** 6)}" for _ in range(80)]
    texts = [" ".join([*base[:k], *(f"x{draw.randrange(10 ** 6)}" for _ in range(80 - k))]) for k in range(60, 81, 2)]
    rows = [*enumerate(texts), (0, texts[-1])]
    sets = {i: [] for i in range(len(texts))}
    for i, t in rows:
        sets[i].append({tuple(t.split()[k:k + 5]) for k in range(76)})
    pairs = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts))]
    want = {(a, b) for a, b in pairs if any(len(x & y) >= 0.8 * len(x | y) for x in sets[a] for y in sets[b])}
    got = simhash.similar_pairs(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(rows, "doc_id long, text string"), 0.8, cell_bytes)
    assert sorted(map(tuple, got.collect())) == sorted(want) and 0 < len(want) < len(pairs)


def joined(edges, rows):
    """The smallest of the rows that edges join with each."""
    root = list(range(rows))
    for _ in range(rows):
        before = list(root)
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root
    return root


@pytest.mark.parametrize("block", [1 << 15, 16])
def test_spanning_pairs_of_a_large_key(spark, block):
    """Spanning pairs connect the rows that all close pairs connect, hold each row's nearest, and grow with the rows."""
    draw, sketches = np.random.default_rng(18), []
    for group in range(3):
        base = draw.integers(0, 2, 512, dtype=np.uint8)
        for k in range(40):
            bits = base.copy()
            bits[draw.choice(512, 43, replace=False)] ^= 1
            sketches += [np.packbits(bits, bitorder="little").view(np.uint64)] * (1 if k % 8 else 2)
    frame = spark.createDataFrame([(7, i, *s.view(np.int64).tolist()) for i, s in enumerate(sketches)], ["key", "node", *[f"s{i}" for i in range(8)]])
    sure, most = simhash.differing_bits(0.8)
    apart = np.bitwise_count(np.array(sketches)[:, None] ^ np.array(sketches)[None]).sum(axis=2)
    found = {(r["a"], r["b"]): r["d"] for r in simhash.candidate_pairs(frame, sure, most, pairwise=4, block=block, spanning=True).collect()}
    close = [(a, b) for a in range(len(sketches)) for b in range(a + 1, len(sketches)) if apart[a, b] <= most]
    assert all(d == apart[p] <= most for p, d in found.items())
    assert joined(found, len(sketches)) == joined(close, len(sketches))
    for i in {x for p in close for x in p if apart[p] > sure}:
        assert min(d for p, d in found.items() if i in p and d > sure) == min(apart[p] for p in close if i in p and apart[p] > sure)
    if block > len(sketches):
        assert len(found) <= 3 * len(sketches) < len(close) / 4


@pytest.mark.parametrize("cell_bytes", [1 << 19, 4000, 300])
def test_joined_parts_in_cells(spark, cell_bytes):
    """All pairs of different parts of a group are decided by the exact similarity, however a group is cut; of rows that share a doc_id any may be the similar one."""
    draw, rows, members = random.Random(21), [], []
    for group in range(4):
        base = [f"w{draw.randrange(10 ** 6)}" for _ in range(60)]
        for i in range(25 * group, 25 * group + 25):
            words = list(base)
            for place in draw.sample(range(60), draw.choice((1, 1, 2, 3))):
                words[place] = f"x{draw.randrange(10 ** 6)}"
            rows.append((i, " ".join(words[:draw.choice((50, 60, 60))])))
            # Half of the first two groups are one part; in the last group all are parts of their own.
            members.append((25 * group, 25 * group if i % 2 and group < 2 else i, i))
    rows += [(3, ""), (4, None), (3, rows[20][1]), (99, rows[80][1])]
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append({tuple((t or "").split()[k:k + 5]) for k in range(len((t or "").split()) - 4)})
    alike = lambda x, y: len(x & y) >= 0.8 * len(x | y) - 1e-9
    links = [(a, b) for a in range(100) for b in range(a + 1, 100) if a // 25 == b // 25 and any(alike(x, y) for x in sets[a] for y in sets[b])]
    part = {i: p for _, p, i in members}
    frame = spark.createDataFrame(members, "group long, part long, node long")
    got = [tuple(r) for r in simhash.joined_parts(frame, spark.createDataFrame(rows, "doc_id long, text string"), 0.8, cell_bytes).collect()]
    want = joined([(part[a], part[b]) for a, b in links], 100)
    assert joined(got, 100) == want and 4 < len({want[part[i]] for i in range(100)}) < len(set(part.values()))
    assert cell_bytes < 1 << 19 or len(got) < 100


def test_a_large_group_at_the_similarity_lists_no_pairs(spark, monkeypatch):
    """Near copies of one text, each two similar at about 0.8: tables grow with the rows and not with their pairs, and every link is found."""
    draw, counts, written = random.Random(22), {}, simhash.written
    base = [f"w{draw.randrange(10 ** 6)}" for _ in range(150)]
    texts = [" ".join(f"x{draw.randrange(10 ** 6)}" if i in places else w for i, w in enumerate(base))
             for places in (set(draw.sample(range(40, 110), draw.choice((2, 3, 3, 4, 4)))) for _ in range(400))]

    def counted(df, label):
        out = written(df, label)
        counts[label] = max(counts.get(label, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "written", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    sets = [{tuple(t.split()[k:k + 5]) for k in range(146)} for t in texts]
    links = [(a, b) for a in range(400) for b in range(a + 1, 400) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    assert len(links) > 1000 and [got[i] for i in range(400)] == joined(links, 400) and len(set(got.values())) > 10
    assert max(counts[t] for t in ("similar-candidates", "open-pairs", "alike-pairs", "group-members")) <= 10 * 400


def test_rows_without_an_id_stay(spark):
    rows = [(None, "a b c d e f g", 1), (None, "a b c d e f g", 1), (3, "h i j k l m n", 2), (3, "h i j k l m n", 2), (3, "other words stand in here now", 2), (4, "h i j k l m n", 5), (5, "p q r s t u v", 6)]
    left = simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string, _again int"))
    assert left.columns == ["doc_id", "text", "_again"]
    assert sorted(map(tuple, left.collect()), key=str) == sorted([rows[0], rows[1], rows[2], rows[4], rows[6]], key=str)


def test_passages_against_brute_force(spark):
    """Passages that stand whole, edited once, or behind two documents that hold a half each."""
    draw, rows, planted = random.Random(12), [], []
    fill = lambda n: [f"f{draw.randrange(10 ** 9)}" for _ in range(n)]
    for g in range(60):
        passage = [f"p{g}x{draw.randrange(30)}" for _ in range(draw.randrange(56, 90))]
        half = len(passage) // 2
        once = list(passage)
        once[draw.randrange(10, len(once) - 10)] = "edited"
        for k, part in enumerate((passage[:half], passage[half:], passage, passage, once if len(once) > 75 else passage)):
            rows.append((10 * g + k, " ".join(fill(40 + draw.randrange(40)) + part + fill(30 + draw.randrange(40)))))
        planted += [10 * g + 3, 10 * g + 4]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.repeated_passages(docs).collect()
    repeats = {r["doc_id"] for r in found if not r["is_first"]}
    assert repeats <= set(planted)
    assert len(repeats & set(planted)) >= 0.98 * len(planted)
    assert {r["doc_id"] for r in found if r["is_first"]} <= {10 * g + k for g in range(60) for k in (2, 3)}


def test_passages_of_the_first_document(spark):
    """A first document's passages are told apart, and each stands once; a copy repeats its first as a whole."""
    draw = random.Random(13)
    fill = lambda n: " ".join(f"f{draw.randrange(10 ** 9)}" for _ in range(n))
    one, two = fill(60), fill(60)
    rows = [(1, f"{one} {fill(15)} {two}"), (2, f"{one} {fill(40)}"), (3, f"{fill(30)} {two}"), (4, "x " * 70), (5, "x " * 70), (6, "y " * 9), (7, "y " * 9)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r["doc_id"], r["first_doc_id"], r["start_word"], r["end_word"]) for r in found}
    assert got == {(1, 1, 0, 60), (1, 1, 75, 135), (2, 1, 0, 60), (3, 1, 30, 90), (4, 4, 0, 70), (5, 4, 0, 70)}


def test_a_hash_in_many_blocks(spark, monkeypatch):
    """The windows of one hash are compared in blocks, and the firsts of earlier blocks go on."""
    draw = random.Random(14)
    passage = " ".join(f"p{draw.randrange(10 ** 9)}" for _ in range(60))
    texts = [f"{' '.join(f'f{draw.randrange(10 ** 9)}' for _ in range(30))} {passage} end{i}" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").withColumn("digest", F.xxhash64("text"))
    table = pa.Table.from_pandas(passages.windows_of(docs).orderBy("key", "doc", "c").toPandas(), preserve_index=False)
    table = table.cast(pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("digest", pa.int64()), ("c", pa.int32()), ("left", pa.int8()), ("content", pa.binary())]))
    results = []
    for block in (1 << 15, 64):
        monkeypatch.setattr(passages, "BLOCK", block)
        out = pa.Table.from_batches(list(passages._verified(iter(table.to_batches(max_chunksize=50)))))
        results.append({tuple(r.values()) for r in out.to_pylist() if r["first_doc_id"] is not None})
    assert results[0] == results[1] and {r[0] for r in results[0]} == set(range(1, 300)) and {r[2] for r in results[0]} == {0}


def test_windows_that_repeat_others_go_on(monkeypatch):
    """Wherever the blocks of a hash end, each window meets all before it: also those that repeat an earlier one, and for a document's later windows those of its first ones."""
    draw, n = np.random.default_rng(17), 96
    grid = np.zeros((n, passages.REACH), np.uint32)
    for k in range(n):
        # Documents 4g to 4g + 3 drift away from each other; every document has its window three times.
        doc = k // 3
        grid[k] = draw.integers(1, 2**32, passages.REACH, dtype=np.uint64) if k % 12 == 0 else grid[k - 1]
        if k % 12 and k % 3 == 0:
            grid[k, 4 * (doc % 4):passages.REACH:16] = draw.integers(1, 2**32, grid[k, 4 * (doc % 4):passages.REACH:16].size, dtype=np.uint64)
    grid[:, passages.SPAN - 1] = 5
    table = pa.table({"key": np.full(n, 9), "doc": np.arange(n) // 3, "digest": np.zeros(n, np.int64), "c": (100 + 1000 * (np.arange(n) % 3)).astype(np.int32),
                      "left": np.full(n, passages.SPAN - 1, np.int8), "content": pa.array([g.tobytes() for g in grid], pa.binary())})
    results = []
    for block in (1 << 15, 32, 8, 4):
        monkeypatch.setattr(passages, "BLOCK", block)
        out = pa.Table.from_batches(list(passages._verified(iter(table.to_batches(max_chunksize=5)))))
        results.append({tuple(r.values()) for r in out.to_pylist()})
    repeated = {(r[0], r[2]) for r in results[0] if r[2] is not None}
    assert any(i % 4 for _, i in repeated) and any(i % 4 == 0 for _, i in repeated)  # some repeat only a window that itself repeats one
    assert all(r == results[0] for r in results[1:])


@pytest.mark.parametrize("kind", ["alike", "pairs", "drift"])
def test_windows_of_a_hash_against_brute_force(kind):
    """Windows unlike the first that resemble each other, in pairs, or each the one before it: all that repeat an earlier one are found, with the first of them."""
    draw, n = np.random.default_rng(16), 90
    fresh = lambda k: draw.integers(1, 2**32, k, dtype=np.uint64).astype(np.uint32)
    grid, filled = np.zeros((n, passages.REACH), np.uint32), np.ones((n, passages.REACH), bool)
    base = fresh(passages.REACH)
    for k in range(n):
        grid[k] = {"alike": base, "pairs": grid[k - 1] if k % 2 == 0 else fresh(passages.REACH),
                   "drift": np.roll(grid[k - 1], int(draw.integers(0, 2))) if k > 1 else base}[kind] if k else fresh(passages.REACH)
        grid[k, draw.integers(0, passages.REACH, 6 if kind == "drift" else 12)] = fresh(1)
        filled[k, :draw.integers(0, 40)] = False
        filled[k, passages.REACH - draw.integers(1, 40):] = False
    grid[:, passages.SPAN - 1], filled[:, passages.SPAN - 1] = 5, True
    rows = passages._Rows(np.full(n, 9), np.arange(n) // 2 if kind == "alike" else np.arange(n), np.zeros(n, np.int64), np.full(n, 100, np.int32), grid, filled)

    def good(j, i):
        held = set(grid[i][filled[i]].tolist())
        hit = [bool(f) and int(x) in held for x, f in zip(grid[j], filled[j], strict=True)]
        return any(sum(hit[k:k + passages.SPAN]) >= passages.NEED for k in range(passages.REACH - passages.SPAN + 1))

    want = {j: next((i for i in range(j) if rows.docs[i] < rows.docs[j] and good(j, i) and good(i, j)), None) for j in range(n)}
    found = np.concatenate([np.stack(x) for x in passages.repeats(rows)], axis=1)
    assert dict(zip(found[0].tolist(), found[1].tolist(), strict=True)) == {j: i for j, i in want.items() if i is not None}
    assert 0 < found.shape[1] < n
    again = [np.stack(x) for x in passages.repeats(rows, n)]
    assert not again or not np.concatenate(again, axis=1).size  # known firsts are not compared again


def test_strip_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a " * 60, 5, 6, 7), (2, "a " * 60, 5, 6, 7), (None, None, None, None, None)],
                                 "doc_id long, text string, spans int, digest int, _doc int")
    out = passages.strip(docs, passages.repeated_passages(docs))
    assert out.columns == docs.columns
    assert {(r["doc_id"], r["text"], r["spans"], r["digest"]) for r in out.collect()} == {(1, "a " * 60, 5, 6), (2, "", 5, 6), (None, None, None, None)}


def test_repeats_behind_an_unlike_first(spark):
    """A first document that shares only part of a passage does not hide the exact repeat of two later ones."""
    rows = []
    for g in range(12):
        words = [f"w{g}x{i}" for i in range(60)]
        broken = [f"y{g}z{i}" if i % 25 == 12 else w for i, w in enumerate(words)]
        filler = lambda d: " ".join(f"f{g}d{d}i{i}" for i in range(60))  # noqa: B023, E731
        for d, passage in ((0, broken), (1, words), (2, words)):
            rows.append((10 * g + d, f"{filler(d)} {' '.join(passage)} {filler(d + 5)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["first_doc_id"]) for r in passages.repeated_passages(docs).collect() if not r["is_first"]}
    assert {(10 * g + 2, 10 * g + 1) for g in range(12)} == found
