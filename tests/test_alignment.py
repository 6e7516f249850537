"""Several alignments a pair, chains of hits, and frequent n-grams, against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from versespark.functions.chunking import chunked, chunked_with_offsets
from versespark.operators import alignment, reuse


def declumped(a: str, b: str, least: int) -> list[tuple]:
    """Cell by cell: the best local alignment, then the best without any of its cells, and so on."""
    out, blocked = [], set()
    while True:
        table, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], (0, 0, 0)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                if (i, j) not in blocked:
                    table[i][j] = max(0, table[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), table[i - 1][j] - 2, table[i][j - 1] - 2)
                    if table[i][j] > best[0]:
                        best = table[i][j], i, j
        score, i, j = best
        x, y, cells = [], [], []
        while table[i][j] > 0:
            cells.append((i, j))
            if table[i][j] == table[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1):
                i, j = i - 1, j - 1
                x.append(a[i])
                y.append(b[j])
            elif table[i][j] == table[i - 1][j] - 2:
                i -= 1
                x.append(a[i])
                y.append("-")
            else:
                j -= 1
                x.append("-")
                y.append(b[j])
        if len(x) < least or score < least:
            return out
        out.append((i, j, "".join(x[::-1]), "".join(y[::-1]), score))
        blocked |= set(cells)


@pytest.mark.parametrize("cells", [1 << 22, 3000])
@pytest.mark.parametrize("least", [1, 3, 8])
def test_all_alignments_of_stacked_pairs(monkeypatch, cells, least):
    monkeypatch.setattr(alignment, "CELLS", cells)
    draw, pairs = random.Random(least), []
    for _ in range(120):
        a, b = ("".join(draw.choice("abcdé😀") for _ in range(draw.randrange(0, 25))) for _ in range(2))
        pairs.append((a, b[:5] + a[3:20] + b[5:] + a[2:15]) if draw.random() < 0.6 else (a, b))
    got = alignment.local_alignments(pairs, least)
    for (a, b), some in zip(pairs, got, strict=True):
        assert [(x.begin, x.begin2, x.alg, x.alg2, x.score) for x in some] == declumped(a, b, least)
        assert all(x.equal == sum(p == q for p, q in zip(x.alg, x.alg2, strict=True)) for x in some)
    assert [x[:1] for x in got] == alignment.local_alignments(pairs, least, 1)


def test_best_chain_against_all_predecessors():
    draw = random.Random(3)
    for _ in range(200):
        gap = draw.choice([5, 40])
        hits = sorted({(draw.randrange(60), draw.randrange(20)) for _ in range(draw.randrange(1, 40))})
        points = []
        for k, (c, v) in enumerate(hits):
            before = [points[j] - (c - hits[j][0]) - (v - hits[j][1]) for j in range(k) if hits[j][0] < c and hits[j][1] < v]
            points.append(2 * gap + max([0, *before]))
        found = alignment.chains(hits, gap, 1)
        assert sorted(h for chain in found for h in chain) == hits
        assert all(p[0] < q[0] <= p[0] + gap and p[1] < q[1] for chain in found for p, q in zip(chain, chain[1:], strict=False))
        if gap == 40:  # hardly ever cut, so one of them is the best
            worth = lambda chain: 2 * gap * len(chain) - (chain[-1][0] - chain[0][0]) - (chain[-1][1] - chain[0][1])
            assert max(map(worth, found)) >= max(points) - gap
    assert alignment.chains([(c + o, c) for o in (10, 500) for c in range(40)], 350, 3) == [[(c + o, c) for c in range(40)] for o in (10, 500)]
    assert alignment.chains([(1, 1), (2, 2)], 350, 3) == []


WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in ("a", "e", "io") for c in ("nd", "rk", "st", "lle", "m")]


def words(draw: random.Random, n: int) -> str:
    return " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(3, 9))) for _ in range(n))


def test_a_verse_twice_in_a_chunk(spark):
    draw = random.Random(7)
    verse, other = words(draw, 12), words(draw, 15)
    text = f"{words(draw, 3)} {verse} {words(draw, 4)} {verse[:-5]}xyz {words(draw, 2)}"
    chunks = spark.createDataFrame([("p", 0, 0, len(text), text)], "problem_id string, chunk_index int, chunk_start int, chunk_end int, text string")
    bible = spark.createDataFrame([("gen_1:1", verse), ("gen_1:2", other)], "reference string, text string")
    rows = reuse.flatten_output(reuse.detect(chunks, bible, reuse.ReuseOptions())).orderBy("aligned_chunk_start").collect()
    assert [(r["reference"], text[r["aligned_chunk_start"]:r["aligned_chunk_end"]].strip()) for r in rows] == [("gen_1:1", verse), ("gen_1:1", verse[:-5])]
    assert reuse.best_pairs(reuse.flatten_output(reuse.detect(chunks, bible, reuse.ReuseOptions()))).first()["score"] == len(verse)


def test_full_texts_find_what_chunks_find(spark):
    """Texts of 20,000 words, verses planted whole, edited, in halves and in a row; only stretches around chains are aligned."""
    draw = random.Random(8)
    verses = [(f"gen_1:{i + 1}", words(draw, draw.randrange(8, 25))) for i in range(30)]
    rows, truth = [], set()
    for i in range(4):
        parts = [words(draw, 1000) for _ in range(20)]
        for k in range(12):
            ref, text = verses[(7 * i + k) % 30]
            w = text.split()
            parts[k] += " " + [text, " ".join([*w[:3], "other", *w[4:]]), f"{text} {text} {text}", " ".join(w[:len(w) // 4])][k % 4]
            if k % 4 != 3:
                truth.add((f"p{i}", ref))
        rows.append((f"p{i}", " ".join(parts)))
    problems, bible = spark.createDataFrame(rows, "problem_id string, text string"), spark.createDataFrame(verses, "reference string, text string")
    for mode in ({"mode": "char", "char_size": 100, "char_overlap": 50, "min_chars": 25}, {"mode": "full"}):
        flat = reuse.flatten_output(reuse.detect(chunked_with_offsets(problems, **mode), bible, reuse.ReuseOptions())).cache()
        assert {(r["problem_id"], r["reference"]) for r in reuse.best_pairs(flat).collect()} == truth, mode
    thrice = flat.groupBy("problem_id", "reference").count().where("count >= 3").count()
    assert thrice == 12  # every verse that stands three times in a row has its three alignments


def test_frequent_grams_without_a_cut(spark, monkeypatch):
    """Exact pairs where some n-grams stand in all texts, whether their texts are dealt into groups or not."""
    draw = random.Random(9)
    chunks = [("c%d" % i, "task", "all of them say this and " + " ".join(draw.choice(WORDS) for _ in range(6))) for i in range(150)]
    chunks += [("short", "task", "all of the"), ("none", "task", ""), ("null", "task", None)]
    verses = [("v%d" % i, "bible", " ".join(draw.choice(WORDS) for _ in range(5)) + (" all of them say this" if i % 2 else "")) for i in range(20)]
    rows = spark.createDataFrame(chunks + verses, "id string, group string, text string")
    n, grams = 5, lambda t: {t[i:i + 5] for i in range(len(t or "") - 4)}
    want = {(v, c, len(grams(t) & grams(u))) for v, _, t in verses for c, _, u in chunks if len(grams(t) & grams(u)) >= 3}
    held = reuse.verse_grams(rows, n)
    for postings in (10_000, 7):
        monkeypatch.setattr(reuse, "POSTINGS", postings)
        options = reuse.ReuseOptions(n=n, max_df=0)
        assert {tuple(r) for r in reuse.candidate_pairs(held, options).collect()} == want
        hits = {(r["verse"], r["chunk"]): sorted(r["hits"]) for r in reuse.pair_hits(held, options).collect()}
        bounded = {(r["verse"], r["chunk"]): sorted(r["hits"]) for r in reuse.pair_hits(held, reuse.ReuseOptions(n=n, max_df=10**6)).collect()}
        assert hits == bounded and hits.keys() == {w[:2] for w in want}
    assert len(want) > 1000
    assert {tuple(r) for r in reuse.candidate_pairs(held, reuse.ReuseOptions(n=n, max_df=0, min_match=1)).collect()} == {
        (v, c, len(grams(t) & grams(u))) for v, _, t in verses for c, _, u in chunks if grams(t) & grams(u)}


def test_windows_of_long_texts(spark):
    """Windows are those of plain slicing, also where a text is longer than the stretches it is first cut into."""
    draw = random.Random(10)
    texts = ["".join(draw.choice("ab é😀\n") for _ in range(n)) for n in (0, 1, 3, 64, 65, 129, 5000, 9000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "problem_id string, text string")
    for size, overlap in ((4, 2), (3, 0), (2, 5)):
        step = max(1, size - overlap)
        got = chunked_with_offsets(rows, "char", char_size=size, char_overlap=overlap, min_chars=0).groupBy("problem_id").agg(
            F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_start", "text"))).alias("x"))
        for r in got.collect():
            text = texts[int(r["problem_id"])]
            pieces = [text[i:i + size] for i in range(0, len(text), step)]
            assert [x["text"] for x in r["x"]] == [p.strip() for p in pieces]
            assert [x["chunk_start"] for x in r["x"]] == [i * step + (len(p) - len(p.lstrip()) if p.strip() else 0) for i, p in enumerate(pieces)]
        assert chunked(rows, "char", char_size=size, char_overlap=overlap, min_chars=1).count() == sum(
            bool(t[i:i + size].strip()) for t in texts for i in range(0, len(t), step))
