"""Grammar-compressed runs against a search over all periods."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from versespark.llm import periodic, queries

DATA = "/root/testdata/sf0.001"


def brute(words):
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def digest_row(doc_id, text, fold=True):
    """One row of the query, word by word as its contract says."""
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if fold and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def test_query_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r[0]: tuple(r[1:]) for r in queries.op13_periodic_runs(spark, DATA).collect()}
    assert got.keys() == texts.keys() and sum(r[0] > 0 for r in got.values()) > 5
    for doc_id, text in texts.items():
        if len((text or "").split()) < 3000:
            assert got[doc_id] == digest_row(doc_id, text), doc_id


def test_operator_on_odd_rows(spark):
    texts = [None, "", " \n\t ", "a", "a a a a a a", "a a a a a", "x a b a b a b a b y", "no\x0bbreak é é é é é é", "w " * 5000, "w" * 50_000, "a b c " * 9 + "z " + "b c a " * 4, "a a a a a a"]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "q q q q q q q", "", 2), (3, "a", "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, start long").repartition(2)
    got = periodic.detect(docs)
    assert got.columns == ["doc_id", "text", "start", "runs", "collapsed"] and got.count() == len(rows)
    for r in got.collect():
        words = (r["text"] or "").encode().split()
        runs = brute(words)
        assert [tuple(x) for x in r["runs"]] == runs, r["text"]
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        assert r["collapsed"] == b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
    assert periodic.detect(docs.limit(0)).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 12), st.integers(1, 7), st.lists(st.integers(0, 2), max_size=40))
def test_runs_of_small_alphabets(head, period, times, tail):
    words = head + (head or [0])[:period] * times + tail
    assert periodic.runs(words) == brute(words)
    assert periodic.runs_of([[b"1"], [b"%d" % w for w in words], [b"0"] * period]) == [[], brute(words), brute([0] * period)]


def test_grammar_gives_the_text_back():
    draw = random.Random(1)
    for n in (0, 1, 2, 7, 300):
        words = [draw.randrange(4) for _ in range(n)] * 2
        rules, left, base = periodic.grammar(words)

        def spread(symbol, rules=rules, base=base):
            return [symbol] if symbol < base else [w for s in rules[symbol - base] for w in spread(s)]

        assert [w for s in left for w in spread(s)] == words
        pairs = list(zip(left, left[1:], strict=False))
        assert all(pairs.count(p) == 1 or p[0] == p[1] for p in pairs)


def test_ties_and_exponents(spark):
    """Equal exponents: the smallest start; exact ratios, not rounded ones."""
    rows = [(1, "a a a a a a x b b b b b b"), (3, "a b " * 4 + "x " + "c " * 6), (4, "a " * 6 + "y " + "b c " * 13)]
    import pyspark.sql.functions as F

    frame = periodic.detect(spark.createDataFrame(rows, "doc_id long, text string"))
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a))
    got = {r["doc_id"]: tuple(r["b"]) for r in frame.select("doc_id", best.alias("b")).collect()}
    assert got == {1: (0, 6, 1), 3: (9, 6, 1), 4: (7, 26, 2)}


@pytest.mark.parametrize("make", [lambda n: [0] * n, lambda n: [i % 1000 for i in range(n)], lambda n: [x for k in range(2, n // 100) for x in range(k)][:n]])
def test_long_texts_take_linear_time(make):
    times = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        periodic.runs(make(n))
        times.append(time.perf_counter() - began)
    assert times[1] < 12 * times[0] + 1
