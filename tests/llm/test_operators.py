"""The training-data operators on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from versespark.llm import bpe, common, decontaminate, html, language, licenses, passages, quality, queries, sharding, simhash, toxicity

DATA = "/root/testdata/sf0.001"
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne", "pu", "ra") for b in ("tu", "si", "ven", "dor") for c in ("", "n", "la", "rek", "x")]


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """(doc_id, text, lang, source, n_chars) with every odd case, and columns whose names clash with internal ones."""
    long = prose(1, 60_000)
    texts = [None, "", "   \n\t ", "word", "!!! ###", "Ünïcode  words", "no\x0bbreak space", long, long,
             prose(2, 300), prose(2, 300), "x" * 50_000, prose(3, 120) + "\n" + prose(3, 120), "<|endoftext|> a <b> & c"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", len(t) if t else None, "clash", i) for i, t in enumerate(texts)]
    rows += [rows[9], (None, "null id " + prose(4, 80), "en", "s", 5, "clash", 0), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, node long").cache()


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


# 1 ---------------------------------------------------------------------------------------------------------------
PAGE = """<html><head><title>T</title><style>p{}</style><script>x="<p>no</p>"</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>  text<br>goes&nbsp;on<p>Second &lt;p&gt; %s
<aside>Side</aside><form><input name=q>Search</form><figure><figcaption>Caption</figcaption></figure></article>
<section id="comments"><article class="comment"><p>I disagree</p></article></section><!-- <p>gone</p> --><footer>&copy; x</footer></body>"""


def test_page_text(spark):
    rows = [(1, "http://a.b/x", PAGE % "end"), (2, None, None), (3, "http://a.b/y", ""), (4, "bad url", "<p>plain"), (1, "http://a.b/x", PAGE % "end")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = defaultdict(list)
    for r in got:
        texts[r["page_id"]].append(r["text"])
    assert texts[1] == ["Title & more\n\nFirst bold text goes on\n\nSecond <p> end\n\nCaption"] * 2
    assert (texts[2], texts[3], texts[4]) == ([""], [""], ["plain"])


def test_adverts_and_notices_inside_an_article():
    inside = ('<article><p>Two</p><div class="ad">Buy</div><div class="banner">B</div><div class="alert">A</div><section class="subscription">S</section>'
              '<div id="respond">Leave a reply</div><p class="alert">Kept</p><h2 class="banner">Kept too</h2></article>')
    assert html.Page(inside).extracted(set()) == ("Two\n\nKept\n\nKept too", 0, 5)
    assert html.Page('<div class="modal-dialog">x</div><div class="note">n</div><p>text').extracted(set()) == ("text", 0, 2)
    assert html.Page('<div class="comments"><article><p>c</p></article></div>').text(set()) == ""
    assert html.Page('<div class="sidebar"><article><p>c</p></article></div>').text(set()) == "c"


def test_recurrence_decides_before_signs(spark):
    """Menus, adverts and footers that stand on many pages of their host go by recurrence; what changes goes by its sign; the report tells them apart."""
    page = '<nav><a>Home</a></nav><div class="advert">Buy now</div><div class="promo">Deal %d</div><article><p>%s</p></article><footer>Legal</footer>'
    rows = [(i, f"http://h.example/{i}", page % (i, prose(i, 30))) for i in range(6)] + [(9, "http://single.example/", page % (9, "one page"))]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all((got[i]["text"], got[i]["n_recurring"], got[i]["n_signed"]) == (prose(i, 30), 3, 1) for i in range(6))
    assert (got[9]["text"], got[9]["n_recurring"], got[9]["n_signed"]) == ("one page", 0, 4)


@pytest.mark.parametrize("make", [lambda n: "<div class='x'>" * n + "t" + "</div>" * n, lambda n: "<p>t" + "</span>" * n, lambda n: "<article>" * n + "t",
                                  lambda n: "<div><b class=q>" * n + "t</i>" * n, lambda n: "<li class=a><span class=b>" * n])
def test_deep_nesting_takes_linear_time(make):
    import time

    times = []
    for n in (4_000, 16_000):
        began = time.perf_counter()
        html.Page(make(n)).text(set())
        times.append(time.perf_counter() - began)
    assert times[1] < 10 * times[0] + 0.3


def test_template_removal_without_signs(spark):
    """Blocks that recur on different pages of a host go, copies of one page do not count, other hosts keep theirs."""
    body = lambda i: f"<body><div class=top><p>Buy our goods now</p></div><div><p>{prose(i, 40)}</p></div></body>"
    rows = [(i, f"https://shop.example/{i}", body(i)) for i in range(6)] + [(10 + i, f"https://copy.example/{i}", body(50)) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == prose(i, 40) for i in range(6))
    assert all(got[10 + i] == "Buy our goods now\n\n" + prose(50, 40) for i in range(6))


def test_page_oddities(spark):
    for text in ("<" * 3000, "<p" + ' a="' * 500, "<!-- open", "<div>" * 3000 + "deep", "</p></div>", "<script>never closed", "a < b and c > d"):
        html.Page(text).text(set())
    assert html.Page("<div>" * 3000 + "deep").text(set()) == "deep"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract(empty).count() == 0


# 2 ---------------------------------------------------------------------------------------------------------------
def brute_quality(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i:i + 8])].append(i)
    covered = {j for places in windows.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality(spark, odd):
    kept = quality.cascade(odd, sample_rows=5)
    q = F.col("_q")
    rows = kept.select("text", q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"], "rejected_by", "key").collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert tuple(r[1:6]) == brute_quality(r["text"])
        failed = r[1] < 20 or 100 * r[5] > 30 * r[1]
        assert not failed or r["rejected_by"]
    assert any(r["rejected_by"] is None for r in rows)
    assert quality.cascade(odd.limit(0)).count() == 0


# 3 ---------------------------------------------------------------------------------------------------------------
def brute_windows(values, span):
    """Every node of the Cartesian tree, by definition."""
    out = []
    for c, v in enumerate(values):
        left = c
        while left and values[left - 1] > v:
            left -= 1
        right = c
        while right + 1 < len(values) and values[right + 1] >= v:
            right += 1
        if right - left + 1 >= span:
            out.append((c, left, right))
    return out


def test_compact_windows():
    draw = random.Random(5)
    for n, top in ((0, 9), (45, 9), (46, 9), (400, 1 << 60), (400, 5), (400, 1)):
        values = np.array([draw.randrange(top) for _ in range(n)], np.uint64)
        got = list(zip(*(x.tolist() for x in passages.compact_windows(values)), strict=True))
        assert got == brute_windows(values.tolist(), passages.SPAN)


def test_repeated_passages(spark, odd):
    shared, near = prose(100, 80), prose(101, 120).split()
    edited = near.copy()
    edited[60] = "changed"
    rows = [(i, f"{prose(200 + i, 150)} {shared} {prose(300 + i, 90)}") for i in (1, 2, 3)]
    rows += [(10, f"{prose(400, 70)} {' '.join(near)}"), (11, f"{' '.join(edited)} {prose(401, 70)}"), (20, prose(500, 400)), (21, shared[:200])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.repeated_passages(docs).collect()
    assert {r["doc_id"] for r in found} == {1, 2, 3, 10, 11}
    for r in found:
        assert r["is_first"] == (r["doc_id"] == r["first_doc_id"])
        assert r["first_doc_id"] == (1 if r["doc_id"] < 10 else 10)
        if r["doc_id"] < 10 and not r["is_first"]:
            assert 150 - 1 <= r["start_word"] <= 151 and 229 <= r["end_word"] <= 231
    kept = texts_of(passages.strip(docs, passages.repeated_passages(docs)))
    assert shared in kept[1] and shared[:100] not in kept[2] and prose(202, 150)[:-8] in kept[2] and kept[20] == prose(500, 400)
    twice = docs.unionByName(spark.createDataFrame([(2, "another text of the same doc_id")], docs.schema))
    assert [r["text"] for r in passages.strip(twice, passages.repeated_passages(twice)).where("doc_id = 2").orderBy("text").collect()] == [
        "another text of the same doc_id", kept[2]]
    cleaned = passages.strip(odd, passages.repeated_passages(odd))
    assert cleaned.columns == odd.columns and cleaned.count() == odd.count()
    assert passages.repeated_passages(odd.limit(0)).count() == 0


# 4 ---------------------------------------------------------------------------------------------------------------
def test_sharding(spark, odd, tmp_path):
    docs = odd.select("doc_id", "key", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).unionByName(
        spark.range(500).selectExpr("0 AS doc_id", "'same' AS key", "1000 AS size"))
    out = sharding.shuffled(docs, ["doc_id"], n_shards=7, bucket_bytes=1 << 10).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert len(out) == docs.count() and set(slots) == set(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shuffled(docs, ["doc_id"], n_shards=7, bucket_bytes=1 << 10).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert sharding.shuffled(docs.limit(0), ["doc_id"]).count() == 0
    sharding.write_shards(docs, ["doc_id"], f"{tmp_path}/shards", n_shards=3)
    assert spark.read.parquet(f"{tmp_path}/shards").count() == docs.count()
    table, n = sharding.scatter(docs, ["doc_id"], 42, 1 << 10)
    assert n > 8 and {r["bucket"] for r in table.collect()} <= set(range(n))
    counts = [(b, 3 + b % 5) for b in range(0, 95) if b % 9]
    got = {r["bucket"]: r["offset"] for r in sharding.offsets_of(spark.createDataFrame(counts, "bucket int, n long"), 95).collect()}
    assert got == {b: sum(x for c, x in counts if c < b) for b, _ in counts}


# 5 ---------------------------------------------------------------------------------------------------------------
def brute_tiles(item, text, least):
    """Greedy string tiling by its definition: the longest unmarked match again and again."""
    used, taken, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and p + n not in used and t + n not in taken:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        if best[0] < least:
            return total
        used |= set(range(best[1], best[1] + best[0]))
        taken |= set(range(best[2], best[2] + best[0]))
        total += best[0]


def test_tiling_against_brute_force():
    draw = random.Random(9)
    for _ in range(60):
        item = [draw.randrange(4) for _ in range(draw.randrange(3, 30))]
        text = [draw.randrange(4) for _ in range(draw.randrange(0, 60))]
        got = decontaminate.tiles(np.array(item, np.uint64), np.array(text, np.uint64), np.zeros(len(text), bool), 3)
        for p, t, n in got:
            assert item[p:p + n] == text[t:t + n] and n >= 3
        assert len({p + i for p, _, n in got for i in range(n)}) == sum(n for _, _, n in got)
        assert sum(n for _, _, n in got) == brute_tiles(item, text, 3)


def test_decontamination(spark, odd):
    item = prose(700, 40)
    half = item.split()
    swapped = " ".join(half[20:] + half[:20])
    docs = spark.createDataFrame([(1, f"{prose(1, 50)} {item} {prose(2, 50)}"), (2, f"{prose(3, 50)} {swapped}."), (3, prose(4, 200)),
                                  (4, " ".join(half[:15]) + " " + prose(5, 50)), (5, item.upper().replace(" ", ",\n"))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "too short"), (7, item)], "item_id long, text string")
    rows = decontaminate.matches(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["coverage"]) for r in rows) == [(1, 7, 1.0), (2, 7, 1.0), (5, 7, 1.0)]
    assert sorted(texts_of(decontaminate.clean(docs, bench))) == [3, 4]
    assert decontaminate.matches(odd, bench).count() == 0 and decontaminate.clean(odd, bench).count() == odd.count()
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0


# 6 ---------------------------------------------------------------------------------------------------------------
def test_covering_masks():
    masks = simhash.masks(64, 2)
    draw = random.Random(3)
    assert len(masks) == 7
    for _ in range(500):
        differing = sum(1 << i for i in draw.sample(range(64), 2))
        assert any(not differing & m for m in masks)


def test_simhash_components(spark, odd):
    """All pairs within the radius, by brute force, for small and large buckets."""
    draw = random.Random(4)
    base = draw.getrandbits(64)
    prints = {draw.getrandbits(64) for _ in range(40)} | {base}
    for _ in range(120):
        prints.add(draw.choice(sorted(prints)) ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)))
    nodes = sorted(prints)
    df = spark.createDataFrame([(i, [simhash.signed(p)]) for i, p in enumerate(nodes)], "node long, fps array<long>")
    parent = list(range(len(nodes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(nodes)):
        for j in range(i):
            if (nodes[i] ^ nodes[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    for pairwise in (1, 1000):
        got = {r["node"]: r["component"] for r in common.components(simhash.links(df, pairwise=pairwise)).collect()}
        assert [got.get(i, i) for i in range(len(nodes))] == [root(i) for i in range(len(nodes))]
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    zero = {r["component_id"] for r in rows if r["fp"] == 0}
    assert zero == {1 - 1}


def test_similar_documents(spark, odd):
    rows, groups = [], 40
    for g in range(groups):
        words = [f"w{random.Random(g).randrange(10**9)}x{i}" for i in range(200)]
        rows.append((10 * g, " ".join(words)))
        words[50] = words[120] = "edited"
        rows.append((10 * g + 1, " ".join(words)))
        rows.append((10 * g + 2, " ".join(f"v{g}y{i}" for i in range(200))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = set(texts_of(simhash.first_of_each(docs)))
    assert {10 * g for g in range(groups)} | {10 * g + 2 for g in range(groups)} <= kept
    assert len([g for g in range(groups) if 10 * g + 1 in kept]) <= 1
    left = simhash.first_of_each(odd)
    assert left.columns == odd.columns and simhash.first_of_each(odd.limit(0)).count() == 0
    assert {7, 9} <= set(texts_of(left)) and not {8, 10} & set(texts_of(left))


# 7 ---------------------------------------------------------------------------------------------------------------
def brute_licences(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    places = [(i, label) for i in range(len(words)) for phrase, label in licenses.PHRASES.items() if words[i:i + len(phrase.split())] == phrase.split()]
    base = {label for _, label in places}
    labels, best = set(base), 1.0 if places else 0.0
    for block in re.split(r"\n[\x00-\x2F\x3A-\x60\x7B-\x7F]*\n", text or ""):
        held = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", block.lower())
        for label, wanted in licenses.template_words(licenses.TEMPLATES + licenses.WHOLE_TEXTS):
            size = 2 * len(wanted)
            share = max((len(set(held[i:i + size]) & set(wanted)) for i in range(len(held)) if held[i] in wanted), default=0) / len(wanted)
            if share >= licenses.CONTAINMENT - 1e-9:
                labels.add(label)
                best = max(best, share)
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best)


def test_licence_scan(spark, odd):
    lines = [t for _, t in licenses.TEMPLATES] + ["cc by cc by, CC-BY", "ALL rights  reserved!", "Released by us under the fine MIT open License",
                                                 "general\npublic\nlicense", "Licensed under Apache License 2.0 the", "rights reserved"]
    rows = [(i, f"{prose(i, 10)}\n{t}\n{prose(i + 50, 10)}") for i, t in enumerate(lines)] + [(99, " ".join(lines)), (99, " ".join(lines))]
    draw = random.Random(7)
    for i, (_, t) in enumerate(licenses.TEMPLATES + licenses.WHOLE_TEXTS):
        w = t.split()
        scattered = [x for word in w for x in [word, *prose(draw.randrange(10**6), 40).split()]]
        some = [x for x in w if draw.random() < 0.93]
        wrapped = "\n".join(" ".join(w[k:k + 5]) for k in range(0, len(w), 5))
        rows += [(200 + 4 * i, " ".join(scattered)), (201 + 4 * i, "\n".join(scattered)), (202 + 4 * i, f"{prose(i, 30)} {' '.join(some)} {prose(i, 9)}"),
                 (203 + 4 * i, f"{prose(i, 30)}\n \n{wrapped}\n\n{prose(i, 9)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    got = sorted((tuple(r[1:7]) + (round(r[7], 9),) for r in licenses.scan(docs).collect()), key=str)
    want = sorted((brute_licences(r["text"])[:6] + (round(brute_licences(r["text"])[6], 9),) for r in docs.collect()), key=str)
    assert got == want
    assert licenses.scan(docs.limit(0)).count() == 0
    by = {r["doc_id"]: (r["base_labels"], r["labels"]) for r in licenses.scan(docs).collect()}
    for i, (label, _) in enumerate(licenses.TEMPLATES + licenses.WHOLE_TEXTS):
        assert label in by[203 + 4 * i][1].split(",")
        assert by[200 + 4 * i][0] == by[200 + 4 * i][1] and by[201 + 4 * i][0] == by[201 + 4 * i][1]  # scattered words are no statement


# 8 ---------------------------------------------------------------------------------------------------------------
def test_toxicity(spark, odd):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = prose(i, 60).split()
        if bad:
            for k in range(3):
                words.insert(10 + 15 * k, random.Random(i + k).choice(["you vilething", "gribblewit", "grottomouth"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, marks).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((scored[i] >= 0.5) == (i % 4 == 0) for i in held)
    assert right >= 0.95 * len(held) and all(0 <= s <= 1 for s in scored.values())
    more = toxicity.score(odd.select("doc_id", "text"), marks.limit(0)).collect()
    assert len(more) == odd.count() and len({r["score"] for r in more}) == 1
    wide = toxicity.score(docs.unionByName(odd.select("doc_id", "text")), marks).collect()
    assert len(wide) == docs.count() + odd.count() and all(r["score"] is not None for r in wide)


# 9 ---------------------------------------------------------------------------------------------------------------
def test_bpe_equals_the_library(spark, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    tokenizer.no_padding()
    tokenizer.no_truncation()
    texts = ["İstanbul ΣΑΣ Ǆ", "it's I'LL we'Ve don’t", "12³½ ٣٤", "é Å ﬁ", "😀😀 ####!!!!", "a" * 3000 + " " + "xyz" * 900, "<|endoftext|> x<|startoftext|>Y <|END|>",
             "한국어 中文 ไทย हिन्दी", "\x00\x01 a\x7f", "a\x1cb\x85c", "ẞ ß K"]
    docs = spark.createDataFrame(list(enumerate(texts, 1000)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    for r in bpe.encode(docs, queries.tokenizer_path()).collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids"], r["decoded"]) == (len(ids), " ".join(map(str, ids)), tokenizer.decode(ids, skip_special_tokens=False))


def test_bpe_query(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    texts = texts_of(common.read(spark, DATA, "documents"))
    for r in queries.op9_segment_tree_bpe(spark, DATA).collect():
        ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


# 10 --------------------------------------------------------------------------------------------------------------
def test_language(spark, odd):
    docs = common.read(spark, DATA, "documents")
    got = language.identify(docs).where(language.fold(F.col("doc_id")) == 1).where("length(text) > 200")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()
    fitted = language.fit(docs.where(language.fold(F.col("doc_id")) != 1))
    rows = language.classify(odd, fitted).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if not re.search(r"[^\W\d_]", r["text"] or "")} == {"und"}
    assert all(r["lang_pred"] == "und" for r in language.classify(odd, {}).collect())
    assert language.fit(docs.limit(0)) == {} and language.classify(odd.limit(0), fitted).count() == 0


# pipeline --------------------------------------------------------------------------------------------------------
def test_pipeline(spark, odd):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = common.read(spark, DATA, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert name == "tokens" or out.columns == docs.columns
        docs = common.written(out, name)
        assert 0 < docs.count() <= before
    docs = odd.drop("key", "node")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, DATA), "odd")
    empty = common.read(spark, DATA, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = common.written(stage(spark, empty, DATA), "empty")
        assert empty.count() == 0
