"""Backtracking encoder against the sentencepiece library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from versespark.llm import pieces, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model_path())


@pytest.fixture(scope="module")
def coder():
    return pieces.PieceCoder(queries.piece_model_path())


def texts_from(library):
    draw, vocabulary = random.Random(2), [library.id_to_piece(i) for i in range(3, library.get_piece_size())]
    out = [None, "", " ", "   \n\t ", "▁", "a▁ b", " " * 100, "x" * 5000, "<s></s><unk><0x0A>", "\x00\x01", "漢字😀", "é́" * 50, "a" * 31 + "b" * 17,
           "▁" * 77 + "t", "  " * 9 + "the", "ﬁ①Ａ\x85\xa0 ", "no\x0bbreak  space ", "".join(draw.choice("abcdefgh") for _ in range(20_000))]
    for _ in range(400):
        out.append("".join(draw.choice(vocabulary) for _ in range(draw.randint(1, 30))))
        out.append("".join(draw.choice(" ▁aenrst\n") for _ in range(draw.randint(1, 60))))
        out.append("".join(chr(draw.choice([draw.randint(1, 127), draw.randint(128, 0x2FFF), draw.randint(0x10000, 0x1FFFF)])) for _ in range(draw.randint(1, 40))))
    return out


def test_operator_against_the_library(spark, library):
    texts = texts_from(library)
    rows = [(i, t, "old", 3) for i, t in enumerate(texts)] + [(None, "null id", "", 0), (7, "x" * 5000, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, place long").repartition(3)
    got = pieces.encode(docs, queries.piece_model_path()).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "place", "n_tokens", "ids", "packed", "decoded"}
    for r in got:
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids), r["text"]
        assert np.frombuffer(r["packed"], "<u4").tolist() == ids
    assert pieces.encode(docs.limit(0), queries.piece_model_path()).count() == 0


def test_query_against_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.op12_backtracking_pieces(spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab▁ehtrsn\né", max_size=40))
def test_cut_is_what_merging_makes(coder, text):
    assert coder.cut(text) == coder.merged(text)


def test_backtracking_gives_up_longest_pieces(coder):
    """Texts whose longest first piece is wrong, so that places fail and pieces before are given up."""
    draw, wrong = random.Random(4), 0
    for _ in range(1500):
        text = "".join(draw.choice(coder.made) for _ in range(4))
        cut = coder.cut(text)
        longest = max((p for p in coder.made if text.startswith(p)), key=len)
        wrong += cut[0] != longest
        assert cut == coder.merged(text)
    assert wrong > 20


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(queries.piece_model_path(), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="merge-type"):
        pieces.PieceCoder(str(tmp_path / "m"))
