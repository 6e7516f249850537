"""Model calls are made once each, and a stopped job goes on."""

from __future__ import annotations

import pytest

from versespark.operators import knn, ledger, responses


def calls(folder) -> list[str]:
    return sorted(p.read_text() for p in folder.iterdir())


def test_calls_are_made_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def complete(system, human):
        import uuid

        (log / uuid.uuid4().hex).write_text(human)
        if human == "fail" and not (tmp_path / "mended").exists():
            raise RuntimeError("no answer")
        return f"{system}:{human}"

    rows = [("a", 0, "s", "x"), ("a", 1, "s", "y"), ("b", 0, "s", "x"), ("b", 1, "s", "fail"), ("c", 0, None, None), ("c", 1, "s", "")]
    frame = spark.createDataFrame(rows, "problem_id string, chunk_index int, system string, human string").repartition(3)
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    plain = key(responses.call_model(frame.where("human IS NOT NULL"), lambda s, h: f"{s}:{h}").where("chunk_index < 9"))
    path = str(tmp_path / "ledger")
    got = ledger.call_model_once(frame.where("human IS NOT NULL"), complete, path, "m", batch_rows=2)
    assert got.columns == ["problem_id", "chunk_index", "response", "error"]
    assert [r for r in key(got) if r[:2] != ("b", 1)] == [r for r in plain if r[:2] != ("b", 1)] and ("b", 1, None, "no answer") in key(got)
    assert calls(log) == ["", "fail", "x", "y"]
    (tmp_path / "mended").write_text("")
    assert key(ledger.call_model_once(frame.where("human IS NOT NULL"), complete, path, "m")) == plain
    assert calls(log) == ["", "fail", "fail", "x", "y"]  # only what had no answer
    ledger.call_model_once(frame.where("human = 'x'"), complete, path, "other").collect()
    assert calls(log).count("x") == 2  # another model is asked anew


def test_a_stopped_job_goes_on(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def embed(texts):
        import uuid

        if "t7" in texts and not (tmp_path / "mended").exists():
            raise RuntimeError("stopped")
        for t in texts:
            (log / uuid.uuid4().hex).write_text(t)
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(i, f"t{i % 30}") for i in range(60)] + [(99, None), (98, "")], "n int, text string").coalesce(2)
    path = str(tmp_path / "vectors")
    with pytest.raises(Exception, match="stopped"):
        ledger.embed_texts_once(rows, embed, path, "m", batch=1, batch_rows=4)
    kept = set(spark.read.parquet(path).select("key").toPandas()["key"]) if (tmp_path / "vectors").exists() else set()
    before = len(calls(log))
    (tmp_path / "mended").write_text("")
    got = ledger.embed_texts_once(rows, embed, path, "m", batch=1, batch_rows=4)
    want = knn.embed_texts(rows, lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert len(calls(log)) - before == 31 - len(kept)  # 30 texts and the empty one; committed batches are not asked again
    ledger.embed_texts_once(rows, embed, path, "m").collect()
    assert len(calls(log)) - before == 31 - len(kept)
