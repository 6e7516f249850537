"""Turns of any length keep all their words."""

from __future__ import annotations

from versespark.plans import views


def test_tei_of_a_long_turn(spark, tmp_path):
    words = [f"w{i}" for i in range(100_020)]
    rows = spark.createDataFrame([(1, 0, "user", " ".join(words))], "conv_id long, turn long, role string, text string")
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    xml = views.tei_documents(spark, str(tmp_path)).first()["xml"]
    assert f"{words[-2]} {words[-1]}</p>" in xml
