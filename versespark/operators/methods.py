"""Detection methods as DataFrame jobs, user methods, and the switch between them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.chunking import chunked, chunked_with_offsets
from ..functions.refs import chunk_id
from ..sources.files import PREDICTION
from .knn import embed_texts, embedding_pairs, top_k
from .ledger import call_model_once, embed_texts_once
from .responses import call_model, prompts, score_responses, verse_index
from .reuse import ReuseOptions, best_pairs, detect, flatten_output

METHODS: dict[str, Callable[..., DataFrame]] = {}


def method(name: str):
    def register(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        METHODS[name] = run
        return run
    return register


def run_named(name: str, *args, **options) -> DataFrame:
    if name not in METHODS:
        raise ValueError(f"unknown method: {name}; there are {sorted(METHODS)}")
    return METHODS[name](*args, **options)


def run_user_method(problems: DataFrame, fn: Callable[[str, str, dict], list[dict]], context: dict) -> DataFrame:
    """Apply ``fn(problem_id, text, context)`` to each problem; its dicts become predictions, other keys are ignored."""
    names = ["problem_id", "reference", "score", "method"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [[x.get(n) for n in names] for p, t in frame[["problem_id", "text"]].itertuples(index=False, name=None) for x in fn(p, t, context)]
            yield pd.DataFrame(rows, columns=names).astype({"score": "float64"})

    return problems.select("problem_id", "text").mapInPandas(run, PREDICTION)


def register_method(spark: SparkSession, name: str, fn: Callable[[str, str, dict], list[dict]], context: dict,
                    setup: Callable[[dict], dict] | None = None) -> None:
    """Make ``fn(problem_id, text, context)`` the SQL table function ``name``:

    ``SELECT * FROM name(TABLE(problems) PARTITION BY problem_id)``, where the table has problem_id and text, gives (problem_id, reference, score,
    method, error); a prediction that names no problem is of the one at hand. ``setup(context)`` gives the context that ``fn`` gets and runs once in a task, at its first problem. A problem
    that fails is one row with its error, and the others go on.
    """
    ready: dict[str, dict] = {}

    class Method:
        def eval(self, row: Row) -> Iterator[tuple]:
            try:
                if "context" not in ready:
                    ready["context"] = setup(context) if setup else context
                found = [[x.get("problem_id", row["problem_id"]), *[x.get(n) for n in ("reference", "score", "method")]] for x in fn(row["problem_id"], row["text"], ready["context"])]
                found = [(problem, ref, None if score is None else float(score), name, None) for problem, ref, score, name in found]
            except Exception as e:  # noqa: BLE001  whatever the method raises
                found = [(row["problem_id"], None, None, None, str(e))]
            yield from found

    spark.udtf.register(name, F.udtf(Method, returnType=f"{PREDICTION}, error string"))


@method("embedding")
def embedding_method(problems: DataFrame, collection: DataFrame, embed: Callable, mode: str = "sentence", k: int = 5,
                     threshold: float = 0.45, ledger: str | None = None, model: str = "", **chunking) -> DataFrame:
    """Chunk, embed, take the nearest verses, keep the best score per pair. ``collection``: (reference, embedding). ``ledger`` names a
    table of vectors of ``model``, so that no text is embedded twice."""
    chunks = chunked(problems, mode, **chunking).withColumn("query_id", chunk_id(F.col("problem_id"), F.col("chunk_index")))
    vectors = embed_texts_once(chunks, embed, ledger, model) if ledger else embed_texts(chunks, embed)
    near = top_k(vectors.select("query_id", "embedding"), collection, k, threshold)
    return embedding_pairs(near.join(chunks.select("query_id", "problem_id"), "query_id"))


@method("reuse")
def reuse_method(problems: DataFrame, verses: DataFrame, mode: str = "sentence_window", chunking_enabled: bool = True,
                 options: ReuseOptions | None = None, **chunking) -> DataFrame:
    chunks = chunked_with_offsets(problems, mode if chunking_enabled else "full", **chunking)
    return best_pairs(flatten_output(detect(chunks, verses, options or ReuseOptions())))


@method("prompting")
def prompting_method(problems: DataFrame, verses: DataFrame, aliases: dict[str, str], codes: list[str], complete: Callable,
                     instruction: str = "Name every verse that the text quotes, as JSON.", mode: str = "full", ledger: str | None = None,
                     model: str = "", **chunking) -> DataFrame:
    """``ledger`` names a table of answers of ``model``, so that none is asked for twice."""
    asked = prompts(chunked(problems, mode, **chunking), codes, instruction)
    answers = call_model_once(asked, complete, ledger, model) if ledger else call_model(asked, complete)
    return score_responses(answers.where("error IS NULL"), verse_index(verses), aliases, codes)
