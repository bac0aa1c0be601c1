"""Scoring by a model that lives outside Spark: the one place where Python sees rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affectframe.schemas import SCORES

BatchScorer = Callable[[list[str]], Sequence[Sequence[float]]]


def score_externally(
    posts: DataFrame, text: str, id: str, labels: Sequence[str], scorer: BatchScorer
) -> DataFrame:
    """``id, scores, error`` for each post.

    ``scorer`` gets a batch of texts and returns one list of scores, in label order,
    per text. If a batch fails its halves are tried, and a text that fails
    alone gets an empty vector and the error's message; no row is lost and no task
    fails for it. Missing and blank texts have an empty vector and are not scored.
    """
    labels = list(labels)

    def entries(values: Sequence[float]) -> list[dict]:
        pairs = zip(labels, values, strict=True)
        return [{"idx": i, "label": n, "score": float(v)} for i, (n, v) in enumerate(pairs)]

    def attempt(texts: list[str]) -> list[tuple[list[dict], str | None]]:
        try:
            results = list(scorer(texts))
            if len(results) != len(texts):
                raise ValueError(f"{len(texts)} texts, {len(results)} results")
            return [(entries(values), None) for values in results]
        except Exception as problem:
            if len(texts) == 1:
                return [([], f"{type(problem).__name__}: {problem}")]
            middle = len(texts) // 2
            return attempt(texts[:middle]) + attempt(texts[middle:])

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            given = [t for t in frame["_text"] if t is not None and t.strip()]
            outcomes = iter(attempt(given) if given else [])
            rows = [
                next(outcomes) if t is not None and t.strip() else ([], None)
                for t in frame["_text"]
            ]
            yield pd.DataFrame({
                id: frame[id], "scores": [r[0] for r in rows], "error": [r[1] for r in rows]
            })

    schema = T.StructType([
        T.StructField(id, posts.schema[id].dataType),
        T.StructField("scores", SCORES),
        T.StructField("error", T.StringType()),
    ])
    return posts.select(id, F.col(text).alias("_text")).mapInPandas(batches, schema)
