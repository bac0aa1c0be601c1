"""From cleaned posts to posts with topics and emotions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affectframe.constants import LABEL_THRESHOLD, MAX_LABELS, TOP_LABELS
from affectframe.functions.scores import decode_labels, softmax, top_labels
from affectframe.operators.bayes import BayesModel, score
from affectframe.operators.dedupe import drop_repeated
from affectframe.operators.joins import join_on_key
from affectframe.operators.ranking import sample_per_group, sample_report
from affectframe.operators.topics import label_topics
from affectframe.session import new_dir
from affectframe.sources.readers import text_column

CARRIED = ("Author", "party", "political_side", "Date", "topic")


def add_topics(
    posts: DataFrame, lexicon: Mapping | None = None, topics: Sequence[str] | None = None
) -> DataFrame:
    """Posts with their topic."""
    return label_topics(posts, text_column(posts), lexicon=lexicon, topics=topics)


def topic_samples(posts: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """A few numbered text previews of each topic."""
    return sample_report(sample_per_group(posts, "topic", n, seed=seed), "topic")


def emotions_of(
    scores: DataFrame,
    *,
    threshold: float = LABEL_THRESHOLD,
    max_labels: int = MAX_LABELS,
    top: int = TOP_LABELS,
) -> DataFrame:
    """Decode score vectors into the two label lists; empty for an empty vector."""
    ready = scores.withColumn("_probabilities", softmax(F.col("scores")))
    return ready.withColumns({
        "predicted_emotions": decode_labels(F.col("_probabilities"), threshold, max_labels),
        "top3_emotions": top_labels(F.col("scores"), top),
    }).drop("_probabilities", "scores")


def add_emotions(posts: DataFrame, model: BayesModel, id: str = "ID", **options) -> DataFrame:
    """Posts with ``predicted_emotions`` and ``top3_emotions`` as arrays; every row comes out.

    Labels follow from the text alone, so each different text is scored once, and rows
    that share an ID, or have none, get the labels of their own texts. The short label
    lists are stored and come to the texts where they are, if they can be broadcast.
    """
    text = text_column(posts)
    carried = [c for c in CARRIED if c in posts.columns]
    keyed = posts.select(id, *carried, text).withColumn("_text", F.md5(F.coalesce(F.col(text), F.lit(""))))
    texts = drop_repeated(keyed.select("_text", text), "_text")
    path = new_dir(posts.sparkSession, "labels")
    emotions_of(score(model, texts, text, "_text"), **options).write.parquet(path)
    labels = posts.sparkSession.read.parquet(path)
    return join_on_key(keyed, labels, "_text", "left").drop("_text")
