"""Explanations of the labels of selected posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from affectframe.constants import EMOTIONS
from affectframe.operators.bayes import BayesModel, explain
from affectframe.operators.ranking import first_per_label
from affectframe.session import new_dir


def explain_examples(
    posts: DataFrame,
    model: BayesModel,
    *,
    labels: Sequence[str] = EMOTIONS,
    n: int = 5,
    text: str = "Text",
    id: str = "ID",
    label: str = "predicted_emotions",
) -> DataFrame:
    """Word contributions for the first n posts of each label, in label order.

    The few posts are looked up once and stored. Their place tells them apart, so posts
    that share an ID are explained each by itself.
    """
    spark, path = posts.sparkSession, new_dir(posts.sparkSession, "chosen")
    first_per_label(posts, labels, n, label=label, id=id).write.parquet(path)
    chosen = spark.read.parquet(path)
    carried = [label, "label_position", "ordinal"]
    return explain(model, chosen, text, id, carry=carried).orderBy(
        "label_position", "ordinal", "token"
    )
