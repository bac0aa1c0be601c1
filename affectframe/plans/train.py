"""Training and evaluation of the emotion classifier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affectframe.operators.bayes import BayesModel, predict, train
from affectframe.operators.dedupe import drop_repeated
from affectframe.operators.evaluation import (
    accuracy,
    classification_report,
    confusion_matrix,
    pair_counts,
)
from affectframe.operators.filters import drop_blank, drop_missing
from affectframe.operators.joins import join_on_key
from affectframe.operators.split import stratified_split
from affectframe.session import new_dir


@dataclass(frozen=True)
class Evaluation:
    model: BayesModel
    accuracy: DataFrame
    report: DataFrame
    confusion: DataFrame


def train_and_evaluate(
    posts: DataFrame,
    text: str = "text",
    label: str = "emotion",
    id: str = "id",
    *,
    fraction: float = 0.15,
    seed: int = 42,
    path: str | None = None,
) -> Evaluation:
    """Train on a stratified part of the posts, evaluate on the rest.

    Usable posts, split, model and pair counts are stored below ``path`` (or in a new
    folder of the shared one). Each later step reads what it needs of them: the split
    reads labels and IDs only, the reports read the small table of pairs.
    """
    spark = posts.sparkSession
    path = path or new_dir(spark, "training")
    usable = drop_blank(drop_missing(posts, [text, label]), text)
    usable.select(id, text, label).write.mode("overwrite").parquet(f"{path}/usable")
    usable = spark.read.parquet(f"{path}/usable")
    split = stratified_split(
        usable, label, id, fraction=fraction, seed=seed, path=f"{path}/split"
    )
    model = train(split.filter(~F.col("held_out")), text, label, path=path)
    # A label follows from the text alone: each different text is scored once.
    held = split.filter("held_out").select(F.md5(text).alias("_text"), label, text)
    predictions = predict(model, drop_repeated(held.select("_text", text), "_text"), text, "_text")
    predictions.select("_text", "pred").write.mode("overwrite").parquet(f"{path}/predictions")
    judged = join_on_key(held.drop(text), spark.read.parquet(f"{path}/predictions"), "_text", "inner")
    pair_counts(judged, label, "pred").write.mode("overwrite").parquet(f"{path}/pairs")
    pairs = spark.read.parquet(f"{path}/pairs")
    return Evaluation(
        model, accuracy(pairs), classification_report(pairs), confusion_matrix(pairs, model.labels)
    )
