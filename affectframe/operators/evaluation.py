"""Quality of predictions, from the counts of (label, prediction) pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_counts(predictions: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Rows per (label, prediction): everything below works on this small table."""
    return predictions.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).count()


def _ratio(part: Column, whole: Column) -> Column:
    """Quotient of counts, zero where there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _per_class(pairs: DataFrame) -> DataFrame:
    hit = F.when(F.col("label").eqNullSafe(F.col("pred")), F.col("count")).otherwise(F.lit(0))
    none = F.lit(0).cast("bigint")
    sides = pairs.select(F.inline(F.array(
        F.struct(
            F.col("label").alias("class"), hit.alias("tp"),
            F.col("count").alias("support"), none.alias("predicted"),
        ),
        F.struct(
            F.col("pred").alias("class"), none.alias("tp"),
            none.alias("support"), F.col("count").alias("predicted"),
        ),
    )))
    sums = sides.na.drop(subset=["class"]).groupBy("class").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted")
    )
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return sums.select(
        "class",
        _ratio(tp, predicted).alias("precision"),
        _ratio(tp, support).alias("recall"),
        _ratio(tp * 2, support + predicted).alias("f1"),
        "support", "tp", "predicted",
    )


def accuracy(pairs: DataFrame) -> DataFrame:
    """One row: accuracy, and micro-averaged F1 from summed hits and misses."""
    sums = _per_class(pairs).agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("n"), F.sum("predicted").alias("p")
    )
    return sums.select(
        _ratio(F.col("tp"), F.col("n")).alias("accuracy"),
        _ratio(F.col("tp") * 2, F.col("n") + F.col("p")).alias("micro_f1"),
    )


def classification_report(pairs: DataFrame, digits: int = 2) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted average."""
    per_class = _per_class(pairs)

    def weighted(measure: str) -> Column:
        return F.sum(F.col(measure) * F.col("support")) / F.sum("support")

    measures = ("precision", "recall", "f1")
    overall = per_class.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[weighted(m).alias(f"weighted_{m}") for m in measures],
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.sum("support").alias("support"),
    )
    blank = F.lit(None).cast("double")

    def row(position: int, name: str, precision: Column, recall: Column, f1: Column) -> Column:
        return F.struct(
            F.lit(position).alias("section"), F.lit(name).alias("class"), precision.alias("precision"),
            recall.alias("recall"), f1.alias("f1"), F.col("support").alias("support"),
        )

    averages = overall.select(F.inline(F.array(
        row(1, "accuracy", blank, blank, F.col("accuracy")),
        row(2, "macro avg", *[F.col(f"macro_{m}") for m in measures]),
        row(3, "weighted avg", *[F.col(f"weighted_{m}") for m in measures]),
    )))
    classes = per_class.select(F.lit(0).alias("section"), "class", *measures, "support")
    report = classes.unionByName(averages)
    return report.select(
        "section", "class", *[F.round(m, digits).alias(m) for m in measures], "support"
    )


def confusion_matrix(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row per true label and one column per predicted label, zero where never met."""
    labels = list(labels)
    wide = pairs.groupBy("label").pivot("pred", labels).agg(F.sum("count"))
    return wide.na.fill(0, subset=labels)
