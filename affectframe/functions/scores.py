"""Score vectors: ``array<struct<idx int, label string, score double>>``.

One array per post, in label order. Ties go to the lower ``idx``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from affectframe.constants import (
    LABEL_THRESHOLD,
    MAX_LABELS,
    TOP_LABELS,
    TOPIC_THRESHOLD,
    UNCERTAIN,
)
from affectframe.functions.once import bind


def score_vector(labels: Sequence[str], values: Sequence[Column]) -> Column:
    return F.array(*[
        F.struct(
            F.lit(i).alias("idx"),
            F.lit(label).alias("label"),
            value.cast("double").alias("score"),
        )
        for i, (label, value) in enumerate(zip(labels, values, strict=True))
    ])


def softmax(scores: Column) -> Column:
    """Scores turned into probabilities, shifted by the maximum so that exp cannot overflow."""

    def shifted(s: Column) -> Column:
        top = F.array_max(F.transform(s, lambda x: x["score"]))
        return bind(top, lambda t: F.transform(s, lambda x: F.exp(x["score"] - t)))

    def divided(s: Column, raised: Column) -> Column:
        total = F.aggregate(raised, F.lit(0.0), lambda acc, x: acc + x)
        return bind(total, lambda t: F.zip_with(s, raised, lambda x, e: F.struct(
            x["idx"].alias("idx"), x["label"].alias("label"), (e / t).alias("score"),
        )))

    return bind(scores, lambda s: bind(shifted(s), lambda raised: divided(s, raised)))


def ranked(scores: Column) -> Column:
    """The vector by falling score, equal scores by rising ``idx``."""
    keyed = F.transform(scores, lambda s: F.struct(
        (-s["score"]).alias("key"), s["idx"].alias("idx"), s["label"].alias("label")
    ))
    return F.transform(F.sort_array(keyed), lambda s: F.struct(
        s["idx"].alias("idx"), s["label"].alias("label"), (-s["key"]).alias("score")
    ))


def top_labels(scores: Column, k: int = TOP_LABELS) -> Column:
    """Names of the k best labels."""
    return F.transform(F.slice(ranked(scores), 1, k), lambda s: s["label"])


def best(scores: Column) -> Column:
    """The best entry of a vector as a struct; null for an empty one."""
    return F.get(ranked(scores), F.lit(0))


def score_of(scores: Column, label: str) -> Column:
    """The score of a label by its name; null where the vector lacks it, as an empty one does."""
    return F.get(F.filter(scores, lambda s: s["label"] == label), F.lit(0))["score"]


def decode_labels(
    scores: Column, threshold: float = LABEL_THRESHOLD, k: int = MAX_LABELS
) -> Column:
    """Names of up to k labels that reach the threshold, else of the single best one."""

    def chosen(order: Column) -> Column:
        # The order is falling, so a weak first entry means that none passes.
        passing = F.slice(F.filter(order, lambda s: s["score"] >= threshold), 1, k)
        return F.when(F.get(order, F.lit(0))["score"] >= threshold, passing).otherwise(
            F.slice(order, 1, 1)
        )

    return F.transform(bind(ranked(scores), chosen), lambda s: s["label"])


def label_or_uncertain(
    scores: Column,
    names: Mapping[str, str] | None = None,
    threshold: float = TOPIC_THRESHOLD,
    fallback: str = UNCERTAIN,
) -> Column:
    """Best label, translated by ``names``; the fallback if weak, unknown or missing."""

    def named(top: Column) -> Column:
        label = F.when(top["score"] >= threshold, top["label"])
        return label if names is None else lookup(label, names)

    return F.coalesce(bind(best(scores), named), F.lit(fallback))


def lookup(value: Column, names: Mapping[str, str], default: str | None = None) -> Column:
    """Entry of a fixed dictionary, or the default."""
    table = F.create_map(*[F.lit(part) for pair in names.items() for part in pair])
    found = F.try_element_at(table, value)
    return found if default is None else F.coalesce(found, F.lit(default))
