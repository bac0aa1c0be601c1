"""Long form of label lists, counts, shares and folded shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affectframe.constants import SMALL_SHARE
from affectframe.functions.text import SPACE, capitalize

LABEL = "predicted_emotions"
_EDGE_SPACE = f"^[{SPACE}]+|[{SPACE}]+$"


def explode_labels(
    posts: DataFrame, column: str = LABEL, *, missing_label: str | None = None
) -> DataFrame:
    """One row per label of a comma-joined list (or array), trimmed and capitalised.

    Empty labels go. Posts without a list, or with an empty one, go too, unless
    ``missing_label`` names the label that stands for them.
    """
    lists = F.col(column)
    if posts.schema[column].dataType.typeName() == "string":
        lists = F.split(lists, ",")
    if missing_label is not None:
        lists = F.when(F.size(lists) > 0, lists).otherwise(F.array(F.lit(missing_label)))
    long = posts.withColumn(column, F.explode(lists))
    trimmed = F.regexp_replace(F.col(column), _EDGE_SPACE, "")
    return long.withColumn(column, capitalize(trimmed)).filter(F.col(column) != "")


def count_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per group. Rows with a null in a key belong to no group."""
    keys = list(keys)
    return df.na.drop(subset=keys).groupBy(*keys).count()


def roll_up(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts by some of the keys of a finer count table, without null keys."""
    keys = list(keys)
    return counts.na.drop(subset=keys).groupBy(*keys).agg(F.sum("count").alias("count"))


def party_emotions(long: DataFrame) -> DataFrame:
    return count_by(long, ["party", LABEL])


def topic_party_emotions(long: DataFrame) -> DataFrame:
    return count_by(long, ["topic", "party", LABEL])


def side_emotions(long: DataFrame) -> DataFrame:
    return count_by(long, ["political_side", LABEL])


def with_percentage(counts: DataFrame, within: str | Sequence[str]) -> DataFrame:
    """Add each count's percentage of its group's total."""
    keys = [within] if isinstance(within, str) else list(within)
    total = F.sum("count").over(Window.partitionBy(*keys))
    return counts.withColumn("percentage", F.col("count") / total * 100)


def author_profile(long: DataFrame, author: str = "Author") -> DataFrame:
    """Each author's labels with counts and percentages."""
    return with_percentage(count_by(long, [author, LABEL]), author)


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """How often each non-null value occurs, most frequent first."""
    return count_by(df, [column]).orderBy(F.desc("count"), F.asc(column))


def label_distribution(posts: DataFrame, column: str = LABEL) -> DataFrame:
    """Distribution of single labels; here a post without labels counts as the empty label."""
    labels = F.col(column)
    if posts.schema[column].dataType.typeName() == "string":
        labels = F.split(labels, ",")
    labels = F.when(F.size(labels) == 0, F.array(F.lit(""))).otherwise(labels)
    return value_distribution(posts.select(F.explode(labels).alias(column)), column)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def common_values(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows found in both."""
    return left.intersect(right)


def missing_values(wanted: DataFrame, available: DataFrame) -> DataFrame:
    """Distinct wanted rows that are not available."""
    return wanted.distinct().exceptAll(available.distinct())


def focus_topics(
    counts: DataFrame, wanted: Sequence[str], fallback: int = 3, topic: str = "topic"
) -> DataFrame:
    """Topics to look at with their totals: the wanted ones that occur, in the order
    asked for; if none occurs, the ``fallback`` most frequent ones.

    Decided inside the plan. Sorting wanted topics to the front leaves a list of
    at most max(len(wanted), fallback) rows, which holds either answer.
    """
    wanted = list(dict.fromkeys(wanted))
    place = F.array_position(F.array(*[F.lit(t) for t in wanted]).cast("array<string>"), F.col(topic))
    totals = counts.groupBy(topic).agg(F.sum("count").alias("count"))
    order = [F.desc("is_wanted"), F.desc("count"), F.asc(topic)]
    front = (
        totals.withColumn("is_wanted", place > 0)
        .withColumn("_place", F.when(place > 0, place))
        .orderBy(*order)
        .limit(max(len(wanted), fallback))
    )
    some = F.max("is_wanted").over(Window.partitionBy())
    rank = F.row_number().over(Window.partitionBy().orderBy(*order))
    listed = front.withColumn("_some", some).withColumn("_rank", rank)
    chosen = listed.filter(F.when(F.col("_some"), F.col("is_wanted")).otherwise(F.col("_rank") <= fallback))
    return chosen.select(topic, "count", F.coalesce("_place", "_rank").cast("int").alias("position"))


def busiest_topics(long: DataFrame, n: int = 4, topic: str = "topic", label: str = LABEL) -> DataFrame:
    """The n topics with most labels; rows without a label do not count."""
    counts = long.na.drop(subset=[topic]).groupBy(topic).agg(F.count(label).alias("count"))
    return counts.orderBy(F.desc("count"), F.asc(topic)).limit(n)


def percent_text(count: Column, total: Column, at_least: int = 5) -> Column:
    """``12.5%`` and the count below it, empty for small shares.

    Rounded half up in whole numbers, so that the text does not depend on how a
    quotient is represented.
    """
    tenths = F.call_function("div", count * 2000 + total, total * 2)
    whole = F.call_function("div", tenths, F.lit(10))
    text = F.concat(
        whole.cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"),
        F.lit("%\n("), count.cast("string"), F.lit(")"),
    )
    return F.when(count * 100 >= total * at_least, text).otherwise(F.lit(""))


def fold_small_shares(
    counts: DataFrame,
    group: str,
    label: str = LABEL,
    *,
    cutoff: float = SMALL_SHARE,
    other: str = "Other",
) -> DataFrame:
    """Counts and shares per group with all small shares added up in one row.

    A single small share stays as it is. ``position`` orders the rows of a group:
    by count, the folded row last.
    """
    whole = Window.partitionBy(group)
    share = F.col("count") / F.sum("count").over(whole)
    marked = counts.withColumn("_small", share < cutoff).withColumn(
        "_folds", F.col("_small") & (F.sum(F.col("_small").cast("int")).over(whole) > 1)
    )
    folded = marked.groupBy(
        group, F.when(F.col("_folds"), F.lit(other)).otherwise(F.col(label)).alias(label), "_folds"
    ).agg(F.sum("count").alias("count"))
    total = F.sum("count").over(whole)
    place = F.row_number().over(whole.orderBy(F.asc("_folds"), F.desc("count"), F.asc(label)))
    return folded.select(
        group,
        label,
        "count",
        (F.col("count") / total).alias("share"),
        percent_text(F.col("count"), total).alias("text"),
        place.alias("position"),
    )


def stage_counts(df: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """Rows removed and kept by successive filters, one row per stage, in one pass.

    ``stages`` maps a stage name to the condition that *keeps* a row; a row counts
    as removed by the first stage whose condition it fails.
    """
    failed = F.coalesce(
        *[F.when(~keep, F.lit(i)) for i, keep in enumerate(stages.values())], F.lit(len(stages))
    )
    first_failed = df.select(failed.alias("failed"))
    sums = [F.count_if(F.col("failed") == i).alias(f"removed_{i}") for i in range(len(stages))]
    totals = first_failed.agg(F.count("*").alias("total"), *sums)
    kept, rows = F.col("total"), []
    for i, name in enumerate(stages):
        kept = kept - F.col(f"removed_{i}")
        rows.append(F.struct(
            F.lit(i + 1).alias("stage"), F.lit(name).alias("name"),
            F.col(f"removed_{i}").alias("removed"), kept.alias("kept"),
        ))
    return totals.select(F.inline(F.array(*rows)))
