"""Counts over time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affectframe.constants import DATETIME_COLUMNS, EVENT_DATE, MONTHLY_AFTER_DAYS
from affectframe.functions.text import capitalize
from affectframe.functions.times import (
    event_bounds,
    month_start,
    parse_datetime,
    utc_naive,
    week_start,
    whole_days,
)
from affectframe.operators.counts import LABEL
from affectframe.schemas import first_present


def datetime_column(df: DataFrame) -> str | None:
    """First of the known date column names that the frame has."""
    return first_present(df, DATETIME_COLUMNS)


def moment_of(df: DataFrame, column: str | None = None) -> Column | None:
    """Zone-less UTC moment of each row from its date column; null where unreadable.

    Without a column name the known ones are tried; None if the frame has none.
    """
    column = column or datetime_column(df)
    if column is None:
        return None
    kind = df.schema[column].dataType.typeName()
    if kind == "timestamp_ntz":
        return F.col(column)
    if kind == "timestamp":
        return utc_naive(F.col(column))
    if kind == "date":
        return F.col(column).cast("timestamp_ntz")
    return parse_datetime(F.col(column))


def span_days(df: DataFrame, moment: str) -> Column:
    """Whole days between the first and the last moment, as a scalar of the same plan."""
    return df.agg(whole_days(F.min(moment), F.max(moment)).alias("days")).scalar()


def adaptive_series(
    posts: DataFrame,
    labels: Sequence[str],
    *,
    date: str | None = None,
    label: str = LABEL,
    monthly_after: int = MONTHLY_AFTER_DAYS,
    explode: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame | None:
    """Counts per period and label; months if the data span more days than
    ``monthly_after``, else days. None if the frame has no date column.

    Rows are counted per day first, and all else is done with these counts. Where the
    label column holds lists, ``explode`` turns a table with lists into one with labels;
    it is applied to the counts, not to the posts. The span is a scalar subquery, so its
    answer reaches the second, small aggregation inside one plan.
    """
    moment = moment_of(posts, date)
    if moment is None:
        return None
    rows = posts.select(moment.alias("_at"), label).filter(F.col("_at").isNotNull())
    daily = rows.groupBy(F.col("_at").cast("date").alias("_day"), label).agg(
        F.count("*").alias("count"), F.min("_at").alias("_first"), F.max("_at").alias("_last")
    )
    daily = explode(daily) if explode else daily
    daily = daily.filter(F.col(label).isin(list(labels)))
    span = daily.agg(F.struct(
        whole_days(F.min("_first"), F.max("_last")).alias("days"), F.sum("count").alias("count")
    ).alias("span")).scalar()
    # The subquery and the series ask the daily table for the same columns: so it is
    # the same table to Spark, and the posts are read and counted once for both.
    daily = daily.filter(F.col("_first").isNotNull() & F.col("_last").isNotNull())
    monthly = span["days"] > monthly_after
    period = F.when(monthly, month_start("_day")).otherwise(F.col("_day"))
    return daily.groupBy(period.alias("ts_period"), label).agg(F.sum("count").alias("count"))


def event_series(
    posts: DataFrame,
    event_date: str = EVENT_DATE,
    months: int = 3,
    *,
    emotions: Sequence[str] = (),
    parties: Sequence[str] = (),
    selected: Sequence[str] = (),
    date: str | None = None,
    label: str = LABEL,
    party: str = "party",
    explode: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame | None:
    """Weekly counts per party and label in the months around an event.

    Labels: those of ``emotions`` if any are given (nothing, if none of them
    occurs); otherwise those of ``selected`` if any of them occurs in the window,
    whatever the party; otherwise all. An empty ``parties`` means all parties.
    ``explode`` is as for :func:`adaptive_series`.
    """
    moment = moment_of(posts, date)
    if moment is None:
        return None
    start, end = event_bounds(event_date, months)
    columns = [moment.alias("_at"), F.col(label)]
    columns += [F.col(party)] if party in posts.columns else [F.lit(None).cast("string").alias(party)]
    rows = posts.select(*columns).filter(F.col("_at").between(start, end))
    weekly = rows.groupBy(week_start("_at").alias("ts_period"), party, label).count()
    weekly = explode(weekly) if explode else weekly
    if emotions:
        wanted = F.array(*[capitalize(F.lit(e.strip())) for e in emotions])
        weekly = weekly.filter(F.array_contains(wanted, F.col(label)))
    elif selected:
        is_selected = F.col(label).isin(list(selected))
        # Looks at the counts: the group of null parties still shows which labels occur.
        # The sum makes it ask for the same columns as the series: with lists to be taken
        # apart above the counts, both then share them.
        found = weekly.agg(F.struct(
            F.coalesce(F.bool_or(is_selected), F.lit(False)).alias("any"), F.sum("count").alias("count")
        ).alias("found")).scalar()
        weekly = weekly.filter(~found["any"] | is_selected)
    if parties:
        weekly = weekly.filter(F.col(party).isin(list(parties)))
    weekly = weekly.na.drop(subset=[party, label])
    if explode:
        # Several lists hold the same label.
        weekly = weekly.groupBy("ts_period", party, label).agg(F.sum("count").alias("count"))
    return weekly


def pivot_series(
    series: DataFrame,
    labels: Sequence[str],
    *,
    by: Sequence[str] = ("ts_period",),
    label: str = LABEL,
) -> DataFrame:
    """One row per period and one column per label, zero where a label is absent.

    Periods without any row are not made up.
    """
    labels = list(labels)
    wide = series.groupBy(*by).pivot(label, labels).agg(F.sum("count"))
    return wide.na.fill(0, subset=labels)
