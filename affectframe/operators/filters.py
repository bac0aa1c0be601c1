"""Row filters on posts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affectframe.constants import COLLECT_FROM, EVENT_KEYWORDS
from affectframe.functions.predicates import has_words, is_ceremonial, is_repost, mentions_any
from affectframe.functions.text import is_blank
from affectframe.functions.times import midnight

REPLY_COLUMN = "in_reply_to_status_id"


def since(df: DataFrame, moment: Column, day: str = COLLECT_FROM, zone: str = "UTC") -> DataFrame:
    """Posts from the given day on, the day beginning at midnight of ``zone``."""
    return df.filter(moment >= midnight(day, zone))


def drop_reposts(df: DataFrame, text: str = "Text") -> DataFrame:
    return df.filter(~is_repost(F.col(text)))


def drop_replies(df: DataFrame, reply_to: str = REPLY_COLUMN) -> DataFrame:
    """Posts that answer none; all of them where the column is absent."""
    return df.filter(F.col(reply_to).isNull()) if reply_to in df.columns else df


def drop_ceremonial(df: DataFrame, text: str = "Text", **options) -> DataFrame:
    return df.filter(~is_ceremonial(F.col(text), **options))


def drop_events(
    df: DataFrame, text: str = "Text", keywords: Iterable[str] = EVENT_KEYWORDS, **options
) -> DataFrame:
    return df.filter(~mentions_any(F.col(text), keywords, **options))


def drop_short(df: DataFrame, text: str = "Text", at_least: int = 3) -> DataFrame:
    return df.filter(has_words(F.col(text), at_least))


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def drop_blank(df: DataFrame, column: str) -> DataFrame:
    return df.filter(~is_blank(F.col(column)))


def keep_values(df: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    """Rows with one of the values; an empty list keeps all rows."""
    values = list(values)
    return df.filter(F.col(column).isin(values)) if values else df


def drop_values(df: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    """Rows without any of the values. A null value is none of them and stays."""
    return df.filter(F.coalesce(~F.col(column).isin(list(values)), F.lit(True)))


def within(df: DataFrame, moment: Column, start: Column, end: Column) -> DataFrame:
    """Rows of the closed interval. An end at midnight leaves out the rest of that day."""
    return df.filter(moment.between(start, end))
