"""Declared shapes of the tables that move between the stages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RAW_POSTS = T.StructType([
    T.StructField("ID", T.LongType()),
    T.StructField("Author", T.StringType()),
    T.StructField("Text", T.StringType()),
    T.StructField("Date", T.StringType()),
])

# As landed: whether a post answers another one is known, but not kept.
LANDED_POSTS = T.StructType(RAW_POSTS.fields + [T.StructField("in_reply_to_status_id", T.LongType())])

AUTHORS = T.StructType([
    T.StructField("Author", T.StringType()),
    T.StructField("party", T.StringType()),
    T.StructField("political_side", T.StringType()),
])

CLEANED_POSTS = T.StructType([
    T.StructField("ID", T.LongType()),
    T.StructField("Author", T.StringType()),
    T.StructField("party", T.StringType()),
    T.StructField("political_side", T.StringType()),
    T.StructField("Text", T.StringType()),
    T.StructField("Date", T.StringType()),
])

POSTS_WITH_TOPICS = T.StructType(CLEANED_POSTS.fields + [T.StructField("topic", T.StringType())])

# CSV form: label lists are comma-joined strings.
LABELLED_POSTS = T.StructType([
    T.StructField("ID", T.LongType()),
    T.StructField("Author", T.StringType()),
    T.StructField("party", T.StringType()),
    T.StructField("political_side", T.StringType()),
    T.StructField("Date", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("Text", T.StringType()),
    T.StructField("predicted_emotions", T.StringType()),
    T.StructField("top3_emotions", T.StringType()),
])

TRAINING_SET = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("emotion", T.StringType()),
])

EMOTION_CATALOGUE = T.StructType([
    T.StructField("emotion_id", T.IntegerType()),
    T.StructField("emotion_name", T.StringType()),
])

LABEL_MAP = T.StructType([
    T.StructField("idx", T.IntegerType()),
    T.StructField("label", T.StringType()),
])

SCORE = T.StructType([
    T.StructField("idx", T.IntegerType()),
    T.StructField("label", T.StringType()),
    T.StructField("score", T.DoubleType()),
])
SCORES = T.ArrayType(SCORE)


def check_header(header: Iterable[str], needed: Iterable[str], where: str = "the table") -> None:
    """``ValueError`` if a needed name is absent from a header, or listed twice there."""
    listed = list(header)
    wrong = [name for name in needed if listed.count(name) != 1]
    if wrong:
        raise ValueError(f"{where} must have each of {', '.join(wrong)} once; it has {', '.join(listed)}")


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The frame itself, if its columns are a valid header (no job runs)."""
    check_header(df.columns, columns)
    return df


def first_present(df: DataFrame, candidates: Iterable[str]) -> str | None:
    """First candidate that is a column of ``df``, compared case-sensitively."""
    return next((name for name in candidates if name in df.columns), None)
