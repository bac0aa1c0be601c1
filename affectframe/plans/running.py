"""Counts over time that are kept up to date run by run.

Each run adds its posts' counts by day and keys; no earlier post or count is read for it.
A run that is stored again takes its former counts back, as they are listed by run. Days
add up to weeks and months, so series of any width come from the daily counts, of which
there are as many as days and keys, not as many as posts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affectframe.functions.times import month_start, week_start
from affectframe.sources.versions import Versions

_COUNTS = "counts"
WIDTHS = {"day": lambda day: day, "week": lambda day: week_start(day), "month": lambda day: month_start(day)}


class RunningCounts:
    """The counts stored below a path, by the named keys (plain strings)."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.versions, self.keys = Versions(spark, path), list(keys)
        self.schema = T.StructType([
            T.StructField("day", T.DateType()), *[T.StructField(k, T.StringType()) for k in self.keys], T.StructField("count", T.LongType()),
        ])

    def of(self, posts: DataFrame, moment: Column) -> DataFrame:
        """Posts per day and key; a post without a day or one of the keys is counted nowhere."""
        keyed = posts.select(moment.cast("date").alias("day"), *[F.col(k).cast("string").alias(k) for k in self.keys])
        return keyed.na.drop().groupBy("day", *self.keys).agg(F.count("*").alias("count"))

    def add(self, posts: DataFrame, moment: Column, run: str) -> None:
        """Count a run's posts, in place of what it was counted as before."""
        self.versions.commit({_COUNTS: self.of(posts, moment)}, run)

    def series(self, width: str = "day") -> DataFrame:
        """``period``, the keys and ``count``, over all runs."""
        daily = self.versions.read(_COUNTS, self.schema)
        return daily.groupBy(WIDTHS[width](F.col("day")).alias("period"), *self.keys).agg(F.sum("count").alias("count"))

    def shares(self, width: str, group: Sequence[str]) -> DataFrame:
        """The series with each count's percentage of its period and group."""
        counts = self.series(width)
        totals = counts.groupBy("period", *group).agg(F.sum("count").alias("total"))
        shared = counts.join(totals, ["period", *group])
        return shared.withColumn("percentage", F.col("count") * 100 / F.col("total")).drop("total")

    def compact(self) -> None:
        """One folder of counts for all runs so far; each can still be replaced."""
        self.versions.compact(_COUNTS, self.schema)
