"""Counts and result tables that are kept up to date run by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affectframe.plans.running import RunningCounts
from affectframe.queries.registry import POSTS, posts, query, table
from affectframe.session import new_dir
from affectframe.sources.versions import Versions, publish, published

_KEYS = ["party", "predicted_emotions"]


def _three_runs(spark: SparkSession, sf: str) -> RunningCounts:
    """Posts counted in three runs; the second one is replaced after the third has come."""
    rows = posts(spark, sf).select("ID", "Date", *_KEYS)
    counts = RunningCounts(spark, new_dir(spark, "counts"), _KEYS)
    part = F.col("ID") % 3
    counts.add(rows.filter(part == 0), F.col("Date"), "first")
    counts.add(rows.filter("ID % 6 < 4"), F.col("Date"), "second")
    counts.compact()
    counts.add(rows.filter(part == 2), F.col("Date"), "third")
    counts.add(rows.filter(part == 1), F.col("Date"), "second")
    return counts


_SERIES = """SELECT strftime(date_trunc('{0}', moment), '%Y-%m-%d') AS period, party, predicted_emotions, count(*) AS count
FROM posts WHERE party IS NOT NULL AND moment IS NOT NULL AND predicted_emotions IS NOT NULL GROUP BY ALL"""


@query(f"WITH {POSTS} {_SERIES.format('week')}")
def running_weekly_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _three_runs(spark, sf).series("week").withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@query(f"""WITH {POSTS}, series AS ({_SERIES.format('month')})
SELECT period, party, predicted_emotions, count,
       round(count * 100 / sum(count) OVER (PARTITION BY period, party), 6) AS percentage FROM series""")
def running_monthly_shares(spark: SparkSession, sf: str) -> DataFrame:
    shares = _three_runs(spark, sf).shares("month", ["party"])
    return shares.withColumns({
        "percentage": F.round("percentage", 6), "period": F.date_format("period", "yyyy-MM-dd")
    })


_RESULT = "event_type string, count bigint, value double"


@query("SELECT event_type, count(*) AS count, round(sum(value), 2) AS value FROM events GROUP BY event_type")
def published_result(spark: SparkSession, sf: str) -> DataFrame:
    """A result table published twice, for half of the events first; readers see the last one."""
    path = new_dir(spark, "result")
    events = table(spark, sf, "events")

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("event_type").agg(F.count("*").alias("count"), F.sum("value").alias("value"))

    publish(summed(events.filter("event_id % 2 = 0")), path)
    publish(summed(events), path)
    Versions(spark, path).forget(keep=1)
    return published(spark, path, _RESULT).withColumn("value", F.round("value", 2))


@query("SELECT event_id, event_type, value FROM events")
def compacted_table(spark: SparkSession, sf: str) -> DataFrame:
    """Events stored in two batches by type, then put into few files."""
    versions = Versions(spark, new_dir(spark, "events"))
    schema = "event_id bigint, value double, event_type string"
    events = table(spark, sf, "events").select("event_id", "value", "event_type")
    for batch in (0, 1):
        versions.commit({"events": events.filter(F.col("event_id") % 2 == batch)}, f"batch-{batch}", by={"events": ["event_type"]})
    versions.compact("events", schema, ["event_type"])
    versions.forget(keep=1)
    return versions.read("events", schema).select("event_id", "event_type", "value")
