"""Dates and counts over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affectframe.functions.times import parse_datetime
from affectframe.operators.counts import explode_labels
from affectframe.operators.series import (
    adaptive_series,
    datetime_column,
    event_series,
    moment_of,
    pivot_series,
    span_days,
)
from affectframe.sources.readers import union_sources
from affectframe.queries.registry import POSTS, bare_posts, posts, query, table

# The same long form in SQL: the labels capitalised.
LONG = f"""{POSTS}, long AS (
  SELECT * REPLACE (upper(predicted_emotions[1]) || lower(predicted_emotions[2:]) AS predicted_emotions)
  FROM posts
)"""


def _day_text(day: str) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def _event_posts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("ts").alias("timestamp"), F.col("event_type").alias("predicted_emotions")
    )


@query("""WITH picked AS (SELECT ts, event_type FROM events WHERE event_type IN ('click', 'error')),
span AS (SELECT floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0) > 90 AS monthly FROM picked)
SELECT strftime(CASE WHEN monthly THEN date_trunc('month', ts) ELSE date_trunc('day', ts) END, '%Y-%m-%d') AS ts_period,
       event_type AS predicted_emotions, count(*) AS count
FROM picked, span GROUP BY ALL""")
def ts_daily(spark: SparkSession, sf: str) -> DataFrame:
    series = adaptive_series(_event_posts(spark, sf), ["click", "error"])
    return series.withColumn("ts_period", _day_text("ts_period"))


_MONTHLY = """WITH picked AS (
  SELECT o_orderdate AS moment, o_orderpriority AS e FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')
), span AS (
  SELECT floor((epoch_us(max(moment)) - epoch_us(min(moment))) / 86400000000.0) > 90 AS monthly FROM picked
), periods AS (
  SELECT strftime(CASE WHEN monthly THEN date_trunc('month', moment) ELSE date_trunc('day', moment) END, '%Y-%m-%d') AS ts_period, e
  FROM picked, span
)"""


@query(_MONTHLY + " SELECT ts_period, e AS predicted_emotions, count(*) AS count FROM periods GROUP BY ALL")
def ts_monthly(spark: SparkSession, sf: str) -> DataFrame:
    series = adaptive_series(bare_posts(spark, sf), ["1-URGENT", "5-LOW"])
    return series.withColumn("ts_period", _day_text("ts_period"))


@query(_MONTHLY + """ SELECT ts_period, count(*) FILTER (e = '5-LOW') AS "5-LOW",
  count(*) FILTER (e = '1-URGENT') AS "1-URGENT" FROM periods GROUP BY 1""")
def ts_pivot(spark: SparkSession, sf: str) -> DataFrame:
    series = adaptive_series(bare_posts(spark, sf), ["5-LOW", "1-URGENT"])
    return pivot_series(series, ["5-LOW", "1-URGENT"]).withColumn("ts_period", _day_text("ts_period"))


@query(f"""WITH {POSTS}, lists AS (
  SELECT moment, unnest([predicted_emotions, topic]) AS l FROM posts
), picked AS (
  SELECT date_trunc('month', moment) AS m, upper(l[1]) || lower(l[2:]) AS l FROM lists WHERE l IN ('1-URGENT', 'O')
)
SELECT strftime(m, '%Y-%m-%d') AS ts_period, count(*) FILTER (l = 'O') AS "O", count(*) FILTER (l = '1-urgent') AS "1-urgent"
FROM picked GROUP BY 1""")
def ts_of_label_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Posts with several labels: days are counted per list, and the counts taken apart."""
    listed = bare_posts(spark, sf).withColumn(
        "predicted_emotions", F.concat_ws(",", "predicted_emotions", "topic")
    )
    series = adaptive_series(listed, ["O", "1-urgent"], explode=explode_labels)
    return pivot_series(series, ["O", "1-urgent"]).withColumn("ts_period", _day_text("ts_period"))


@query("""SELECT 'events' AS source,
  floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0)::BIGINT AS days FROM events
UNION ALL SELECT 'orders',
  floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000.0)::BIGINT FROM orders""")
def ts_span(spark: SparkSession, sf: str) -> DataFrame:
    one = spark.range(1)
    events = one.select(F.lit("events").alias("source"), span_days(table(spark, sf, "events"), "ts").alias("days"))
    orders = one.select(F.lit("orders").alias("source"), span_days(bare_posts(spark, sf), "Date").alias("days"))
    return events.unionByName(orders)


_WINDOW = "moment BETWEEN TIMESTAMP '1998-03-14' AND TIMESTAMP '1998-07-14'"


@query(f"""WITH {LONG}
SELECT strftime(date_trunc('week', moment), '%Y-%m-%d') AS ts_period, party, predicted_emotions, count(*) AS count
FROM long WHERE {_WINDOW} AND predicted_emotions IN ('1-urgent', '2-high')
  AND party IN ('BUILDING', 'MACHINERY') GROUP BY ALL""")
def event_window_weekly(spark: SparkSession, sf: str) -> DataFrame:
    series = event_series(
        posts(spark, sf), "1998-05-14", 2,
        emotions=[" 1-URGENT", "2-high ", "unheard of"], parties=["BUILDING", "MACHINERY"],
        selected=["5-low"], explode=explode_labels,
    )
    return series.withColumn("ts_period", _day_text("ts_period"))


@query(f"""WITH {LONG}, weeks AS (
  SELECT strftime(date_trunc('week', moment), '%Y-%m-%d') AS ts_period, party, predicted_emotions, count(*) AS count
  FROM long WHERE {_WINDOW} GROUP BY ALL)
SELECT 'selected occur' AS run, * FROM weeks WHERE predicted_emotions = '5-low'
UNION ALL SELECT 'selected do not occur', * FROM weeks
UNION ALL SELECT 'given do not occur', * FROM weeks WHERE false""")
def event_window_fallback(spark: SparkSession, sf: str) -> DataFrame:
    labelled = posts(spark, sf)
    runs = {
        "selected occur": {"selected": ["5-low", "unheard of"]},
        "selected do not occur": {"selected": ["unheard of"]},
        "given do not occur": {"emotions": ["unheard of"], "selected": ["5-low"]},
    }
    parts = [
        event_series(labelled, "1998-05-14", 2, explode=explode_labels, **options).withColumn("run", F.lit(run))
        for run, options in runs.items()
    ]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.withColumn("ts_period", _day_text("ts_period"))


@query("""SELECT o_orderkey AS "ID", strftime(CASE o_orderstatus
    WHEN 'O' THEN o_orderdate - INTERVAL 3 HOUR WHEN 'F' THEN o_orderdate END, '%Y-%m-%d %H:%M:%S') AS moment
FROM orders""")
def parse_post_dates(spark: SparkSession, sf: str) -> DataFrame:
    # Three spellings: a post date with an offset, an ISO date, and no date at all.
    day = F.date_format("Date", "EEE MMM dd HH:mm:ss")
    written = (
        F.when(F.col("topic") == "O", F.concat(day, F.lit(" +0300 "), F.date_format("Date", "yyyy")))
        .when(F.col("topic") == "F", F.date_format("Date", "yyyy-MM-dd"))
        .otherwise(F.concat(F.lit("Xyz "), F.substring(day, 5, 32)))
    )
    moment = parse_datetime(written)
    return bare_posts(spark, sf).select(
        "ID", F.date_format(moment, "yyyy-MM-dd HH:mm:ss").alias("moment")
    )


@query("""SELECT 'events' AS source, 'timestamp' AS "column", count(ts) AS readable FROM events
UNION ALL SELECT 'orders', 'Date', count(o_orderdate) FROM orders
UNION ALL SELECT 'spelled otherwise', 'none', 0
UNION ALL SELECT 'documents', 'none', 0""")
def column_probing(spark: SparkSession, sf: str) -> DataFrame:
    frames = {
        "events": _event_posts(spark, sf),
        "orders": bare_posts(spark, sf),
        # Only an exact spelling counts.
        "spelled otherwise": bare_posts(spark, sf).withColumnRenamed("Date", "DATE"),
        "documents": table(spark, sf, "documents"),
    }
    parts = []
    for source, frame in frames.items():
        moment = moment_of(frame)
        readable = F.count(moment) if moment is not None else F.lit(0).cast("bigint")
        parts.append(frame.agg(readable.alias("readable")).select(
            F.lit(source).alias("source"), F.lit(datetime_column(frame) or "none").alias("column"), "readable"
        ))
    return union_sources(parts)
