"""Distinct authors and quantiles by month, from daily sketches, held against the exact way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affectframe.functions.times import month_start
from affectframe.operators.sketches import DISTINCT_ERROR, RANK_ERROR, daily_sketches, estimates, merged
from affectframe.queries.registry import query, table


@query("""SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS period, o_orderpriority AS priority, count(*) AS posts,
  count(DISTINCT o_custkey) AS authors, true AS authors_close, true AS median_close FROM orders GROUP BY ALL""")
def sketched_months(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "priority")
    days = daily_sketches(orders, F.col("o_orderdate"), ["priority"], "o_custkey", "o_totalprice")
    found = estimates(merged(days, month_start, ["priority"]))
    month = orders.withColumn("period", month_start(F.col("o_orderdate")))
    judged = month.join(found.select("period", "priority", "q50"), ["period", "priority"])
    exact = judged.groupBy("period", "priority").agg(
        F.count_distinct("o_custkey").alias("authors"), F.avg((F.col("o_totalprice") <= F.col("q50")).cast("int")).alias("upto"),
        F.avg((F.col("o_totalprice") < F.col("q50")).cast("int")).alias("below"),
    )
    off = F.abs(F.col("distinct_values") - F.col("authors"))
    return found.join(exact, ["period", "priority"]).select(
        F.date_format("period", "yyyy-MM-dd").alias("period"), "priority", F.col("n").alias("posts"), "authors",
        (off <= F.greatest(F.lit(1.0), F.col("authors") * DISTINCT_ERROR)).alias("authors_close"),
        ((F.col("below") <= 0.5 + RANK_ERROR) & (F.col("upto") >= 0.5 - RANK_ERROR)).alias("median_close"),
    )
