"""Distinct values and quantiles over any period, from sketches kept by day.

A day's sketch has a bounded size whatever the number of its posts, and sketches of days
merge into those of weeks, months or any range; so no post is read again for another period.
The exact way is a count of distinct values, or a sort, over the posts of the period.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Distinct counts are off by 1.04 / sqrt(2 ** LG_K) or so: 0.8 percent, three times that at most
# for nearly all. Ranks of quantiles are off by about 1.3 percent with K = 200.
LG_K, K = 14, 200
DISTINCT_ERROR, RANK_ERROR = 0.025, 0.03


def daily_sketches(posts: DataFrame, moment: Column, keys: Sequence[str], distinct: str, value: str) -> DataFrame:
    """``day``, the keys, ``n`` and a sketch of distinct values and of quantiles for each day and key.

    Built in the map tasks; one row per task, day and key is shuffled. Posts without a day
    or a key are left out; null values count in ``n`` only.
    """
    rows = posts.withColumn("day", moment.cast("date")).na.drop(subset=["day", *keys])
    return rows.groupBy("day", *keys).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(distinct, F.lit(LG_K)).alias("distinct"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(K)).alias("quantiles"),
    )


def merged(sketches: DataFrame, period: Callable[[Column], Column], keys: Sequence[str]) -> DataFrame:
    """``period``, the keys, ``n`` and merged sketches, for periods that consist of days."""
    days = sketches.withColumn("period", period(F.col("day"))).groupBy("period", *keys)
    listed = days.agg(
        F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("distinct"),
        F.sort_array(F.collect_list(F.struct("day", "quantiles"))).alias("days"),
    )
    # In the order of the days, so the result does not depend on the partitioning.
    rest = F.slice("days", 2, F.greatest(F.size("days"), F.lit(1)))
    quantiles = F.aggregate(rest, F.get("days", F.lit(0))["quantiles"], lambda q, d: F.kll_sketch_merge_double(q, d["quantiles"]))
    return listed.withColumn("quantiles", quantiles).drop("days")


def estimates(sketches: DataFrame, fractions: Sequence[float] = (0.5,)) -> DataFrame:
    """The sketches' ``distinct_values``, and the quantiles ``q50`` and so on."""
    quantiles = {f"q{round(100 * f)}": F.kll_sketch_get_quantile_double("quantiles", F.lit(f)) for f in fractions}
    return sketches.withColumns({"distinct_values": F.hll_sketch_estimate("distinct"), **quantiles}).drop("distinct", "quantiles")
