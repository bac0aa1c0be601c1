from pyspark.sql import functions as F

from affectframe.functions.times import month_start
from affectframe.operators.sketches import DISTINCT_ERROR, RANK_ERROR, daily_sketches, estimates, merged


def test_merged_days_against_one_pass_and_the_exact_way(spark):
    posts = spark.range(60_000).select(
        F.date_add(F.lit("2023-05-01").cast("date"), (F.col("id") % 50).cast("int")).alias("d"),
        F.when(F.col("id") % 7 > 0, F.lit("a")).otherwise("b").alias("k"),
        (F.col("id") * 7919 % 20_011).alias("author"), (F.col("id") * 31 % 10_007).cast("double").alias("value"),
    )
    odd = spark.createDataFrame([(None, "a", 1, 1.0), (None, None, None, None)], "d date, k string, author long, value double")
    posts = posts.unionByName(odd)
    days = daily_sketches(posts, F.col("d"), ["k"], "author", "value")
    assert days.count() == 100
    got = {(str(r.period), r.k): r for r in estimates(merged(days, month_start, ["k"]), (0.1, 0.5)).collect()}
    months = posts.na.drop().withColumn("period", month_start(F.col("d")))
    once = months.groupBy("period", "k").agg(F.hll_sketch_agg("author", F.lit(14)).alias("s"))
    once = once.groupBy("period", "k").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("x"))
    exact = months.groupBy("period", "k").agg(F.count("*").alias("n"), F.count_distinct("author").alias("authors"))
    for r in exact.join(once, ["period", "k"]).collect():
        mine = got[str(r.period), r.k]
        assert mine.n == r.n and abs(mine.distinct_values - r.x) <= DISTINCT_ERROR / 2 * r.authors
        assert abs(mine.distinct_values - r.authors) <= DISTINCT_ERROR * r.authors
        for name, fraction in (("q10", 0.1), ("q50", 0.5)):
            below = months.filter((F.col("period") == r.period) & (F.col("k") == r.k) & (F.col("value") <= mine[name])).count()
            assert abs(below / r.n - fraction) <= RANK_ERROR
    assert len(got) == 4
