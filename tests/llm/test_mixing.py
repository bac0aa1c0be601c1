import pytest
from pyspark.sql import functions as F

from affectframe.llm.mixing import mix, mixed_words, source_targets

from .conftest import same_columns


def shares(sizes, weights=(1, 2, 3), most=3):
    """Targets by cutting one source after the other."""
    names = sorted(sizes)
    weight = {s: weights[n % len(weights)] for n, s in enumerate(names)}
    cut, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in cut]
        if not free:
            return cut
        share = (total - sum(cut.values())) / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > most * sizes[s]]
        if not over:
            return cut | {s: share * weight[s] for s in free}
        cut |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 2, "d": 5}, {"a": 0, "b": 7}, {"a": 5},
    {f"s{n:02}": (n * 37) % 91 for n in range(25)}, {"a": 0},
])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "key string, size long")
    got = {r.key: r.target for r in source_targets(frame).collect()}
    assert got == pytest.approx(shares(sizes))


def test_copies_of_messy_rows(messy):
    rows = mixed_words(messy).collect()
    assert len(rows) == messy.count()
    for r in rows:
        assert r.taken in ({0} if not r.size else {r.size * k for k in range(4)})
        if r.size:
            assert abs(r.taken / r.size - r.target / r.source_size) < 1
    assert sorted(map(tuple, mixed_words(messy.repartition(7)).collect()), key=repr) == sorted(map(tuple, rows), key=repr)


def test_the_mix_holds_what_was_counted(messy):
    out = mix(messy)
    same_columns(out, messy)
    words = F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))
    assert out.agg(words).first()[0] == mixed_words(messy).agg(F.sum("taken")).first()[0]


def test_no_rows(nothing):
    assert mix(nothing).collect() == [] and mixed_words(nothing).collect() == []


def test_taken_words_come_near_the_targets(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 5).cast("string")).alias("source"),
    )
    source = F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 5).cast("string"))
    rows = mixed_words(docs).groupBy(source).agg(F.sum("taken").alias("taken"), F.max("target").alias("target"))
    for r in rows.collect():
        assert r.taken == pytest.approx(r.target, rel=0.06)


def test_texts_stay_in_the_jvm(spark):
    # Batches that held each row and its text again made the mix outgrow its executors.
    docs = spark.createDataFrame([(1, "a\tb\x0bc\u00a0d  e", "x"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.size) for r in mixed_words(docs).withColumnRenamed("id", "doc_id").collect()) == [(1, 4), (2, 0)]
    for rows in (mix(docs), mixed_words(docs)):
        plan = rows._jdf.queryExecution().toString()
        assert "InArrow" not in plan and "Python" not in plan
