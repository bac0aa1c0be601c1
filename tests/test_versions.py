"""Versioned tables, the index of keys, limits over runs and running counts."""

import random

import pytest
from pyspark.sql import functions as F

from affectframe.plans.collect import KEYS, collect_into, compact_table, newest_posts, rejected_posts, stored_posts, unseen
from affectframe.plans.running import RunningCounts
from affectframe.sources.versions import Versions, publish, published

SCHEMA = "k int, v string"


def rows(versions, kind="t"):
    return sorted((r.k, r.v, r.run) for r in versions.read(kind, SCHEMA).collect())


def frame(spark, *values):
    return spark.createDataFrame([(k, f"v{k}") for k in values], SCHEMA)


def test_runs_replace_their_own_rows(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"))
    assert rows(table) == [] and table.numbers() == []
    table.commit({"t": frame(spark, 1, 2)}, "a", by={"t": ["k"]})
    table.commit({"t": frame(spark, 3), "other": frame(spark, 9)}, "b", by={"t": ["k"]})
    table.commit({"t": frame(spark, 2, 4)}, "a", by={"t": ["k"]})
    want = [(2, "v2", "a"), (3, "v3", "b"), (4, "v4", "a")]
    assert rows(table) == want
    assert rows(table, "other") == [(9, "v9", "b")]
    assert [r.k for r in table.read("t", SCHEMA, number=1).collect()] in ([1, 2], [2, 1])
    assert [r.k for r in table.read("t", SCHEMA, besides="a").collect()] == [3]
    table.compact("t", SCHEMA, ["k"])
    assert rows(table) == want and len([p for p in table.parts() if p["kind"] == "t"]) == 1
    # A run inside the common part can still be replaced, and by nothing as well.
    table.commit({"t": frame(spark, 7)}, "a", by={"t": ["k"]})
    assert rows(table) == [(3, "v3", "b"), (7, "v7", "a")]
    table.commit({"t": frame(spark)}, "b", by={"t": ["k"]})
    assert rows(table) == [(7, "v7", "a")]
    table.compact("t", SCHEMA)
    table.forget(keep=1)
    assert rows(table) == [(7, "v7", "a")] and len(table.numbers()) == 1
    assert len(list((tmp_path / "t" / "t").glob("part=*"))) == 1


def test_a_failed_write_shows_nothing(spark, tmp_path):
    path = str(tmp_path / "result")
    publish(frame(spark, 1, 2), path)
    before = published(spark, path, SCHEMA)
    with pytest.raises(Exception, match="stopped"):
        publish(frame(spark, 3).withColumn("v", F.raise_error(F.lit("stopped")).cast("string")), path)
    assert sorted(r.k for r in published(spark, path, SCHEMA).collect()) == [1, 2]
    publish(frame(spark, 5), path)
    # Who has begun to read the old version can go on.
    assert sorted(r.k for r in before.collect()) == [1, 2]
    assert [r.k for r in published(spark, path, SCHEMA).collect()] == [5]
    # A version file that its writer did not finish is no version yet.
    number = Versions(spark, path).numbers()[-1] + 1
    (tmp_path / "result" / "versions" / f"{number:010}.json").write_text('[{"kind": "res')
    assert [r.k for r in published(spark, path, SCHEMA).collect()] == [5]


def test_of_two_writers_the_second_fails(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"))
    table.commit({"t": frame(spark, 1)}, "a")
    slow = Versions(spark, str(tmp_path / "t"))
    start = slow.numbers()
    table.commit({"t": frame(spark, 2)}, "b")
    with pytest.raises(Exception, match="(?i)exist"):
        slow._show([], start)
    assert rows(table) == [(1, "v1", "a"), (2, "v2", "b")]


def landed(spark, posts):
    day = "Mon Mar {:02d} 10:{:02d}:00 +0000 2021"
    found = [(i, author, f"text {i} of the day", None if t is None else day.format(1 + t // 60, t % 60)) for i, author, t in posts]
    return spark.createDataFrame(found, "ID long, Author string, Text string, Date string").withColumn(
        "in_reply_to_status_id", F.lit(None).cast("long")
    )


def newest(posts, n):
    best = {}
    for i, author, t in sorted({p for p in posts if p[2] is not None}, key=lambda p: (-p[2], -p[0])):
        best.setdefault(author, []).append(i)
    return sorted(i for ids in best.values() for i in ids[:n])


def test_limit_over_runs_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    posts = [(i, rng.choice(["ann", "bob", "cy", None]), rng.choice([*range(0, 900, 40), None])) for i in range(80)]
    for trial in range(2):
        rng.shuffle(posts)
        table = str(tmp_path / f"t{trial}")
        runs = [posts[:30], posts[20:55], posts[50:]]
        for number, part in enumerate(runs):
            collect_into(landed(spark, part), table, run=f"r{number}", per_author=5)
        assert sorted(r.ID for r in stored_posts(spark, table).collect()) == newest(posts, 5)
    # Tried again with fewer posts: what had been pushed out by the others comes back.
    collect_into(landed(spark, posts[50:60]), table, run="r2", per_author=5)
    assert sorted(r.ID for r in stored_posts(spark, table).collect()) == newest(posts[:60], 5)
    compact_table(spark, table)
    assert sorted(r.ID for r in stored_posts(spark, table).collect()) == newest(posts[:60], 5)
    # Another limit, and none, hold from the run on that has them.
    collect_into(landed(spark, []), table, run="r3", per_author=7)
    assert sorted(r.ID for r in stored_posts(spark, table).collect()) == newest(posts[:60], 7)
    collect_into(landed(spark, []), table, run="r4")
    assert stored_posts(spark, table).count() == sum(t is not None for _, _, t in posts[:60])
    assert rejected_posts(spark, table).count() >= sum(t is None for _, _, t in posts[:60])


def test_the_lookup_reads_keys_of_the_buckets_at_hand_only(spark, tmp_path):
    table = str(tmp_path / "t")
    collect_into(landed(spark, [(i, "ann", i) for i in range(200)]), table, run="a", per_author=3)
    versions = Versions(spark, table)
    fresh = spark.createDataFrame([("5", 3), ("x", 4)], "key string, bucket int")
    found = unseen(fresh, versions, "b")
    assert all("/keys/" in f for f in found.inputFiles()) and found.inputFiles()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(bucket, [3,4])" in plan.split("PushedFilters")[1] and "Text" not in plan
    new = stored_posts(spark, table).limit(0).withColumn("ts", F.current_timestamp())
    state, buckets = newest_posts(new, versions, "b", 3)
    assert buckets == [] and state.count() == 0
    assert versions.read("newest-3", KEYS).count() == 3


def test_new_counts_read_no_old_posts(spark, tmp_path):
    counts = RunningCounts(spark, str(tmp_path / "counts"), ["k"])
    days = spark.createDataFrame([("2023-05-01", "a"), ("2023-05-07", "a"), ("2023-05-08", None), (None, "a")], "d string, k string")
    days.write.parquet(str(tmp_path / "old"))
    days.write.parquet(str(tmp_path / "new"))
    moment = F.col("d").cast("timestamp_ntz")
    counts.add(spark.read.parquet(str(tmp_path / "old")), moment, "one")
    added = counts.of(spark.read.parquet(str(tmp_path / "new")), moment)
    assert all("/new/" in f for f in added.inputFiles())
    counts.add(spark.read.parquet(str(tmp_path / "new")).filter("d < '2023-05-05'"), moment, "two")
    assert [(str(r.period), r.k, r["count"]) for r in counts.series("week").collect()] == [("2023-05-01", "a", 3)]
    assert all("/counts/" in f for f in counts.series("week").inputFiles())
    counts.compact()
    counts.add(days.limit(0), moment, "one")
    assert [(str(r.period), r.k, r["count"]) for r in counts.series("month").collect()] == [("2023-05-01", "a", 1)]
    assert [(r.k, r.percentage) for r in counts.shares("day", []).collect()] == [("a", 100.0)]
