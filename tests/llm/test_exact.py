import hashlib

import pytest
from pyspark.sql import functions as F

from affectframe.llm import common, exact
from affectframe.llm.common import ascii_lower
from affectframe.llm.exact import build_directory, exact_groups


def expected(docs):
    rows = [(r.doc_id, "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")) for r in docs.collect()]
    groups = {}
    for i, body in rows:
        groups.setdefault(body, []).append(i)
    out = []
    for body, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        stays = ids.index(keep)
        out += [
            (i, keep, len(ids), n == stays, hashlib.sha256(body.encode()).hexdigest()) for n, i in enumerate(ids)
        ]
    return sorted(out, key=repr)


def got(frame):
    return sorted(map(tuple, frame.select("id", "keep_id", "group_size", "kept", "sha256").collect()), key=repr)


def test_messy_rows(messy):
    assert got(exact_groups(messy)) == expected(messy)


@pytest.mark.parametrize("modulus", [1, 3])
def test_texts_with_equal_hashes_become_chains(messy, modulus):
    weak = exact_groups(messy, capacity=2, hash_of=lambda body: F.pmod(F.xxhash64(body), F.lit(modulus)))
    assert got(weak) == expected(messy)


def test_small_buckets_give_the_same_groups(messy):
    assert got(exact_groups(messy, capacity=1)) == expected(messy)


def test_rows_find_their_group_through_the_directory(messy, monkeypatch):
    """A directory that names a wrong bucket loses the rows."""
    right = exact.Index.located

    def wrong(self, rows):
        shifted = "times" in rows.columns
        return right(self, rows).withColumn("bucket", F.col("bucket") + (1 if shifted else 0))

    monkeypatch.setattr(exact.Index, "located", wrong)
    assert exact_groups(messy, capacity=1).count() == 0


def test_joins_beyond_broadcasts(messy, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    assert got(exact_groups(messy, capacity=2)) == expected(messy)


def test_texts_move_only_where_their_hash_occurs_again(spark):
    docs = spark.createDataFrame([(i, f"text {i % 90}") for i in range(100)], "doc_id long, text string")
    index = exact.build_index(docs, capacity=10)
    sizes = index.entries.groupBy("bucket").agg(F.count("*").alias("n")).collect()
    assert max(r.n for r in sizes) <= 10 and sum(r.n for r in sizes) == 90
    assert index.entries.filter("group_size = 2").count() == 10 and index.depth > 2


def test_no_rows(nothing):
    assert exact_groups(nothing).collect() == []


def test_directory_doubles_until_no_bucket_is_overfull(spark):
    hashes = spark.range(1000).select(F.xxhash64("id").alias("h"))
    directory, depth = build_directory(hashes, 50)
    buckets = hashes.withColumn("slot", F.shiftrightunsigned("h", 64 - depth)).join(directory, "slot")
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.max("local_depth").alias("d")).collect()
    assert sum(r.n for r in sizes) == 1000
    assert max(r.n for r in sizes) <= 50
    assert min(r.d for r in sizes) < depth  # small buckets keep their earlier depth


def test_only_a_to_z_are_folded(evaluate):
    values = ["ABZ", "É", "aÑB", "ⅠA", "İI", "ẞ", "plain", ""]
    assert evaluate(values, ascii_lower) == ["abz", "É", "aÑb", "Ⅰa", "İi", "ẞ", "plain", ""]
