"""Removal of repeated posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affectframe.constants import BROADCAST_BYTES
from affectframe.session import new_dir
from affectframe.tables import is_bounded


def drop_repeated(posts: DataFrame, key: str = "ID", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per key; rows without a key are no copies of each other, and all stay.

    Copies are rare, so their keys are looked up first, by a count that moves nothing
    but keys. If those keys are few enough to be broadcast, only their rows are
    shuffled to be merged, and all others stay where they are. A key with a large
    part of all rows is merged in the map tasks.
    """
    spark, path = posts.sparkSession, new_dir(posts.sparkSession, "repeated")
    repeated = (
        posts.na.drop(subset=[key]).groupBy(F.col(key).alias("_key")).count()
        .filter(F.col("count") > 1).select("_key")
    )
    # Stored, so that keys, which may be hashes of texts, are worked out once to be counted.
    repeated.write.parquet(path)
    repeated = spark.read.schema(repeated.schema).parquet(path)
    if not is_bounded(repeated, max_bytes):
        keyless = posts.filter(posts[key].isNull())
        return posts.na.drop(subset=[key]).dropDuplicates([key]).unionByName(keyless)
    is_repeated = posts[key] == repeated["_key"]
    single = posts.join(F.broadcast(repeated), is_repeated, "left_anti")
    copies = posts.join(F.broadcast(repeated), is_repeated, "left_semi")
    return single.unionByName(copies.dropDuplicates([key]))
