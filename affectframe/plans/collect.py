"""From landed posts to the table of eligible raw posts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affectframe.constants import COLLECT_FROM
from affectframe.functions.times import parse_post_date, utc_naive
from affectframe.operators.dedupe import drop_repeated
from affectframe.operators.filters import drop_ceremonial, drop_replies, drop_reposts, since as from_day
from affectframe.operators.joins import drop_matching, keep_matching
from affectframe.operators.ranking import cap_per_author
from affectframe.schemas import RAW_POSTS
from affectframe.session import new_dir
from affectframe.sources.files import remove
from affectframe.sources.versions import Versions


def eligible(
    posts: DataFrame, moment: Column, *, since: str = COLLECT_FROM, zone: str = "UTC"
) -> DataFrame:
    """Posts since a day that are neither reposts, replies nor ceremonial messages."""
    posts = from_day(posts, moment, since, zone)
    return drop_ceremonial(drop_replies(drop_reposts(posts)))


def collect_posts(
    landed: DataFrame,
    *,
    since: str = COLLECT_FROM,
    zone: str = "UTC",
    per_author: int | None = None,
    path: str | None = None,
) -> DataFrame:
    """Eligible posts, one of each ID; if asked for, the newest ``per_author`` of each author.

    Eligible posts are stored below ``path`` (or in a new folder of the shared one)
    first: landed text files are read and their texts looked at once, and the steps
    after that read single columns of the stored table where they can.
    """
    spark = landed.sparkSession
    path = path or new_dir(spark, "eligible")
    dated = landed.withColumn("ts", parse_post_date(F.col("Date")))
    eligible(dated, F.col("ts"), since=since, zone=zone).write.mode("overwrite").parquet(path)
    posts = drop_repeated(spark.read.parquet(path))
    if per_author is not None:
        posts = cap_per_author(posts, per_author)
    return posts.select(*RAW_POSTS.fieldNames())


# What the table consists of. A post's key is known in every run; the keys are ordered by
# hash buckets, so looking posts up skips row groups of other buckets and reads no text.
POSTS = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in RAW_POSTS.fields)}, key string, day date"
KEYS = "key string, Author string, ts timestamp, ID bigint, bucket int"
BUCKETS = 1024
# The newest posts of each author, by buckets of authors; the kind's name ends with the limit.
_NEWEST = "newest-"


def stored_posts(spark: SparkSession, table: str) -> DataFrame:
    """The table of raw posts, with its own types; empty if nothing was collected yet.

    If the last run had a limit per author, each author's newest posts of all runs.
    """
    versions = Versions(spark, table)
    posts = versions.read("posts", POSTS)
    for kind in sorted(versions.kinds()):
        if kind.startswith(_NEWEST):
            posts = keep_matching(posts, versions.read(kind, KEYS), "key")
    return posts


def rejected_posts(spark: SparkSession, table: str) -> DataFrame:
    """Landed posts that no rule could judge because their date is unreadable, by run."""
    return Versions(spark, table).read("rejected", RAW_POSTS)


def _bucket(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket")


def _keyed(posts: DataFrame) -> DataFrame:
    """Posts with the key that they have in every run: the ID, else all that is known of them."""
    content = F.md5(F.to_json(F.struct("Author", "Text", "Date")))
    key = F.when(F.col("ID").isNotNull(), F.col("ID").cast("string")).otherwise(content)
    day = utc_naive(F.col("ts")).cast("date")
    return posts.withColumn("key", key).withColumns({"bucket": _bucket("key"), "day": day})


def unseen(fresh: DataFrame, versions: Versions, run: str) -> DataFrame:
    """The posts whose keys no other run has stored; reads the index of keys only."""
    buckets = [row.bucket for row in fresh.select("bucket").distinct().collect()]
    known = versions.read("keys", KEYS, besides=run).filter(F.col("bucket").isin(buckets))
    return drop_matching(fresh, known.select("key"), "key")


def newest_posts(new: DataFrame, versions: Versions, run: str, n: int) -> tuple[DataFrame, list[int] | None]:
    """The newest n posts of each author that has new ones, and which buckets of authors they replace.

    Equal posts without an ID are one here. The state holds n posts an author at most. What a replaced run had pushed out of it is
    not there any more: then, and at first, the index of keys is gone through (buckets: None).
    """
    spark, kind = new.sparkSession, f"{_NEWEST}{n}"
    added = new.select("key", "Author", "ts", "ID").withColumn("bucket", _bucket("Author"))
    if run in versions.runs("keys") or kind not in versions.kinds():
        buckets = None
        before = versions.read("keys", KEYS, besides=run).withColumn("bucket", _bucket("Author"))
    else:
        buckets = sorted(row.bucket for row in added.select("bucket").distinct().collect())
        before = versions.read(kind, KEYS).filter(F.col("bucket").isin(buckets))
    both = before.drop("run").unionByName(added).withColumn("_order", F.struct("ID", "key"))
    path = new_dir(spark, "newest")
    both.dropDuplicates(["key"]).write.parquet(path)
    return cap_per_author(spark.read.parquet(path), n, id="_order").drop("_order"), buckets


def collect_into(
    landed: DataFrame, table: str, *, run: str | None = None, since: str = COLLECT_FROM, zone: str = "UTC",
    per_author: int | None = None,
) -> None:
    """Add the landed posts that the table does not have yet.

    Posts are looked up in the index of keys, so a second run over the same files adds
    nothing, and old posts may come at any time. The rows of a run replace those that an
    earlier try of it (the same ``run``) has left. Posts with an unreadable date are stored
    as well, for :func:`rejected_posts`. A limit per author holds over all runs, in
    whatever order they come; all posts stay stored, the limit is one of reading. Posts,
    keys and limits show at once when the run is done; a run that fails shows nothing.
    """
    spark, run = landed.sparkSession, run or uuid.uuid4().hex
    versions, work = Versions(spark, table), new_dir(spark, "collect")

    def stored(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{work}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{work}/{name}")

    # Landed text is read once.
    dated = stored(landed.withColumn("ts", parse_post_date(F.col("Date"))), "dated")
    names = RAW_POSTS.fieldNames()
    posts = drop_repeated(stored(eligible(dated, F.col("ts"), since=since, zone=zone), "eligible"))
    fresh = stored(_keyed(posts.select(*names, "ts")), "fresh")
    new = stored(unseen(fresh, versions, run), "new")
    rows = {
        "posts": new.select(*names, "key", "day"), "keys": _by_bucket(new.select("key", "Author", "ts", "ID", "bucket")),
        "rejected": dated.filter(F.col("ts").isNull()).select(*names),
    }
    instead, whole = {}, {kind for kind in versions.kinds() if kind.startswith(_NEWEST)}
    if per_author is not None:
        kind = f"{_NEWEST}{per_author}"
        newest, buckets = newest_posts(new, versions, run, per_author)
        rows[kind] = _by_bucket(newest)
        whole.add(kind)
        if buckets is not None:
            instead[kind] = ("bucket", buckets)
            whole.discard(kind)
    versions.commit(rows, run, by={"posts": ["day"]}, instead=instead, whole=sorted(whole))
    remove(spark, work)


def compact_table(spark: SparkSession, table: str) -> None:
    """Few files for each day, and of keys, instead of some for each run; readers are not disturbed."""
    versions = Versions(spark, table)
    for kind in sorted(versions.kinds()):
        if kind in ("posts", "rejected"):
            versions.compact(kind, POSTS if kind == "posts" else RAW_POSTS, ["day"] if kind == "posts" else [])
        else:
            versions.compact(kind, KEYS, arranged=_by_bucket)
