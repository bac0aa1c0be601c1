"""Incremental ingest of landed posts, and counts over the stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from affectframe.constants import COLLECT_FROM
from affectframe.functions.times import utc_naive
from affectframe.plans.collect import collect_into
from affectframe.sources.readers import POST_FILES, read_posts
from affectframe.sources.versions import Versions, publish

# How late a copy of an event may arrive.
LATENESS = "7 days"

# A batch's file names go through the driver.
FILES_PER_BATCH = 10_000

_FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_files(
    spark: SparkSession,
    path: str,
    *,
    format: str = "parquet",
    schema: T.StructType | str,
    files: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Files of a folder as a stream; each file is read once, in the order of arrival."""
    reader = spark.readStream.format(format).schema(schema)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def drop_repeated(
    stream: DataFrame, keys: Sequence[str] = ("ID",), moment: str = "ts", lateness: str = LATENESS
) -> DataFrame:
    """One event per key. State is kept only as long as a copy may still arrive, and
    events older than that are dropped: for events in order, not for posts.

    Watermarks want a timestamp with a zone: pass zone-less ones through ``utc_instant``.
    """
    return stream.withWatermark(moment, lateness).dropDuplicatesWithinWatermark(list(keys))


def append_to(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    *,
    partition_by: Sequence[str] = (),
) -> StreamingQuery:
    """Append the rows to a Parquet table until the files present now are used up.

    The checkpoint remembers what was read: the next run goes on from there.
    """
    writer = stream.writeStream.format("parquet").outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return (
        writer.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def ingest(
    spark: SparkSession,
    landing: str,
    table: str,
    checkpoint: str,
    *,
    since: str = COLLECT_FROM,
    zone: str = "UTC",
    per_author: int | None = None,
    files: str | None = POST_FILES,
    files_per_batch: int | None = FILES_PER_BATCH,
) -> StreamingQuery:
    """Landed post files to the table of eligible posts, as :func:`plans.collect.collect_into`.

    The stream consists of the files' names; each batch reads its files by their headers
    and adds what the table does not have, whatever the posts' dates. A batch that is
    tried again replaces its own rows. A limit per author holds over all batches.
    """
    names = stream_files(
        spark, landing, format="binaryFile", schema=_FILE, files=files, files_per_batch=files_per_batch
    ).select("path")

    def store(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        paths = [row.path for row in batch.collect()]
        if paths:
            query = session.sparkContext.getLocalProperty("sql.streaming.queryId")
            collect_into(
                read_posts(session, paths, files=None), table, run=f"{query}-{number}",
                since=since, zone=zone, per_author=per_author,
            )

    return (
        names.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def weekly_counts(stream: DataFrame, moment: str, keys: Sequence[str]) -> DataFrame:
    """Counts per week (from Monday) and key; rows with a null key are left out."""
    keys = list(keys)
    # Windows are aligned to a Thursday, the first day of 1970.
    week = F.window(moment, "7 days", "7 days", "4 days")
    counts = stream.na.drop(subset=[moment, *keys]).groupBy(week.alias("_week"), *keys).count()
    start = utc_naive(F.col("_week.start")).cast("date")
    return counts.select(start.alias("week"), *keys, "count")


def maintain_table(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a result table complete: every batch publishes all groups so far.

    Only whole results are right for open weeks; an append would withhold them. Readers
    (:func:`sources.versions.published`) find the last whole result, also while the next
    one is written, and after a batch that fails. The last two results are kept.
    """

    def replace(batch: DataFrame, _batch_id: int) -> None:
        publish(batch, path)
        Versions(batch.sparkSession, path).forget()

    return (
        result.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(replace)
        .trigger(availableNow=True)
        .start()
    )
