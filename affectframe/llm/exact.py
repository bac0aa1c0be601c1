"""Exact duplicates, found through an extendible-hash index on shared files.

The index is built over the texts' hashes. A directory over their leading bits tells which
bucket a hash is in. It starts with one slot and doubles until no bucket holds more than
``capacity`` hashes; a bucket that was small enough at an earlier depth keeps that depth,
and several slots lead to it. Rows find their bucket through the directory alone.

Texts are moved only to buckets where their hash occurs again, and copies are combined in
the tasks that read them, so a text that a third of all rows have leaves each task once.
There they are compared as a whole, byte by byte: the key of the aggregation is bucket,
hash and text. Different texts that share a hash become a chain of entries. Tasks own
ranges of buckets and write the chained entries, in order, to shared files, where rows look
up their group by bucket, hash and place in the chain.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affectframe.llm.common import ascii_lower, join_counted, stored

# Entries of a bucket. A bucket is read as a whole by one task; an entry has about 100 bytes.
CAPACITY = 50_000

_MAX_DEPTH = 62


def slot(h: Column, depth: int) -> Column:
    """The leading bits of a hash."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("bigint")


@dataclass(frozen=True)
class Index:
    """``entries``: ``bucket, h, chain, chain_length, sha256, group_size, keep_id``, stored by
    ranges of buckets. ``directory``: ``slot, bucket, local_depth, n_rows`` at the global
    ``depth``; slots without entries are absent. ``rows``: ``id, h, sha256`` of all rows."""

    entries: DataFrame
    directory: DataFrame
    depth: int
    rows: DataFrame
    total: int

    def located(self, rows: DataFrame) -> DataFrame:
        """Rows that have a hash ``h``, with the bucket that the directory names for it."""
        slotted = rows.withColumn("slot", slot(F.col("h"), self.depth))
        return join_counted(slotted, self.directory, "slot", "n_rows", self.total).drop("slot", "local_depth", "n_rows")


def build_directory(hashes: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """Directory for a table of different hashes ``h``, and its global depth."""
    depth, total = 0, hashes.count()
    while total > capacity << depth:  # with fewer slots some bucket is overfull for sure
        depth += 1
    while True:
        slots = hashes.groupBy(slot(F.col("h"), depth).alias("slot")).agg(F.count("*").alias("n"))
        slots = stored(slots, "directory")
        if depth >= _MAX_DEPTH or (slots.agg(F.max("n")).first()[0] or 0) <= capacity:
            break
        depth += 1  # doubling: each slot becomes two
    # What each bucket would hold at each depth: the shallowest that is no more than full stays.
    levels = slots.select(
        "slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("local_depth")
    ).withColumn("bucket", F.expr(f"shiftrightunsigned(slot, {depth} - local_depth)"))
    sizes = levels.groupBy("local_depth", "bucket").agg(F.sum("n").alias("held"))
    fits = levels.join(sizes, ["local_depth", "bucket"]).filter(
        (F.col("held") <= capacity) | (F.col("local_depth") == depth)
    )
    local = fits.groupBy("slot").agg(F.min("local_depth").alias("local_depth"))
    # A bucket is named by its first slot, so names follow the order of the hashes.
    first = F.expr(f"shiftleft(shiftrightunsigned(slot, {depth} - local_depth), {depth} - local_depth)")
    return stored(local.select("slot", first.alias("bucket"), "local_depth"), "directory"), depth


def build_index(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    capacity: int = CAPACITY,
    normalise: Callable[[Column], Column] = ascii_lower,
    hash_of: Callable[[Column], Column] = F.xxhash64,
) -> Index:
    """Index of all texts, compared after ``normalise``; null texts count as empty."""
    body = normalise(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(F.col(id_col).alias("id"), body.alias("body")).select(
        "id", "body", hash_of(F.col("body")).cast("bigint").alias("h")
    )
    rows = stored(texts.select("id", "h", F.sha2("body", 256).alias("sha256")), "hashes")
    counted = rows.groupBy("h").agg(F.count("*").alias("n"), F.max("id").alias("keep_id"), F.min("sha256").alias("sha256"))
    counted = stored(counted, "counted")
    total = rows.count()
    directory, depth = build_directory(counted.select("h"), capacity)
    held = counted.groupBy(slot(F.col("h"), depth).alias("slot")).agg(F.sum("n").alias("n_rows"))
    index = Index(rows, stored(directory.join(held, "slot"), "directory"), depth, rows, total)
    # A hash that one row has is one entry; its text stays where it is.
    one = F.lit(1).cast("bigint")
    single = index.located(counted.filter("n = 1")).select("bucket", "h", one.alias("group_size"), "keep_id", "sha256")
    # Others are compared by their texts in the bucket that the directory sends them to.
    again = index.located(counted.filter("n > 1")).select("bucket", "h", "n")
    again = stored(again, "again")
    moved = join_counted(texts, again, "h", "n", total).drop("n")
    groups = moved.groupBy("bucket", "h", "body").agg(F.count("*").alias("group_size"), F.max("id").alias("keep_id"))
    found = groups.select("bucket", "h", "group_size", "keep_id", F.sha2("body", 256).alias("sha256"))
    found = stored(found.unionByName(single), "found")
    chained = found.repartitionByRange("bucket", "h").withColumns({
        "chain": F.row_number().over(Window.partitionBy("bucket", "h").orderBy("sha256")),
        "chain_length": F.count("*").over(Window.partitionBy("bucket", "h")),
    })
    entries = chained.select(
        "bucket", "h", "chain", "chain_length", "sha256", "group_size", "keep_id"
    ).sortWithinPartitions("bucket", "h", "chain")
    return Index(stored(entries, "index"), index.directory, depth, rows, total)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: ``id, keep_id, group_size, kept, sha256``.

    Of equal texts the row with the largest id stays. Defined cases: a null text equals
    an empty one; a null id is less than any other; if several rows share the largest
    id (or all ids are null), exactly one of them stays; an empty table gives an empty
    one. Columns other than the two named are not looked at. Options as for
    :func:`build_index`.
    """
    index = build_index(docs, id_col, text_col, **options)
    # Rows alike in id and text are told apart by an ordinal only, so they are counted.
    alike = index.rows.groupBy("id", "h", "sha256").agg(F.count("*").alias("times"))
    alike = stored(index.located(alike), "alike")
    entries = index.entries.select("bucket", "h", "sha256", "group_size", "keep_id")
    placed = join_counted(alike, entries, ["bucket", "h", "sha256"], "group_size", index.total)
    each = placed.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))
    return each.select(
        "id", "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        "sha256",
    )
