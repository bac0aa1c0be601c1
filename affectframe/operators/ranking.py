"""Top rows per group, caps, samples and report lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affectframe.constants import SALTS
from affectframe.functions.text import preview
from affectframe.operators.joins import hot_keys, split_hot


def numbered(table: DataFrame, key: str, number: str, path: str) -> DataFrame:
    """The rows with their places, from 0, in the order of a unique key; stored below ``path``.

    Ranges of the key are sorted side by side; only the ranges' row counts are added up.
    """
    spark = table.sparkSession
    ranged = table.repartitionByRange(key).withColumn("_part", F.spark_partition_id())
    ranged.write.mode("overwrite").parquet(f"{path}/ranged")
    ranged = spark.read.parquet(f"{path}/ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    placed = ranged.withColumn(number, place).join(sizes, "_part")
    placed = placed.withColumn(number, (F.col(number) + F.col("_before"))).drop("_part", "_before")
    placed.write.mode("overwrite").parquet(f"{path}/numbered")
    return spark.read.parquet(f"{path}/numbered")


def top_n_per_group(
    df: DataFrame,
    keys: str | Sequence[str],
    order: Sequence[Column],
    n: int,
    *,
    spread: str | None = None,
    rank: str = "rank",
) -> DataFrame:
    """The first n rows of each group by ``order``, numbered from 1.

    Spark limits each group to n rows in the map tasks already (WindowGroupLimit).
    Where few groups hold very many rows, name a unique column as ``spread``: the limit
    is then taken in slices of each group first, so that even with many map tasks no
    single task receives the rows of all of them. The slices' winners contain the
    group's winners, so the result is the same.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if spread is not None:
        slices = Window.partitionBy(*keys, F.pmod(F.xxhash64(spread), F.lit(SALTS)))
        df = (
            df.withColumn("_first", F.row_number().over(slices.orderBy(*order)))
            .filter(F.col("_first") <= n)
            .drop("_first")
        )
    groups = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(groups)).filter(F.col(rank) <= n)


def top_counts(
    counts: DataFrame, group: str | Sequence[str], label: str = "predicted_emotions", n: int = 3
) -> DataFrame:
    """The n most frequent labels of each group; equal counts by label."""
    return top_n_per_group(counts, group, [F.desc("count"), F.asc(label)], n)


def top_line(
    top: DataFrame, group: str, label: str = "predicted_emotions", rank: str = "rank"
) -> DataFrame:
    """One line ``group: A=3, B=2`` per group of a top-n table."""
    entry = F.concat(F.col(label), F.lit("="), F.col("count").cast("string"))
    entries = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("at"), entry.alias("text"))))
    texts = F.transform(entries, lambda e: e["text"])
    return top.groupBy(group).agg(F.array_join(texts, ", ").alias("_entries")).select(
        group, F.concat(F.col(group), F.lit(": "), F.col("_entries")).alias("line")
    )


def cap_per_author(
    posts: DataFrame, n: int, *, author: str = "Author", moment: str = "ts", id: str = "ID"
) -> DataFrame:
    """The newest n posts of each author.

    Most authors write little, and their posts are shuffled once. Only those of authors
    with a large part of all posts are limited in slices before.
    """
    order = [F.desc(moment), F.desc(id)]
    busy, others = split_hot(posts, author, hot_keys(posts, author))
    capped = top_n_per_group(others, author, order, n)
    return capped.unionByName(top_n_per_group(busy, author, order, n, spread=id)).drop("rank")


def first_per_label(
    posts: DataFrame,
    labels: Sequence[str],
    n: int = 5,
    *,
    label: str = "predicted_emotions",
    id: str = "ID",
) -> DataFrame:
    """The first n posts by ID of each listed label, with label position and ordinal.

    Only posts with exactly one of the labels count; a list of two labels is none.
    """
    chosen = posts.filter(F.col(label).isin(list(labels)))
    first = top_n_per_group(chosen, label, [F.asc(id)], n, spread=id, rank="ordinal")
    position = F.array_position(F.array(*[F.lit(name) for name in labels]), F.col(label))
    return first.withColumn("label_position", position.cast("int"))


def seeded_order(id: str, seed: int = 42) -> Column:
    """A key that shuffles rows the same way in every run and on every cluster."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id).cast("string")))


def sample_per_group(
    df: DataFrame, group: str, n: int = 5, *, id: str = "ID", seed: int = 42
) -> DataFrame:
    """Up to n rows of each group, drawn by a seeded hash of the ID."""
    order = [seeded_order(id, seed), F.asc(id)]
    return top_n_per_group(df, group, order, n, spread=id, rank="ordinal")


def sample_report(samples: DataFrame, group: str, text: str = "Text", length: int = 200) -> DataFrame:
    """Numbered previews of a sample, with the group name as heading."""
    return samples.select(
        F.upper(group).alias("heading"), "ordinal", preview(F.col(text), length).alias("preview")
    )
