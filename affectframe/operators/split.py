"""Label index and stratified split."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affectframe.constants import MAX_CLASSES
from affectframe.operators.joins import join_on_key
from affectframe.operators.ranking import numbered, seeded_order
from affectframe.session import new_dir

# Rows are binned by this many hexadecimal digits of their hash.
_BIN_DIGITS = 4


def class_counts(
    df: DataFrame, label: str, *, weight: Column | None = None, max_classes: int = MAX_CLASSES
) -> dict:
    """Row count (or sum of weights) of each label, alphabetically, on the driver.

    Runs one job that reads only these columns. A column with more values than a label
    set may have is refused, which also bounds every table with one row per label.
    """
    total = F.count("*") if weight is None else F.sum(weight)
    counts = df.na.drop(subset=[label]).groupBy(label).agg(total)
    rows = counts.limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"more than {max_classes} classes in column {label!r}")
    return dict(sorted((row[0], row[1]) for row in rows))


def label_index(df: DataFrame, label: str) -> DataFrame:
    """Labels in alphabetical order with their position, ``(idx, label)``, however many there are."""
    labels = df.select(F.col(label).alias("label")).na.drop().distinct()
    placed = numbered(labels, "label", "idx", new_dir(df.sparkSession, "labels"))
    return placed.select(F.col("idx").cast("int").alias("idx"), "label")


def split_quotas(counts: Mapping, fraction: float = 0.15) -> dict:
    """How many rows of each label to hold out.

    Together they are the fraction of all rows, rounded up. Each label gets the
    floor of its part; what is left goes to the largest remainders, equal
    remainders alphabetically.
    """
    rows = sum(counts.values())
    held = math.ceil(rows * fraction)
    quotas = {label: held * n // rows for label, n in counts.items()}
    by_remainder = sorted(counts, key=lambda label: (-(held * counts[label] % rows), label))
    for label in by_remainder[: held - sum(quotas.values())]:
        quotas[label] += 1
    return quotas


def quota_table(counts: DataFrame, fraction: float, path: str) -> DataFrame:
    """``label, quota`` for a table of ``label, count``, as :func:`split_quotas` has them."""
    rows = counts.agg(F.sum("count")).first()[0] or 0
    held = math.ceil(rows * fraction)
    part = F.col("count").cast("decimal(19,0)") * F.lit(held).cast("decimal(19,0)")
    whole = F.lit(max(rows, 1)).cast("decimal(19,0)")
    rest = (part % whole).cast("bigint")
    floors = counts.select(
        "label", ((part - rest) / whole).cast("bigint").alias("floor"),
        F.struct((-rest).alias("rest"), F.col("label").alias("label")).alias("order"),
    )
    floors = numbered(floors, "order", "place", f"{path}/quotas")
    left = held - (floors.agg(F.sum("floor")).first()[0] or 0)
    return floors.select("label", (F.col("floor") + (F.col("place") < left).cast("bigint")).alias("quota"))


def _split_cuts(df: DataFrame, label: str, id: str, fraction: float, seed: int, path: str) -> DataFrame:
    """Per label: hash of the last row to hold out, how many rows have it, and how many of
    them to hold out, as ``_label, _cut, _tied, _hold``.

    Whole labels are never ranked. Rows are counted per bin of their hash; in the bin
    where a label's quota is reached the rows are ranked to find the quota-th one.
    Counts and cuts are small and written below ``path``, so nothing is counted twice.
    """
    spark = df.sparkSession
    keyed = df.select(
        F.col(label).alias("_label"), seeded_order(id, seed).alias("_hash")
    ).withColumn("_bin", F.substring("_hash", 1, _BIN_DIGITS))
    # Rows with one hash are counted first, so an ID that very many rows share is one row.
    counted = keyed.groupBy("_label", "_bin", "_hash").agg(F.count("*").alias("_tied"))
    counted.groupBy("_label", "_bin").agg(F.sum("_tied").alias("count")).write.mode("overwrite").parquet(f"{path}/bins")
    bins = spark.read.parquet(f"{path}/bins")

    sizes = bins.groupBy(F.col("_label").alias("label")).agg(F.sum("count").alias("count"))
    quotas = quota_table(sizes, fraction, path).withColumnRenamed("label", "_label")
    upto = F.sum("count").over(Window.partitionBy("_label").orderBy("_bin"))
    reached = (F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("count") < F.col("quota"))
    cut_bins = (
        bins.withColumn("_upto", upto).join(quotas, "_label").filter(reached)
        .select("_label", "_bin", (F.col("quota") - F.col("_upto") + F.col("count")).alias("_take"))
    )
    order = Window.partitionBy("_label").orderBy("_hash")
    cuts = (
        counted.join(cut_bins, ["_label", "_bin"])
        .withColumn("_through", F.sum("_tied").over(order))
        .filter((F.col("_through") >= F.col("_take")) & (F.col("_through") - F.col("_tied") < F.col("_take")))
        .select(
            "_label", F.col("_hash").alias("_cut"), "_tied",
            (F.col("_take") - F.col("_through") + F.col("_tied")).alias("_hold"),
        )
    )
    cuts.write.mode("overwrite").parquet(f"{path}/cuts")
    return spark.read.parquet(f"{path}/cuts")


def stratified_split(
    df: DataFrame,
    label: str,
    id: str,
    *,
    fraction: float = 0.15,
    seed: int = 42,
    held: str = "held_out",
    path: str | None = None,
) -> DataFrame:
    """The frame with a flag for rows held out, exactly the quota of every label.

    Within a label the rows with the lowest seeded hashes are held out. The cut of each
    label is looked up at once, by jobs that read only label and ID; the frame itself is
    then flagged row by row and not moved. Only where several rows share the ID at the
    cut, and some of them go to either side, these are ranked by their contents. Rows
    without a label are dropped; those without an ID share a hash.
    """
    df = df.na.drop(subset=[label])
    path = path or new_dir(df.sparkSession, "split")
    cuts = _split_cuts(df, label, id, fraction, seed, path)
    key = seeded_order(id, seed)
    # One row per label at most; a quota of zero has no cut.
    cut = join_on_key(df, cuts.withColumnRenamed("_label", label), label, "left")
    below = F.coalesce(key <= F.col("_cut"), F.lit(False))
    if cuts.filter("_hold < _tied").isEmpty():
        return cut.withColumn(held, below).drop("_cut", "_tied", "_hold")
    parted = F.coalesce((key == F.col("_cut")) & (F.col("_hold") < F.col("_tied")), F.lit(False))
    content = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    place = F.row_number().over(Window.partitionBy(label).orderBy(content))
    sides = [
        cut.filter(~parted).withColumn(held, below),
        cut.filter(parted).withColumn(held, place <= F.col("_hold")),
    ]
    return sides[0].unionByName(sides[1]).drop("_cut", "_tied", "_hold")


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def label_map(labels: Sequence[str]) -> dict[str, dict]:
    """Both directions of a label index and the list itself, as stored next to a model."""
    return {
        "id2label": {str(i): name for i, name in enumerate(labels)},
        "label2id": {name: i for i, name in enumerate(labels)},
        "emotion_labels": list(labels),
    }
