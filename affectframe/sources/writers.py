"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affectframe.functions.text import slug
from affectframe.operators.split import label_map
from affectframe.sources.readers import label_map_json


def write_table(df: DataFrame, path: str) -> None:
    """Replace a table (Parquet)."""
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
    """CSV as data-frame tools read it: quotes doubled, white space kept, lists comma-joined."""
    lists = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    flat = df.withColumns({name: F.array_join(name, ",") for name in lists}) if lists else df
    flat.write.mode(mode).options(
        header=True, quote='"', escape='"', encoding="UTF-8",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).options(**options).csv(path)


def append_posts(posts: DataFrame, path: str, author: str = "Author") -> None:
    """Append to a table partitioned by author.

    Rows are first rebalanced by author: small authors share tasks, so they do not
    leave one tiny file per task, and a hot author is split over several.
    """
    posts.hint("rebalance", F.col(author)).write.mode("append").partitionBy(author).parquet(path)


def write_label_map(spark: SparkSession, path: str, labels: Sequence[str]) -> None:
    """Write the label map as one small JSON document."""
    document = spark.createDataFrame([(label_map_json(label_map(labels)),)], "value string")
    document.coalesce(1).write.mode("overwrite").text(path)


def chart_name(index: int, label: str) -> Column:
    """Name under which the data of a chart are stored: running number and slug."""
    return F.concat(F.lit(f"{index}_"), slug(F.lit(label)))
