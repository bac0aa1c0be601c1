"""Sources. All schemas are declared, nothing is inferred."""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affectframe.functions.text import missing_to_null
from affectframe.operators.joins import author_key
from affectframe.schemas import (
    AUTHORS,
    EMOTION_CATALOGUE,
    LABELLED_POSTS,
    LANDED_POSTS,
    RAW_POSTS,
    TRAINING_SET,
    check_header,
    first_present,
    require_columns,
)
from affectframe.sources.files import file_names, header

# Files of posts carry this mark in their names; dimension files beside them do not.
POST_FILES = "*_tweets_*.csv"

# Files whose headers are read at the same time.
OPENED_AT_ONCE = 32


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    *,
    needed: Sequence[str] | None = None,
    files: str | None = None,
) -> DataFrame:
    """The columns of a schema, bound by the names in each file's header.

    Files may list their columns in any order and have further ones; files with the same
    header are read together. A file without a ``needed`` column (all, if not given) is
    refused; other columns that a file lacks are null. Texts hold commas, doubled quotes
    and line breaks. A file with quoted line breaks is read by one task: land many files
    of moderate size, not one large file.
    """
    needed = schema.fieldNames() if needed is None else needed
    by_header: dict[tuple[str, ...], list[str]] = {}
    names = file_names(spark, path, files)
    # Opening a file is mostly waiting, so many are opened at once.
    with ThreadPoolExecutor(OPENED_AT_ONCE) as pool:
        for name, columns in zip(names, pool.map(lambda name: header(spark, name), names), strict=True):
            by_header.setdefault(columns, []).append(name)
    by_header.pop((), None)
    frames = []
    for columns, names in by_header.items():
        check_header(columns, needed, names[0])
        known = {field.name: field for field in schema.fields if field.name in columns}
        # Names of no interest need only differ.
        placed = [known.get(name) or T.StructField(f"_{i}", T.StringType()) for i, name in enumerate(columns)]
        rows = spark.read.schema(T.StructType(placed)).options(
            header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8"
        ).csv(names)
        frames.append(rows.select(*[
            F.col(f.name) if f.name in known else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields
        ]))
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)


def _clean_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumns({k: missing_to_null(F.col(k)) for k in keys if k in df.columns})


def read_posts(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    files: str | None = POST_FILES,
    schema: T.StructType = LANDED_POSTS,
) -> DataFrame:
    """All post files of one or more folders as one table.

    The column that tells replies may be absent; it is null then.
    """
    needed = [name for name in schema.fieldNames() if name in RAW_POSTS.fieldNames()]
    return _clean_keys(read_csv(spark, path, schema, needed=needed, files=files), ["Author"])


def read_authors(spark: SparkSession, path: str) -> DataFrame:
    """The author dimension, ``@`` signs removed from the names."""
    authors = _clean_keys(read_csv(spark, path, AUTHORS), AUTHORS.fieldNames())
    return authors.withColumn("Author", author_key(F.col("Author")))


def read_emotion_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, EMOTION_CATALOGUE)


def read_training_set(spark: SparkSession, path: str) -> DataFrame:
    return _clean_keys(read_csv(spark, path, TRAINING_SET), ["emotion"])


def read_labelled(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Labelled posts for analysis; ``ValueError`` if author, party or labels are absent."""
    needed = ["Author", "party", "predicted_emotions"]
    if format == "parquet":
        return require_columns(spark.read.parquet(path), needed)
    posts = read_csv(spark, path, LABELLED_POSTS, needed=needed)
    return _clean_keys(posts, ["Author", "party", "political_side", "topic", "predicted_emotions"])


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a scan hashed over all cores, if the scan has fewer tasks than there are.

    A file of one row group is read by one task, and costly work on its texts would
    stay there. A scan of many files, as any large one is, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def text_column(df: DataFrame) -> str:
    """``Text`` if there is one, else the first column."""
    return first_present(df, ["Text"]) or df.columns[0]


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Tables of the same kind one after the other; columns absent in one are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def full_text(df: DataFrame, full: str = "full_text", short: str = "text") -> DataFrame:
    """Add ``Text``: the full text where given, else the short one."""
    columns = [F.col(c) for c in (full, short) if c in df.columns]
    return df.withColumn("Text", F.coalesce(*columns))


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """Label map file as a table ``(idx, label)``; the file's keys are strings."""
    entries = F.from_json("value", "id2label map<string,string>")["id2label"]
    typed = F.transform_keys(entries, lambda k, _: k.cast("int"))
    return spark.read.text(path, wholetext=True).select(F.explode(typed).alias("idx", "label"))


def label_map_json(mapping: dict) -> str:
    return json.dumps(mapping, ensure_ascii=False, indent=2)
