"""Names and first lines of files, in any store that Spark reads."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file, file.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    file, store = _at(spark, path)
    return store.exists(file)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate rows that this program has written."""
    file, store = _at(spark, path)
    store.delete(file, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if there is no such folder."""
    file, store = _at(spark, path)
    return [entry.getPath().getName() for entry in store.listStatus(file)] if store.exists(file) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    file, store = _at(spark, path)
    stream = store.open(file)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file; fails if there is one of that name."""
    file, store = _at(spark, path)
    stream = store.create(file, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def file_names(spark: SparkSession, path: str | Sequence[str], files: str | None = None) -> list[str]:
    """The files of folders, patterns or single paths; their contents are not read."""
    reader = spark.read.format("binaryFile")
    if files:
        reader = reader.option("pathGlobFilter", files)
    listed = reader.load(path if isinstance(path, str) else list(path)).select("path")
    return sorted(row.path for row in listed.collect())


def header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The column names in a CSV file's first line; none if the file is empty."""
    file, store = _at(spark, path)
    io = spark._jvm.java.io
    stream = store.open(file)
    try:
        line = io.BufferedReader(io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()
    return tuple(next(csv.reader([line.removeprefix("\ufeff")]), ())) if line else ()
