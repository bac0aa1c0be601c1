"""How often each word occurs, counted in the task that reads the post.

Words of a post are counted before anything is joined or shuffled: a repeated word is one
row, and a post's rows need no shuffle to be counted. Batches are counted in slices of a
bounded number of words.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affectframe.functions.text import spaced_words

# Functions that run in tasks travel with them: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes of text whose words are counted at once (or those of one post).
SLICE = 4 << 20


def runs(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """First and last row (exclusive) of runs of rows that are together no longer than the limit, or of one row."""
    ends, first = np.cumsum(lengths, dtype=np.int64), 0
    while first < len(lengths):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield first, last
        first = last


def slices(spaced: pa.Array) -> Iterator[tuple[int, int, np.ndarray, pa.Array]]:
    """Runs of rows: first, last, and of every word (or empty string) its row and itself. A null text has none."""
    for first, last in runs(pc.binary_length(spaced).fill_null(0).to_numpy(zero_copy_only=False), SLICE):
        lists = pc.split_pattern(spaced.slice(first, last - first), " ")
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        yield first, last, np.repeat(np.arange(first, last), lengths), lists.flatten()


def _counted(group: np.ndarray, words: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Group, word and number of each different word of a group; empty strings are no words."""
    coded = words.dictionary_encode()
    key, n = np.unique(group << 32 | coded.indices.to_numpy(), return_counts=True)
    code = key & 0xFFFFFFFF
    empty = coded.dictionary.index(pa.scalar("", coded.dictionary.type)).as_py()
    kept = code != empty
    return key[kept] >> 32, coded.dictionary.take(pa.array(code[kept])), n[kept]


def _per_post(keys: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, row, values in slices(batch.column("_spaced")):
                row, token, n = _counted(row, values)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in keys], token, pa.array(n)], [*keys, "token", "tf"])

    return run


def words_of_posts(posts: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """``token, tf`` for each different word of each row, with its keys; nothing is shuffled."""
    listed = posts.select(*keys, spaced_words(F.col(text)).alias("_spaced"))
    schema = T.StructType([
        *[listed.schema[k] for k in keys], T.StructField("token", T.StringType()), T.StructField("tf", T.LongType()),
    ])
    return listed.mapInArrow(_per_post(keys), schema)


def _per_word(keys: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, row, values in slices(batch.column("_spaced")):
                row, token, n = _counted(row, values)
                coded = token.dictionary_encode()
                code = coded.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(code, kind="stable")
                ends = pa.array(np.append(0, np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))), pa.int32())
                at = pa.array(row[order])
                lists = [batch.column(k).take(at) for k in keys] + [pa.array(n[order], pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [coded.dictionary, *[pa.ListArray.from_arrays(ends, x) for x in lists]], ["token", *keys, "tf"]
                )

    return run


def posts_of_words(posts: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """For each different word of a slice of rows the keys of the rows that hold it, and ``tf``, as arrays.

    The word stands once for all these rows; nothing is shuffled.
    """
    listed = posts.select(*keys, spaced_words(F.col(text)).alias("_spaced"))
    schema = T.StructType([
        T.StructField("token", T.StringType()),
        *[T.StructField(k, T.ArrayType(listed.schema[k].dataType)) for k in keys],
        T.StructField("tf", T.ArrayType(T.IntegerType())),
    ])
    return listed.mapInArrow(_per_word(keys), schema)
