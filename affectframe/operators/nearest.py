"""The nearest of very many prototypes, exactly, without comparing each vector with all.

Prototypes of unit length are grouped around some of them. No member of a group is nearer to
a vector than the group's centre less the group's radius (the triangle inequality), so groups
that cannot hold anything nearer than what was found are skipped. The most promising group
comes first; the others are compared in tiles of many groups and vectors, in single
precision, and only vectors for which a tile may hold something better meet it in doubles.
Cosines follow from distances between vectors of unit length.

Vectors that lie in all directions skip no group: the job is then quadratic, spread evenly
over all cores and bounded in memory.

Prototypes are taken in blocks of bounded size, each sent to the tasks in its turn, and the
best so far goes with the vector from block to block; so their number is not limited.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affectframe.operators.ranking import numbered
from affectframe.session import new_dir

# Functions that run in tasks travel with them: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Numbers of the prototypes that are sent to the tasks at once, and vectors and prototypes compared at once.
BLOCK_VALUES, ROWS, TILE = 1 << 23, 1_024, 1_024
# Tasks of a pass for each core.
_TASKS = 2
# Bounds are computed in doubles; they are moved by more than these can be off.
_SLACK = 1e-6
# Products in doubles that differ by less may be equal; pairs whose products are taken one by one at once.
_EQUAL, _PAIRS = 1e-12, 1 << 16


class Groups:
    """Prototypes of unit length with their places, in groups around every so many-th of them."""

    def __init__(self, places: np.ndarray, unit: np.ndarray):
        n = len(unit)
        chosen = unit[np.linspace(0, n - 1, max(1, int(np.sqrt(n)))).astype(int)] if n else unit
        group = np.concatenate([
            np.argmax(unit[at:at + ROWS] @ chosen.T, axis=1) for at in range(0, n, ROWS)
        ]) if n else np.zeros(0, np.int64)
        order = np.lexsort((places, group))
        self.places, self.unit = places[order], unit[order]
        used, self.starts = np.unique(group[order], return_index=True)
        self.ends = np.append(self.starts[1:], n)[: len(used)]
        self.centres = chosen[used]
        self.radii = np.array([
            np.sqrt(np.maximum(2 - 2 * (self.unit[s:e] @ c), 0).max()) for s, e, c in zip(self.starts, self.ends, self.centres, strict=True)
        ])
        self._single = None

    def _tiles(self) -> Iterator[slice]:
        """Groups one after the other, in runs of at most so many prototypes (or one group)."""
        first = 0
        while first < len(self.starts):
            last = max(first + 1, int(np.searchsorted(self.ends, self.starts[first] + TILE, side="right")))
            yield slice(first, last)
            first = last

    def _compare(self, x: np.ndarray, rows: np.ndarray, own: slice, place: np.ndarray, cosine: np.ndarray) -> None:
        """Offer some prototypes to some of the vectors, in doubles; of equals the lowest place stays."""
        found = x[rows] @ self.unit[own].T
        top = found.max(axis=1)
        better = top >= cosine[rows] - _EQUAL
        row, column = np.nonzero((found >= top[:, None] - _EQUAL) & better[:, None])
        for at in range(0, len(row), _PAIRS):
            r, c = rows[row[at:at + _PAIRS]], own.start + column[at:at + _PAIRS]
            # One by one, as a product of matrices may round equal vectors differently.
            value = np.einsum("ij,ij->i", x[r], self.unit[c])
            order = np.lexsort((self.places[c], -value, r))
            order = order[np.append(True, np.diff(r[order]) > 0)]
            r, value, at_ = r[order], value[order], self.places[c[order]]
            wins = (value > cosine[r]) | ((value == cosine[r]) & (at_ < place[r]))
            place[r[wins]], cosine[r[wins]] = at_[wins], value[wins]

    def improve(self, x: np.ndarray, place: np.ndarray, cosine: np.ndarray) -> int:
        """Better prototypes for vectors of unit length, in place; returns how many comparisons it took."""
        if not len(self.unit) or not len(x):
            return 0
        if self._single is None:
            self._single = self.unit.astype(np.float32)
        nearest = np.sqrt(np.maximum(2 - 2 * (x @ self.centres.T), 0)) - self.radii - _SLACK
        np.square(np.maximum(nearest, 0, out=nearest), out=nearest)
        # Rounding of a product in single precision is in proportion to the number of its terms.
        single, off = x.astype(np.float32), 1e-6 + x.shape[1] * 2.0**-22
        group, compared = np.argmin(nearest, axis=1), 0
        by_group = np.argsort(group, kind="stable")
        for rows in np.split(by_group, np.flatnonzero(np.diff(group[by_group])) + 1):
            own = slice(self.starts[group[rows[0]]], self.ends[group[rows[0]]])
            self._offer(x, single, rows, own, place, cosine, off)
            compared += len(rows) * (own.stop - own.start)
        # The first group's own bound is met; it need not be compared again on its own account.
        nearest[np.arange(len(x)), group] = np.inf
        for tile in self._tiles():
            open_ = nearest[:, tile] <= (2 - 2 * cosine + _SLACK)[:, None]
            rows, groups = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
            if not len(rows):
                continue
            own = slice(self.starts[tile.start + groups[0]], self.ends[tile.start + groups[-1]])
            self._offer(x, single, rows, own, place, cosine, off)
            compared += len(rows) * (own.stop - own.start)
        return compared

    def _offer(
        self, x: np.ndarray, single: np.ndarray, rows: np.ndarray, own: slice, place: np.ndarray, cosine: np.ndarray, off: float
    ) -> None:
        """Offer some prototypes to some of the vectors; products in single precision, ``off`` by so much, sort out most."""
        for start in range(own.start, own.stop, TILE):
            part = slice(start, min(start + TILE, own.stop))
            some = single if len(rows) == len(single) else single[rows]
            top = (some @ self._single[part].T).max(axis=1)
            able = rows[top >= cosine[rows] - off]
            if len(able):
                self._compare(x, able, part, place, cosine)


def _unit(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows can be compared (of this length, finite, not zero), and these at unit length."""
    lengths = np.where(np.asarray(column.is_null()), -1, np.asarray(column.value_lengths().fill_null(-1)))
    rows = np.flatnonzero(lengths == size)
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    x = values.astype(np.float64).reshape(len(rows), size if len(rows) else max(size or 0, 0))
    norm = np.sqrt((x * x).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], x[good] / norm[good, None]


def _pass(groups, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("_place").to_numpy(zero_copy_only=False).copy()
            cosine = batch.column("_cosine").to_numpy(zero_copy_only=False).copy()
            rows, x = _unit(batch.column("_vector"), size)
            for at in range(0, len(rows), ROWS):
                own = rows[at:at + ROWS]
                best, value = place[own], cosine[own]
                groups.value.improve(x[at:at + ROWS], best, value)
                place[own], cosine[own] = best, value
            names = batch.schema.names
            columns = [
                pa.array(place) if c == "_place" else pa.array(cosine) if c == "_cosine" else batch.column(c) for c in names
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def nearest_prototypes(
    vectors: DataFrame, id: str, vector: str, means: DataFrame, *, block_values: int = BLOCK_VALUES
) -> DataFrame:
    """``id, label, score``: the prototype with the highest cosine for each vector, and this cosine.

    ``means``: ``label, prototype array<double>``, any number of rows, labels unique. Of equal
    cosines the label that comes first wins. A vector that is null, zero, not finite or of
    another length than the prototypes has no label; prototypes like that are not looked at.
    """
    spark = vectors.sparkSession
    path = new_dir(spark, "nearest")
    listed = numbered(means.na.drop().select("label", "prototype"), "label", "place", path)
    n, size = listed.agg(F.count("*"), F.max(F.size("prototype"))).first()
    # Floats are as good as doubles, and half as long.
    kind = "array<float>" if vectors.schema[vector].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    # Every vector costs the same, however few files they come from.
    state = vectors.select(
        F.col(id).alias("_id"), F.col(vector).cast(kind).alias("_vector"),
        F.lit(-1).cast("bigint").alias("_place"), F.lit(-2.0).alias("_cosine"),
    ).repartition(spark.sparkContext.defaultParallelism * _TASKS)
    step = max(1, block_values // max(size or 1, 1))
    for number, start in enumerate(range(0, n, step)):
        block = listed.filter(F.col("place").between(start, start + step - 1)).select("place", "prototype").toArrow()
        rows, unit = _unit(block.column("prototype").combine_chunks(), size)
        places = block.column("place").to_numpy()[rows]
        groups = spark.sparkContext.broadcast(Groups(places.astype(np.int64), unit))
        state.mapInArrow(_pass(groups, size), state.schema).write.parquet(f"{path}/pass-{number}")
        groups.destroy()
        state = spark.read.schema(state.schema).parquet(f"{path}/pass-{number}")
    named = state.join(listed.select(F.col("place").alias("_place"), "label"), "_place", "left")
    score = F.when(F.col("_place") >= 0, F.col("_cosine"))
    return named.select(F.col("_id").alias(id), "label", score.cast(T.DoubleType()).alias("score"))
