"""Text classifier: multinomial logistic regression over hashed word counts.

Words are hashed into ``2 ** bits`` buckets; a post's feature is the share of its words in
a bucket, and one more, always 1, is the intercept. Hashed counts are stored once, so no
round reads a text. A round is one job: map tasks add up the gradient over their posts,
one row per bucket and task is shuffled, and the sums come to the driver, which holds the
weights. Their number is a matter of parameters (buckets times labels), not of the posts,
and is limited.

Steps are accelerated and scaled by bucket: the shares of a post add up to 1, so the sum
of a bucket's shares bounds its curvature, and no step size has to be chosen. A part of the
posts is held back. The weights with the least loss on it are kept, and the fit ends when
it has not fallen for some rounds. Gradients and losses are added up as whole numbers, so
the model does not depend on the partitioning, and a task that is tried again changes nothing.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affectframe.functions.scores import best, score_vector, softmax
from affectframe.functions.text import is_blank, spaced_words
from affectframe.operators.split import class_counts
from affectframe.operators.wordcounts import runs, slices
from affectframe.session import new_dir

# Functions that run in tasks travel with them: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Shares and probabilities are counted in these parts: with 10^12 posts, sums fit a long.
UNIT = 1 << 20
BITS, ROUNDS, PATIENCE, L2 = 18, 30, 3, 1e-4
# Hash digits that name a bucket, and bytes that the weights may take.
_DIGITS, MAX_BYTES = 5, 64 << 20
# Tasks of a round for each core: each sends one row per bucket.
_TASKS = 4
# Entries of the stored counts that are looked at together (or those of one post).
_ENTRIES = 1 << 19
_LOSS, _HELD_LOSS = -1, -2


@dataclass(frozen=True)
class LogisticModel:
    """Labels in order, and a table ``idx int, w array<double>``; the intercept's bucket is ``2 ** bits``.

    ``losses``: mean loss per round on the posts fitted and on those held back.
    """

    labels: tuple
    bits: int
    weights: DataFrame
    losses: tuple[tuple[float, float], ...]
    kept: int

    def dense(self) -> np.ndarray:
        out = np.zeros(((1 << self.bits) + 1, len(self.labels)))
        table = self.weights.toArrow()
        if table.num_rows:
            rows = table.column("w").combine_chunks().flatten().to_numpy()
            out[table.column("idx").to_numpy()] = rows.reshape(-1, len(self.labels))
        return out


def _buckets(words: list[bytes], bits: int) -> np.ndarray:
    """A word's bucket: the first digits of its MD5, which other engines know as well."""
    return np.array([int(hashlib.md5(w).hexdigest()[:_DIGITS], 16) for w in words], np.int64) % (1 << bits)


def is_held_back(text: Column) -> Column:
    """One post in sixteen, by its text: copies of a post are on the same side."""
    return F.substring(F.md5(text), 1, 1) == "0"


def _hashed(spaced: pa.Array, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows: first, last, and the row, bucket and number of every different hashed word."""
    for first, last, row, values in slices(spaced):
        coded = values.dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        # Each different word of a run is hashed once.
        codes = coded.indices.to_numpy()
        kept = np.array([w != b"" for w in words], bool)[codes]
        key, n = np.unique(row[kept] << 32 | _buckets(words, bits)[codes[kept]], return_counts=True)
        yield first, last, key >> 32, key & 0xFFFFFFFF, n


def _counted(bits: int):
    """Words to the different hashed ones with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, row, idx, n in _hashed(batch.column("words"), bits):
                offsets = pa.array(np.searchsorted(row, np.arange(first, last + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (idx, n)]
                own = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([own.column("y"), own.column("held"), *lists], ["y", "held", "idx", "n"])

    return run


_FEATURES = "y int, held boolean, idx array<int>, n array<int>"


def features(posts: DataFrame, text: str, label: str, labels: Sequence, bits: int = BITS) -> DataFrame:
    """``y, held, idx, n``: label number, part, buckets and counts of each post with a text and a label."""
    number = F.coalesce(F.lit(None).cast("int"), *[F.when(F.col(label) == name, F.lit(i)) for i, name in enumerate(labels)])
    rows = posts.na.drop(subset=[text, label]).select(
        number.cast("int").alias("y"), is_held_back(F.col(text)).alias("held"), spaced_words(F.col(text)).alias("words")
    )
    return rows.mapInArrow(_counted(bits), _FEATURES)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a bounded number of entries: a post may have very many."""
    for batch in batches:
        for first, last in runs(batch.column("idx").value_lengths().to_numpy(), _ENTRIES):
            yield batch.slice(first, last - first)


def _shares(batch: pa.RecordBatch, intercept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and share of every entry, the intercepts last."""
    idx, n = batch.column("idx"), batch.column("n").flatten().to_numpy().astype(np.float64)
    sizes = np.diff(idx.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    total = np.bincount(row, n, len(sizes))
    every = np.arange(len(sizes))
    return (
        np.concatenate([row, every]), np.concatenate([idx.flatten().to_numpy(), np.full(len(sizes), intercept)]),
        np.concatenate([n / total[row], np.ones(len(sizes))]),
    )


def _logits(weights: np.ndarray, row: np.ndarray, idx: np.ndarray, share: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(row, weights[idx, k] * share, n) for k in range(weights.shape[1])], axis=1)


def _sums(points, first: bool):
    """Per bucket the gradient by label (in the first round also the sum of shares), and the losses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = points.value
        size, k = weights.shape
        gradient, curvature = np.zeros((size, k), np.int64), np.zeros(size, np.int64)
        losses = {_LOSS: [0, 0], _HELD_LOSS: [0, 0]}
        for batch in _parts(batches):
            y, held = batch.column("y").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False)
            row, idx, share = _shares(batch, size - 1)
            z = _logits(weights, row, idx, share, len(y))
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            total = p.sum(axis=1, keepdims=True)
            p /= total
            at = np.arange(len(y))
            loss = np.rint((np.log(total[:, 0]) - z[at, y]) * UNIT).astype(np.int64)
            for side, rows in ((_LOSS, ~held), (_HELD_LOSS, held)):
                losses[side][0] += int(loss[rows].sum())
                losses[side][1] += int(rows.sum())
            p[at, y] -= 1.0
            fitted = ~held[row]
            row, idx, share = row[fitted], idx[fitted], share[fitted]
            # Sums of a batch are below 2^53, so doubles hold them exactly.
            for j in range(k):
                gradient[:, j] += np.bincount(idx, np.rint(p[row, j] * share * UNIT), size).astype(np.int64)
            if first:
                curvature += np.bincount(idx, np.rint(share * UNIT), size).astype(np.int64)
        used = np.flatnonzero(gradient.any(axis=1) | (curvature > 0))
        sums = np.column_stack([gradient[used], curvature[used]])
        for side, (loss, n) in losses.items():
            used = np.append(used, side)
            sums = np.vstack([sums, [loss, n] + [0] * (k - 1)])
        for start in range(0, len(used), 20_000):
            part = sums[start:start + 20_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(used[start:start + 20_000].astype(np.int32)), *[pa.array(part[:, j]) for j in range(k + 1)]],
                ["idx", *[f"g{j}" for j in range(k + 1)]],
            )

    return run


def gradient(stored: DataFrame, points: np.ndarray, first: bool = False) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[float, int]]]:
    """Sums over all posts at the given weights: gradient, sums of shares, and loss and posts by part."""
    spark, k = stored.sparkSession, points.shape[1]
    names = [f"g{j}" for j in range(k + 1)]
    schema = T.StructType([T.StructField("idx", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in names]])
    sent = spark.sparkContext.broadcast(points)
    tasks = stored.coalesce(spark.sparkContext.defaultParallelism * _TASKS)
    table = tasks.mapInArrow(_sums(sent, first), schema).groupBy("idx").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    sent.unpersist()
    idx, sums = table.column("idx").to_numpy(), np.column_stack([table.column(n).to_numpy() for n in names])
    out = np.zeros((points.shape[0], k + 1))
    out[idx[idx >= 0]] = sums[idx >= 0] / UNIT
    losses = {int(i): (row[0] / UNIT, int(row[1])) for i, row in zip(idx[idx < 0], sums[idx < 0], strict=True)}
    return out[:, :k], out[:, k], losses


def momenta(rounds: int) -> list[float]:
    """How far each round goes on in the direction of the last step."""
    found, t = [], 1.0
    for _ in range(rounds):
        following = (1 + math.sqrt(1 + 4 * t * t)) / 2
        found.append((t - 1) / following)
        t = following
    return found


def train(
    posts: DataFrame, text: str, label: str, *, bits: int = BITS, rounds: int = ROUNDS, patience: int = PATIENCE,
    l2: float = L2, path: str | None = None,
) -> LogisticModel:
    """Fit and store the model below ``path`` (or in a new folder of the shared one).

    Posts without a text or label are left out; a text without words has the intercept
    only. Each round's weights are stored as ``round-<n>``
    (:func:`resumed` reads them), the model as ``weights``.
    ``ValueError`` if the weights would take more than ``MAX_BYTES``.
    """
    spark = posts.sparkSession
    path = path or new_dir(spark, "logistic")
    labels = tuple(class_counts(posts.na.drop(subset=[text]), label))
    if ((1 << bits) + 1) * len(labels) * 8 > MAX_BYTES or not 0 < bits <= 4 * _DIGITS:
        raise ValueError(f"{1 << bits} buckets times {len(labels)} labels are too many weights")
    features(posts, text, label, labels, bits).write.mode("overwrite").parquet(f"{path}/features")
    stored = spark.read.schema(_FEATURES).parquet(f"{path}/features")
    at = np.zeros(((1 << bits) + 1, len(labels)))
    last, losses, curvature, kept, least, chosen = at, [], None, 0, math.inf, at
    for number, momentum in enumerate(momenta(rounds) if labels else ()):
        g, shares, found = gradient(stored, at, first=curvature is None)
        curvature = shares if curvature is None else curvature
        means = tuple(loss / max(n, 1) for loss, n in (found.get(_LOSS, (0.0, 0)), found.get(_HELD_LOSS, (0.0, 0))))
        losses.append(means)
        _store_round(spark, number, at, f"{path}/round-{number}")
        # Without posts held back, the loss on the others has to do.
        judged = means[1] if found.get(_HELD_LOSS, (0.0, 0))[1] else means[0]
        if judged < least:
            least, kept, chosen = judged, number, at
        elif number - kept >= patience:
            break
        step = at - (g + l2 * at) / (curvature + l2)[:, None]
        at, last = step + momentum * (step - last), step
    _store(spark, chosen, f"{path}/weights")
    weights = spark.read.schema("idx int, w array<double>").parquet(f"{path}/weights")
    return LogisticModel(labels, bits, weights, tuple(losses), kept)


def _store_round(spark: SparkSession, number: int, weights: np.ndarray, path: str) -> None:
    """A round's weights as one row, in the order of buckets and labels."""
    row = pa.table({"round": pa.array([number], pa.int32()), "body": pa.array([weights.tobytes()], pa.binary())})
    spark.createDataFrame(row).write.mode("overwrite").parquet(path)


def resumed(spark: SparkSession, path: str, labels: int) -> np.ndarray:
    """The weights of a stored round."""
    body = spark.read.schema("round int, body binary").parquet(path).first().body
    return np.frombuffer(body, np.float64).reshape(-1, labels)


def _store(spark: SparkSession, weights: np.ndarray, path: str) -> None:
    """The rows that are not all zero."""
    used = np.flatnonzero(weights.any(axis=1)) if weights.size else np.zeros(0, np.int64)
    offsets = pa.array((np.arange(len(used) + 1) * weights.shape[1]).astype(np.int32))
    lists = pa.ListArray.from_arrays(offsets, pa.array(weights[used].reshape(-1), pa.float64()))
    table = pa.table({"idx": pa.array(used.astype(np.int32)), "w": lists})
    spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(path)


def score(model: LogisticModel, posts: DataFrame, text: str, id: str, carry: Sequence[str] = ()) -> DataFrame:
    """Each post's ID, carried columns and ``scores``: logits in label order, an empty vector for a blank text."""
    spark, keys, bits = posts.sparkSession, [id, *carry], model.bits
    sent = spark.sparkContext.broadcast(model.dense())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        for batch in batches:
            for first, last, row, idx, n in _hashed(batch.column("_words"), bits):
                row, size = row - first, last - first
                share = n / np.bincount(row, n, size)[row]
                z = _logits(weights, row, idx, share, size) + weights[-1]
                offsets = pa.array((np.arange(size + 1) * weights.shape[1]).astype(np.int32))
                logits = pa.ListArray.from_arrays(offsets, pa.array(z.reshape(-1)))
                columns = [batch.column(c).slice(first, size) for c in [*keys, "_blank"]]
                yield pa.RecordBatch.from_arrays([*columns, logits], [*keys, "_blank", "_z"])

    narrow = posts.select(*keys, is_blank(F.col(text)).alias("_blank"), spaced_words(F.col(text)).alias("_words"))
    schema = T.StructType([narrow.schema[c] for c in [*keys, "_blank"]] + [T.StructField("_z", T.ArrayType(T.DoubleType()))])
    scored = narrow.mapInArrow(run, schema)
    vector = score_vector([str(name) for name in model.labels], [F.col("_z")[i] for i in range(len(model.labels))])
    empty = F.array().cast("array<struct<idx:int,label:string,score:double>>")
    return scored.select(*keys, F.when(F.col("_blank"), empty).otherwise(vector).alias("scores"))


def predict(model: LogisticModel, posts: DataFrame, text: str, id: str, carry: Sequence[str] = ()) -> DataFrame:
    """Scores, probabilities and the best label of each post (null for a blank text)."""
    return score(model, posts, text, id, carry).withColumns({
        "probabilities": softmax(F.col("scores")), "pred": best(F.col("scores"))["label"]
    })
