"""Vectors of whole numbers in shards, each with a search tree, asked by a stated set of rows.

A shard holds rows that lie near each other, some millions of numbers at most, and is one
row of a stored table: its vectors, ids, labels and tree as arrays. Which rows share a shard
is only a matter of speed: cells around a bounded sample of rows order them, and ranges of
that order are the shards, so a cell with very many rows is spread over several.

A request is a row that asks, with one or more windows of scores (inner products). It is
answered in waves: in its own shard, in a few shards near the window, and in all others. The
score of the k-th row found so far is shared before each: a wave goes, in blocks of
requests, only to shards whose ball can hold scores of the window from that score on, and
finds only rows that reach it. Requests are compared with rows of the same length only.

Defined cases (for the operators built on this): rows with a null vector, or a null or
non-finite component, take no part, nor do vectors whose squares add up to 2^55 or more,
whose scores would not fit a long. Rows with the same id are different rows, each asked and
found by itself; a row without an id can be found (last among ties) but does not ask. An
empty vector has the score 0. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affectframe.llm.common import stored
from affectframe.operators.ranking import top_n_per_group
from affectframe.tables import is_bounded

# Numbers in a shard (its rows times their length), requests in a block, rows that cells form around.
SHARD_VALUES, BLOCK, CELLS = 1 << 22, 256, 256
# Fewer shards than tasks are made where they would get fewer rows: the first wave needs some to find k.
LEAST_ROWS = 512
# Shards that a request asks in the second wave.
NEAR = 8
# The balls of shards are sent to the tasks that deal requests out if they take so many bytes at most.
BALL_BYTES = 64 << 20
MAX_SQUARES = float(1 << 55)
LOWEST, HIGHEST = -(1 << 60), 1 << 60

ANY, SAME, OTHER = 0, 1, -1  # label of the rows sought, as against that of the request


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(body: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(body)) as found:
        return {name: found[name] for name in found.files}


def narrow(m: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest type that holds them."""
    most = int(np.abs(m).max()) if m.size else 0
    return m.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def prepare(shard: dict[str, np.ndarray]) -> None:
    shard["squares"] = (shard["v"].astype(np.float64) ** 2).sum(1)
    shard["doubles"] = shard["v"].astype(np.float64)


def products(block: dict[str, np.ndarray], asking: np.ndarray, shard: dict[str, np.ndarray], start: int, end: int) -> np.ndarray:
    """Exact inner products of some requests with a run of the shard's rows.

    No sum of products exceeds the product of two rows' lengths; below 2^52 doubles are exact.
    """
    if block["squares"].max() * shard["squares"].max() < 2.0**104:
        return (block["doubles"][asking] @ shard["doubles"][start:end].T).astype(np.int64)
    return block["v"][asking].astype(np.int64) @ shard["v"][start:end].astype(np.int64).T


def whole_numbers(df: DataFrame, id_col: str, vec_col: str, scale: int, asks: Column, label: Column | None = None) -> DataFrame:
    """``row, id, label, asks, v``: rows that take part, with ``floor(scale * component)`` as ``v``."""
    vec = F.col(vec_col)
    whole = F.transform(vec, lambda x: F.floor(x.cast("double") * scale))
    usable = vec.isNotNull() & F.forall(
        vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    squares = F.aggregate(vec, F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * scale).cast("double"), 2))
    kept = df.filter(F.coalesce(usable, F.lit(False))).filter(squares < MAX_SQUARES)
    if label is not None:
        kept = kept.filter(label.isNotNull())
    return kept.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"),
        (F.lit(0) if label is None else label).cast("bigint").alias("label"),
        F.coalesce(asks & F.col(id_col).isNotNull(), F.lit(False)).alias("asks"), whole.cast("array<bigint>").alias("v"),
    )


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column by their length: places in the column, and a matrix."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, flat[starts[at, None] + np.arange(size)].reshape(len(at), size)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.fill_null(pa.scalar(0).cast(column.type)).to_numpy(zero_copy_only=False)


def _cells(pivots: dict[int, np.ndarray]):
    """The nearest pivot of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.full(batch.num_rows, -1, np.int32)
            size = np.zeros(batch.num_rows, np.int32)
            for at, m in _matrices(batch.column("v")):
                size[at] = m.shape[1]
                if m.shape[1] in pivots:
                    p = pivots[m.shape[1]].astype(np.float64)
                    cell[at] = np.argmin((p * p).sum(1) - 2 * (m.astype(np.float64) @ p.T), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(cell)], [*batch.schema.names, "dim", "cell"])

    return run


def _build(grow: Callable[[np.ndarray], tuple[np.ndarray, dict[str, np.ndarray]]], shard_values: int):
    def shard(parts: list[dict[str, np.ndarray]], number: int) -> list:
        whole = {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}
        v = whole["v"]
        order, tree = grow(v)
        arrays = {name: a[order] for name, a in whole.items()} | tree
        centre = v.mean(axis=0)
        radius = float(np.sqrt(((v - centre) ** 2).sum(1).max()))
        arrays["v"] = narrow(arrays["v"])
        return [number, v.shape[1], len(v), packed(arrays), centre.tolist(), radius]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        waiting: dict[int, list] = {}
        for batch in batches:
            columns = {name: _numbers(batch.column(name)) for name in ("row", "id", "label", "asks")}
            columns["no_id"] = np.asarray(batch.column("id").is_null())
            for at, m in _matrices(batch.column("v")):
                own = waiting.setdefault(m.shape[1], [])
                own.append({name: a[at] for name, a in columns.items()} | {"v": m})
                if sum(p["v"].size + len(p["v"]) for p in own) >= shard_values:
                    yield pa.RecordBatch.from_pylist([dict(zip(SHARD.names, shard(own, number), strict=True))], _arrow(SHARD))
                    number += 1
                    del waiting[m.shape[1]]
        for own in waiting.values():
            yield pa.RecordBatch.from_pylist([dict(zip(SHARD.names, shard(own, number), strict=True))], _arrow(SHARD))
            number += 1

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_LONG, _INT, _BODY = T.LongType(), T.IntegerType(), T.BinaryType()
SHARD = _schema(shard=_LONG, dim=_INT, n=_LONG, body=_BODY, centre=T.ArrayType(T.DoubleType()), radius=T.DoubleType())
REQUEST = _schema(q=_LONG, own=_LONG, id=_LONG, label=_LONG, v=T.ArrayType(_LONG))
DEALT = _schema(shard=_LONG, part=_INT, body=_BODY)
HIT = _schema(q=_LONG, w=_INT, score=_LONG, id=_LONG, row=_LONG)


def sharded(rows: DataFrame, grow, *, shard_values: int = SHARD_VALUES, cells: int = CELLS) -> DataFrame:
    """Store the rows in shards with the trees that ``grow(vectors)`` makes (an order of the rows, and arrays)."""
    spark = rows.sparkSession
    values, n = rows.agg(F.sum(F.size("v") + 1), F.count("*")).first()
    by_hash = rows.select("v", F.xxhash64("id", "v").alias("h")).orderBy("h").limit(cells).select("v")
    pivots: dict[int, list] = {}
    for (v,) in by_hash.collect():
        pivots.setdefault(len(v), []).append(v)
    pivots = {size: np.array(vs, np.int64).reshape(len(vs), size) for size, vs in pivots.items()}
    schema = T.StructType([*rows.schema.fields, T.StructField("dim", T.IntegerType()), T.StructField("cell", T.IntegerType())])
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // LEAST_ROWS)
    parts = max(tasks, -(-(values or 0) // shard_values), 1)
    placed = rows.mapInArrow(_cells(pivots), schema).repartitionByRange(parts, "dim", "cell", F.xxhash64("row"))
    return stored(placed.mapInArrow(_build(grow, shard_values), SHARD), "shards")


def _asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, body in zip(batch.column("shard").to_pylist(), batch.column("body"), strict=True):
            found = unpacked(body.as_py())
            asks = found["asks"].astype(bool)
            v = found["v"][asks].astype(np.int64)
            offsets = np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]
            yield pa.RecordBatch.from_arrays([
                pa.array(found["row"][asks]), pa.array(np.full(len(v), number, np.int64)), pa.array(found["id"][asks]),
                pa.array(found["label"][asks]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.reshape(-1))),
            ], REQUEST.names)


def requests(shards: DataFrame) -> DataFrame:
    """The rows that ask, with their shard."""
    return stored(shards.select("shard", "body").mapInArrow(_asking, REQUEST), "requests")


@dataclass(frozen=True)
class Balls:
    """The shards' balls, for vectors of each length."""

    by_dim: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # shard numbers, centres, radii

    @staticmethod
    def of(shards: DataFrame) -> Balls:
        found: dict[int, list] = {}
        for r in shards.select("shard", "dim", "centre", "radius").collect():
            found.setdefault(r.dim, []).append(r)
        return Balls({
            dim: (np.array([r.shard for r in rs]), np.array([r.centre for r in rs]).reshape(len(rs), dim), np.array([r.radius for r in rs]))
            for dim, rs in found.items()
        })


def _blocks(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
    """The requests of a batch as arrays, by length and in blocks."""
    windows = {name: batch.column(name) for name in ("lo", "hi")}
    for at, v in _matrices(batch.column("v")):
        for start in range(0, len(at), BLOCK):
            own = at[start:start + BLOCK]
            block = {name: _numbers(batch.column(name))[own] for name in ("q", "own", "label")}
            block["v"] = narrow(v[start:start + BLOCK])
            for name, column in windows.items():
                width = len(column.flatten()) // max(batch.num_rows, 1)
                block[name] = column.flatten().to_numpy().reshape(batch.num_rows, width)[own]
            yield block


def _dealt(block: dict[str, np.ndarray], chosen: np.ndarray, shard: int) -> dict:
    return {"shard": shard, "part": 1, "body": packed({name: a[chosen] for name, a in block.items()})}


def _to_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in _blocks(batch):
            out = [_dealt(block, block["own"] == shard, int(shard)) for shard in np.unique(block["own"])]
            yield pa.RecordBatch.from_pylist(out, _arrow(DEALT))


def _to_others(balls: Balls, near: bool):
    """To the shards besides the own one: those near the upper end of a window, or all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch):
                numbers, centres, radii = balls.by_dim[block["v"].shape[1]]
                v = block["v"].astype(np.float64)
                lengths = np.sqrt((v * v).sum(1))
                middle, spread = v @ centres.T, np.outer(lengths, radii)
                spread += 1e-9 * np.outer(lengths, np.sqrt((centres * centres).sum(1)) + radii) + 1e-6
                # Some window of the request meets the scores that the ball can hold.
                within, distance = np.zeros(middle.shape, bool), np.full(middle.shape, np.inf)
                top = (middle + spread).max(axis=1, keepdims=True)
                for w in range(block["lo"].shape[1]):
                    lo, hi = block["lo"][:, w, None], block["hi"][:, w, None]
                    within |= (lo <= hi) & (middle + spread >= lo) & (middle - spread <= hi)
                    distance = np.minimum(distance, np.abs(middle - np.minimum(hi, top)))
                foreign = numbers[None, :] != block["own"][:, None]
                distance[~foreign] = np.inf
                # The same shards in either wave: neither centres nor upper ends change in between.
                nearest = np.argsort(distance, axis=1, kind="stable")[:, :NEAR]
                is_near = np.zeros(middle.shape, bool)
                np.put_along_axis(is_near, nearest, True, axis=1)
                within &= foreign & (is_near if near else ~is_near)
                for s in np.flatnonzero(within.any(axis=0)):
                    yield pa.RecordBatch.from_pylist([_dealt(block, within[:, s], int(numbers[s]))], _arrow(DEALT))

    return run


def _to_any(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in _blocks(batch):
            whole = packed(block)
            yield pa.RecordBatch.from_arrays([pa.array([block["v"].shape[1]], pa.int32()), pa.array([whole], pa.binary())], ["dim", "body"])


def _dealt_to_any(asked: DataFrame, shards: DataFrame) -> DataFrame:
    """Blocks of requests with every shard, where the balls do not fit a task.

    They are dealt in slices of the shards' numbers, so that no task deals to all of them.
    A shard's root drops what it excludes.
    """
    slices = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = asked.mapInArrow(_to_any, "dim int, body binary")
    blocks = blocks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    numbers = shards.select("shard", "dim", F.pmod(F.xxhash64("shard"), F.lit(slices)).cast("int").alias("slice"))
    return blocks.join(numbers, ["dim", "slice"]).select("shard", F.lit(2).alias("part"), "body")


class Best:
    """The k best rows of each slot (request and window) so far, and the score that a further one must reach."""

    def __init__(self, shard: dict[str, np.ndarray], block: dict[str, np.ndarray], k: int, label: int):
        self.shard, self.block, self.k, self.label = shard, block, k, label
        self.lo, self.hi = block["lo"].reshape(-1).copy(), block["hi"].reshape(-1)
        self.width = block["lo"].shape[1]
        self.kept = tuple(np.zeros(0, np.int64) for _ in range(3))  # slot, score, place in the shard
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.n_waiting = 0

    def offer(self, slots: np.ndarray, scores: np.ndarray, start: int) -> None:
        """``scores[i, j]`` is that of slot i and the shard's row ``start + j``."""
        asked, end = slots // self.width, start + scores.shape[1]
        good = (scores >= self.lo[slots, None]) & (scores <= self.hi[slots, None])
        good &= self.shard["row"][None, start:end] != self.block["q"][asked, None]
        if self.label != ANY:
            same = self.shard["label"][None, start:end] == self.block["label"][asked, None]
            good &= same if self.label == SAME else ~same
        i, j = np.nonzero(good)
        if len(i):
            self.waiting.append((slots[i], scores[i, j], start + j))
            self.n_waiting += len(i)
            if self.n_waiting > 4 * len(self.lo) * self.k:
                self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        slot, score, at = (np.concatenate(x) for x in zip(self.kept, *self.waiting, strict=True))
        self.waiting, self.n_waiting = [], 0
        s = self.shard
        order = np.lexsort((s["row"][at], s["id"][at], s["no_id"][at], -score, slot))
        slot, score, at = slot[order], score[order], at[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        self.kept = slot[place < self.k], score[place < self.k], at[place < self.k]
        last = place == self.k - 1
        self.lo[slot[last]] = np.maximum(self.lo[slot[last]], score[last])

    def hits(self) -> list[pa.Array]:
        self.settle()
        slot, score, at = self.kept
        ids = pa.array(self.shard["id"][at], mask=self.shard["no_id"][at].astype(bool))
        q, w = self.block["q"][slot // self.width], (slot % self.width).astype(np.int32)
        return [pa.array(q), pa.array(w), pa.array(score), ids, pa.array(self.shard["row"][at])]


Search = Callable[[dict, dict, "Best"], None]


def _search(search: Search, k: int, label: int):
    """A partition's shards one after the other, each before the blocks that ask it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = {}, None
        for batch in batches:
            for s, part, body in zip(*(batch.column(i) for i in range(3)), strict=True):
                arrays = unpacked(body.as_py())
                prepare(arrays)
                if part.as_py() == 0:
                    shard, number = arrays, s.as_py()
                    continue
                if s.as_py() != number:
                    raise ValueError("a block of requests came without its shard")
                if part.as_py() == 2:  # dealt without a look at the shard: its own requests have asked it
                    arrays["lo"][arrays["own"] == number] = HIGHEST + 1
                best = Best(shard, arrays, k, label)
                search(shard, arrays, best)
                found = best.hits()
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays(found, HIT.names)

    return run


def _wave(dealt: DataFrame, shards: DataFrame, search: Search, k: int, label: int) -> DataFrame:
    spark: SparkSession = shards.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = shards.select("shard", F.lit(0).alias("part"), "body")
    together = whole.unionByName(dealt).repartition(parts, "shard").sortWithinPartitions("shard", "part")
    return together.mapInArrow(_search(search, k, label), HIT)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each request and window, with their rank.

    A request amid many alike rows has k hits in each of very many shards, so the limit is
    taken in slices of its hits first.
    """
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    return top_n_per_group(hits, ["q", "w"], order, k, spread="row")


def answered(asked: DataFrame, shards: DataFrame, search: Search, k: int, label: int = ANY) -> DataFrame:
    """``q, w, rank, id, row, score``: the k best rows of each window of each request.

    ``asked`` has the columns of :data:`REQUEST` and ``lo, hi``, as many numbers in each
    row: scores from ``lo[w]`` to ``hi[w]`` are sought, none where ``lo[w]`` is greater.
    """
    waves = [lambda rows: rows.mapInArrow(_to_own, DEALT)]
    if is_bounded(shards.select("shard", "dim", "centre", "radius"), BALL_BYTES):
        balls = Balls.of(shards)
        waves += [lambda rows, near=near: rows.mapInArrow(_to_others(balls, near), DEALT) for near in (True, False)]
    else:
        waves += [lambda rows: _dealt_to_any(rows, shards)]
    found, rows = None, asked
    for number, dealt in enumerate(waves):
        if number:
            rows = stored(_raised(rows, found, k), "requests")
        hits = _wave(dealt(rows), shards, search, k, label)
        hits = hits if found is None else found.drop("rank").unionByName(hits)
        found = stored(ranked(hits, k), "hits")
    return found


def _raised(asked: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The requests with the score of the k-th row found so far as the lower end of its window."""
    reached = found.filter(F.col("rank") == k).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
    raised = F.transform("lo", lambda lo, w: F.greatest(lo, F.coalesce(F.try_element_at("kth", w), F.lit(LOWEST))))
    return asked.join(reached, "q", "left").withColumn("lo", raised).drop("kth")
