"""Removing byte strings that occur more than once, through suffix arrays of shards.

A string of ``span`` bytes belongs to the smallest hash among its windows of ``_GRAM``
bytes, its seed. Equal strings have equal seeds, so neighbouring strings of a document
with one seed form a run, and only runs with equal seeds have to be compared:

1. Runs are cut in each text, and seeds that only one run has are dropped.
2. Runs are counted by their content. A run that occurs twice is repeated as a whole.
3. Different runs with equal seeds meet in a shard: their bytes get a suffix array by
   induced sorting and permuted common prefixes, and a string is repeated if it shares
   ``span`` bytes with a neighbour in the array.
4. What is repeated is carried back to all runs, joined into spans and cut out.

A seed with very many different runs would make one large shard. Such runs are cut finer,
by the bytes that all strings of a part have in common, until each part is a single
string and counting alone tells what is repeated.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affectframe.llm.common import join_counted, stored
from affectframe.llm.suffixes import common_prefixes, suffix_array
from affectframe.llm.textstats import body
from affectframe.operators.joins import join_on_key

SPAN = 200

_GRAM = 32
# Bytes that are hashed in one step; a longer text takes several, overlapping by a span.
# A step holds some twenty arrays of eight bytes for each byte.
_BLOCK = 1 << 16
_PLACE_BITS = np.uint64(21)
_PLACES = np.uint64((1 << 21) - 1)
# Strings of one run at most; runs are longer only where a text repeats itself.
_LONGEST = 2048
# Bytes from which a shard takes no further seed. Sorting takes up to 80 times a shard.
_SHARD = 1 << 19
# A seed with more different runs than this is cut finer: into parts of so many strings.
MANY_RUNS = 4_000
_FINER = (32, 4, 1)

RUNS = "key string, start long, n long, seed long, content long, again boolean"


class Hashes:
    """Hashes of windows of a byte array, from sums of powers modulo 2**64."""

    def __init__(self, span: int = SPAN):
        generator = np.random.Generator(np.random.PCG64(20_240_229))
        self.letters = generator.integers(0, 1 << 64, 256, np.uint64)
        factor = int(generator.integers(0, 1 << 62)) * 4 + 3
        inverse = pow(factor, -1, 1 << 64)
        n = 2 * (_BLOCK + span) + _LONGEST + 2
        self.ahead, self.back = np.full(n, factor, np.uint64), np.full(n, inverse, np.uint64)
        for powers in (self.ahead, self.back):
            powers[0] = 1
            np.cumprod(powers, out=powers)

    def sums(self, t: np.ndarray) -> np.ndarray:
        out = np.zeros(len(t) + 1, np.uint64)
        np.cumsum(self.letters[t] * self.ahead[: len(t)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.back[start])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    table = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def seeds_of(t: np.ndarray, hashes: Hashes, sums: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Seed of the string at each place, and where in the array the seed first is in it."""
    places = np.arange(len(t) - gram + 1)
    grams = mixed((sums[gram:] - sums[:-gram]) * hashes.back[: len(places)])
    least = sliding_min((grams & ~_PLACES) | places.astype(np.uint64), span - gram + 1)
    return least >> _PLACE_BITS, (least & _PLACES).astype(np.int64)


def runs_of(texts: list[bytes], hashes: Hashes, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """Runs of several texts of a block at most together: text, start, n, seed, content, again.

    ``again`` tells that the seed changes its place within the run, so that the run may
    repeat itself.
    """
    gram = min(_GRAM, span)
    t = np.frombuffer(b"".join(texts), np.uint8)
    if len(t) < span:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    sizes = np.array([len(x) for x in texts])
    begin = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), sizes)[: len(t) - span + 1]
    sums = hashes.sums(t)
    seed, place = seeds_of(t, hashes, sums, span, gram)
    inside = np.flatnonzero(text == np.repeat(np.arange(len(texts)), sizes)[span - 1 :])
    if not len(inside):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    own_text, own_seed = text[inside], seed[inside]
    first = np.concatenate([[True], (own_text[1:] != own_text[:-1]) | (own_seed[1:] != own_seed[:-1])])
    opens = np.flatnonzero(first)
    n = np.diff(np.append(opens, len(inside)))
    if n.max() > _LONGEST:
        pieces = -(-n // _LONGEST)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        opens = np.repeat(opens, pieces) + nth * _LONGEST
        n = np.diff(np.append(opens, len(inside)))
    start = inside[opens]
    last = start + n - 1
    content = hashes.of(sums, start, last + span)
    again = place[start] != place[last]
    return own_text[opens], start - begin[own_text[opens]], n, seed[start].view(np.int64), content.view(np.int64), again


def blocks(texts: Iterable[bytes], span: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts (number, start of the part, part) in lots of about a block."""
    lot, held = [], 0
    for number, text in enumerate(texts):
        for start in range(0, max(1, len(text) - span + 1), _BLOCK):
            part = text[start : start + _BLOCK + span - 1]
            if held and held + len(part) > _BLOCK + span:
                yield lot
                lot, held = [], 0
            lot.append((number, start, part))
            held += len(part)
    if lot:
        yield lot


def cut_runs(texts: DataFrame, span: int) -> DataFrame:
    """``RUNS`` of all texts (``key, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(span)
        for batch in batches:
            keys, bodies = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())
            for lot in blocks(map(body, bodies), span):
                text, start, n, seed, content, again = runs_of([part for _, _, part in lot], hashes, span)
                offset = np.array([at for _, at, _ in lot])[text] if len(text) else start
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[lot[i][0]] for i in text], pa.string()), pa.array(start + offset, pa.int64()),
                     pa.array(n, pa.int64()), pa.array(seed, pa.int64()), pa.array(content, pa.int64()),
                     pa.array(again.astype(bool))],
                    ["key", "start", "n", "seed", "content", "again"],
                )

    return texts.select("key", "text").mapInArrow(run, RUNS)


def with_bytes(texts: DataFrame, wanted: DataFrame, use, schema: str, span: int) -> DataFrame:
    """Rows that ``use`` makes of wanted runs, given their text.

    The runs are gathered by text, and only texts with such runs are moved. ``use`` gets
    the key, the text and the runs' columns (arrays by name).
    """
    columns = [c for c in wanted.columns if c != "key"]
    gathered = wanted.groupBy("key").agg(F.collect_list(F.struct(*columns)).alias("runs"))
    by_text = stored(gathered.select("key", *[F.col(f"runs.{c}").alias(c) for c in columns]), "wanted")
    # A text may have many copies; one of them is enough.
    held = join_on_key(texts, by_text.select("key"), "key", "left_semi")
    one = held.groupBy("key").agg(F.first("text").alias("text"))
    joined = one.join(by_text, "key").select("key", "text", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Hashes(span)
        for batch in batches:
            keys, bodies = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())
            for i, key in enumerate(keys):
                runs = {c: batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k, c in enumerate(columns, 2)}
                yield use(tools, key, body(bodies[i]), runs)

    return joined.mapInArrow(run, schema)


def finer_runs(texts: DataFrame, wanted: DataFrame, span: int, step: int) -> DataFrame:
    """Runs cut so that a part's strings start within ``step`` places, counted from the seed.

    The new seed is a hash of the bytes that all strings of such a part have in common.
    """
    gram = min(_GRAM, span)

    def use(tools: Hashes, key: str, text: bytes, runs: dict) -> pa.RecordBatch:
        out = []
        for start, n, seed, times in zip(runs["start"], runs["n"], runs["seed"], runs["times"]):
            t = np.frombuffer(text[start : start + n + span - 1], np.uint8)
            sums = tools.sums(t)
            _, place = seeds_of(t, tools, sums, span, gram)
            part = (place - np.arange(n)) // step
            opens = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (place[1:] != place[:-1])]))
            size = np.diff(np.append(opens, n))
            core, part = place[opens] - part[opens] * step, part[opens]
            common = tools.of(sums, core, core - step + 1 + span)
            named = mixed(common ^ mixed(part.astype(np.uint64) + np.uint64(int(seed) & (1 << 64) - 1)))
            content = tools.of(sums, opens, opens + size - 1 + span)
            out.append((start + opens, size, named.view(np.int64), content.view(np.int64), np.full(len(opens), times)))
        columns = [np.concatenate(x) for x in zip(*out)]
        n = len(columns[0])
        return pa.RecordBatch.from_arrays(
            [pa.array([key] * n, pa.string()), *map(pa.array, columns[:4]), pa.array(np.zeros(n, bool)), pa.array(columns[4])],
            ["key", "start", "n", "seed", "content", "again", "times"],
        )

    return with_bytes(texts, wanted, use, RUNS + ", times long", span)


def _bytes_of(span: int):
    def use(tools: Hashes, key: str, text: bytes, runs: dict) -> pa.RecordBatch:
        strings = [text[a : a + n + span - 1] for a, n in zip(runs["start"], runs["n"])]
        return pa.RecordBatch.from_arrays(
            [pa.array(runs["seed"]), pa.array(runs["content"]), pa.array(strings, pa.binary())],
            ["seed", "content", "bytes"],
        )

    return use


def repeated_strings(strings: list[bytes], span: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each string, starts and ends (exclusive) of runs of places whose ``span`` bytes
    also start elsewhere in the list."""
    # 0xFF is in no UTF-8 text.
    t = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)
    order = suffix_array(t)
    former, common = common_prefixes(t, order)
    shared = np.flatnonzero(common >= span)
    marked = np.zeros(len(t), bool)
    marked[shared] = True
    marked[former[shared]] = True
    found, at = [], 0
    for string in strings:
        own = marked[at : at + max(0, len(string) - span + 1)]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
        found.append((edges[::2], edges[1::2]))
        at += len(string) + 1
    return found


def compared(runs: DataFrame, span: int) -> DataFrame:
    """``seed, content, opens, closes``: repeated strings of runs that meet in a shard.

    ``runs`` has ``seed, content, bytes``; a partition holds whole seeds.
    """
    sharded = runs.repartition("seed").sortWithinPartitions("seed", "content")

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_strings([r[2] for r in rows], span)
        kept = [(r[0], r[1], a, b) for r, (a, b) in zip(rows, found) if len(a)]
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64()),
             pa.array([k[2] for k in kept], pa.list_(pa.int64())), pa.array([k[3] for k in kept], pa.list_(pa.int64()))],
            ["seed", "content", "opens", "closes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for seed, content, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held > _SHARD and seed != rows[-1][0]:
                    yield shard(rows)
                    rows, held = [], 0
                rows.append((seed, content, text))
                held += len(text)
        if rows:
            yield shard(rows)

    return sharded.select("seed", "content", "bytes").mapInArrow(
        run, "seed long, content long, opens array<long>, closes array<long>"
    )


def repeated(texts: DataFrame, span: int = SPAN, many_runs: int = MANY_RUNS) -> DataFrame:
    """``key, opens, closes``: byte spans of each text (``key, text``) that are repeated.

    Spans may overlap. ``key`` stands for the text; rows with the same key are copies.
    """
    runs, found = stored(cut_runs(texts, span), "runs").withColumn("times", F.lit(1).cast("bigint")), []
    for step in (*_FINER, None):
        seeds = runs.groupBy("seed").agg(F.sum("times").alias("n_runs"), F.max("again").alias("any_again"))
        seeds = stored(seeds.filter("n_runs > 1 OR any_again").select("seed", "n_runs"), "seeds")
        candidates = join_counted(runs, seeds, "seed", "n_runs", runs.count())
        # Copies of a text bring the same runs; from here on a text is there once.
        candidates = candidates.groupBy("key", "start", "n", "seed", "content", "again").agg(F.sum("times").alias("times"))
        candidates = stored(candidates, "candidates")
        n_candidates = candidates.count()
        contents = candidates.groupBy("seed", "content").agg(
            F.sum("times").alias("copies"), F.count("*").alias("n_texts"), F.max("again").alias("again"),
            F.min(F.struct("key", "start", "n")).alias("place"),
        )
        contents = stored(contents, "contents")
        different = contents.groupBy("seed").agg(F.count("*").alias("different"), F.sum("n_texts").alias("n_runs"))
        different = stored(different, "different")
        too_many = (F.col("different") > many_runs) if step else F.lit(False)
        many, few = (different.filter(x).select("seed", "different", "n_runs") for x in (too_many, ~too_many))
        finer = None
        if step and not many.isEmpty():
            wanted = join_counted(candidates, many, "seed", "n_runs", n_candidates)
            finer = stored(finer_runs(texts, wanted.select("key", "start", "n", "seed", "times"), span, step), "finer")
        # Alone with its seed, a run has nothing to meet but itself.
        own = stored(join_counted(contents, few, "seed", "n_runs", n_candidates), "own")
        meeting = own.filter("different > 1 OR (copies = 1 AND again)")
        wanted = meeting.select("place.key", "place.start", "place.n", "seed", "content")
        strings = with_bytes(texts, wanted, _bytes_of(span), "seed long, content long, bytes binary", span)
        matched = stored(compared(strings, span), "matched")
        whole = F.col("copies") > 1
        settled = own.join(matched, ["seed", "content"], "left").select(
            "seed", "content", "n_texts",
            F.when(whole, F.array(F.lit(0).cast("bigint"))).otherwise(F.col("opens")).alias("opens"),
            F.when(whole, F.array(F.col("place.n"))).otherwise(F.col("closes")).alias("closes"),
        )
        settled = stored(settled.filter("opens IS NOT NULL"), "settled")
        placed = join_counted(candidates, settled, ["seed", "content"], "n_texts", n_candidates)
        found.append(placed.select(
            "key",
            F.transform("opens", lambda x: x + F.col("start")).alias("opens"),
            F.transform("closes", lambda x: x + F.col("start") + (span - 1)).alias("closes"),
        ))
        if finer is None:
            break
        runs = finer
    spans = reduce(DataFrame.unionByName, found).groupBy("key").agg(
        F.flatten(F.collect_list("opens")).alias("opens"), F.flatten(F.collect_list("closes")).alias("closes")
    )
    return stored(spans, "spans")


def cut_out(text: bytes, opens, closes) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the maximal spans that go."""
    if not len(opens):
        return text, []
    change = np.zeros(len(text) + 2, np.int64)
    np.add.at(change, np.asarray(opens) + 1, 1)
    np.add.at(change, np.asarray(closes) + 1, -1)
    edges = np.flatnonzero(np.diff((np.cumsum(change) > 0).astype(np.int8)))
    spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]]), spans


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, span: int = SPAN, many_runs: int = MANY_RUNS
) -> DataFrame:
    """``id, n_bytes, spans, kept`` of each document.

    ``spans`` are the maximal byte runs covered by a string of ``span`` bytes that also
    starts anywhere else, in the same or another document; ``kept`` are the other bytes.
    All places of a string go, the first one too. Defined cases: a null text is empty;
    equal rows are copies of each other; texts shorter than ``span`` stay whole; an empty
    table gives an empty one. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.md5("text"))
    spans = repeated(rows.select("key", "text"), span, many_runs)
    joined = join_on_key(rows, spans, "key", "left").select("id", "text", "opens", "closes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, kept = [], [], []
            for i, text in enumerate(batch.column(1).cast(pa.large_binary())):
                text = body(text)
                opens, closes = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                rest, cut = cut_out(text, opens or [], closes or [])
                sizes.append(len(text))
                gone.append([{"start": a, "end": b} for a, b in cut])
                kept.append(rest)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, kind), pa.array(kept, pa.binary())],
                ["id", "n_bytes", "spans", "kept"],
            )

    kinds = T.StructType.fromDDL("n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    return joined.mapInArrow(run, T.StructType([joined.schema["id"], *kinds.fields]))
