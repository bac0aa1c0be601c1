"""Near-duplicates by SimHash fingerprints and deletion-variant signatures.

A fingerprint of 64 bits is cut into distance // 2 + 1 segments, fewer than the usual
distance + 1. If two fingerprints differ in at most ``distance`` bits, some segment of
theirs differs in at most one. So each segment is indexed once as it is, and once for each
of its bits with that bit deleted; fingerprints that share such a key are compared. A
bucket of a deletion variant compares only those with the bit set to those without.

Texts do not move: only different fingerprints are indexed, and of each bucket only as
many links go on as its members need to stay connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affectframe.llm.common import stored
from affectframe.llm.components import components
from affectframe.llm.textstats import body
from affectframe.operators.joins import join_on_key

SHINGLE = 3
DISTANCE = 2
SEED = 42

# Shingles whose bits are added up in one step; a long text takes several.
_STEP = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles, repeats included; 0 if it has no word."""
    import xxhash

    words = text.lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for at in range(0, n, _STEP):
        part = words[at : at + _STEP + shingle - 1]
        m = min(_STEP, n - at)
        codes = np.fromiter(
            (hashed(b" ".join(part[i : i + shingle]), SEED) for i in range(m)), np.uint64, m
        )
        bits = np.unpackbits(codes.astype(">u8").view(np.uint8).reshape(m, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    # The first column is the highest bit.
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """``id, fp`` of each document; the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            codes = _signed([fingerprint(body(t), shingle) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes)], ["id", "fp"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, T.StructType([narrow.schema["id"], T.StructField("fp", T.LongType())]))


def segments(distance: int) -> list[tuple[int, int]]:
    """First bit and width of each segment."""
    n = distance // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(fps: DataFrame, distance: int) -> DataFrame:
    """``slot, value, fp``: the keys of each fingerprint.

    ``slot`` tells the segment and the deleted bit (-1 for none).
    """
    keys = []
    for a, width in segments(distance):
        mask = (1 << width) - 1
        part = F.shiftrightunsigned("fp", a) if a else F.col("fp")
        part = part.bitwiseAND(F.lit(mask if width < 64 else -1).cast("bigint"))
        keys.append(F.struct(F.lit(a * 100 - 1).alias("slot"), part.alias("value")))
        for bit in range(width if distance else 0):
            hole = F.lit(_as_long(~(1 << bit))).cast("bigint")
            keys.append(F.struct(F.lit(a * 100 + bit).alias("slot"), part.bitwiseAND(hole).alias("value")))
    exploded = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    return exploded.select("key.slot", "key.value", "fp")


def _as_long(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def bucket_links(fps: np.ndarray, slot: int, distance: int) -> list[tuple[int, int]]:
    """Links that keep connected what one bucket connects: at most one for each member.

    Each member is compared with all others across the deleted bit (or with all that
    follow if no bit is deleted); a link is listed only if it joins two groups.
    """
    if slot % 100 == 99:
        side = None
        first = np.arange(len(fps) - 1)
    else:
        side = (fps >> np.uint64(slot // 100 + slot % 100)) & np.uint64(1)
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    group = np.arange(len(fps))
    links = []
    for i in first:
        others = np.arange(i + 1, len(fps)) if side is None else second
        near = others[np.bitwise_count(fps[others] ^ fps[i]) <= distance]
        near = near[group[near] != group[i]]
        for g, j in zip(*np.unique(group[near], return_index=True)):
            links.append((int(i), int(near[j])))
            group[group == g] = group[i]
    return links


def bucket_edges(keyed: DataFrame, distance: int) -> DataFrame:
    """``u, v``: links between different fingerprints, from rows sorted by bucket.

    A partition holds whole buckets, sorted; a bucket's fingerprints are different, so it
    is as large as a segment's value has fingerprints and no larger for copies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if rest is not None:
                columns = [np.concatenate(pair) for pair in zip(rest, columns)]
            yield from linked(*columns, final=False)
            last = (columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1])
            start = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            rest = [c[start:] for c in columns]
        if rest is not None:
            yield from linked(*rest, final=True)

    def linked(slot, value, fp, final):
        change = np.flatnonzero((slot[1:] != slot[:-1]) | (value[1:] != value[:-1])) + 1
        starts = np.concatenate([[0], change])
        ends = np.concatenate([change, [len(slot)]])
        if not final:  # the last bucket may go on in the next batch
            starts, ends = starts[:-1], ends[:-1]
        several = ends - starts > 1
        u, v = [], []
        for a, b in zip(starts[several], ends[several]):
            members = fp[a:b].view(np.uint64)
            for i, j in bucket_links(members, int(slot[a]), distance):
                u.append(members[i])
                v.append(members[j])
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(_signed(u)), pa.array(_signed(v))], ["u", "v"])

    return keyed.mapInArrow(run, "u long, v long")


def classified(
    docs: DataFrame, id_col: str, text_col: str, *, shingle: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """``id, fp, root, component_id``, stored; ``root`` is a fingerprint that stands for the component."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    groups = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "groups")
    # A bucket's rows meet in one task, sorted; links need few numbers each.
    keyed = variants(groups.select("fp"), distance).repartition("slot", "value").sortWithinPartitions("slot", "value")
    found = components(bucket_edges(keyed, distance))
    rooted = groups.join(found, groups.fp == found.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = stored(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = join_on_key(rooted.select("fp", "root"), smallest, "root", "inner")
    return stored(join_on_key(rows, stored(classes, "classes"), "fp", "inner"), "classified")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id, fp, component_id`` of each document.

    Documents whose fingerprints differ in at most ``distance`` bits are linked;
    ``component_id`` is the smallest id that links lead to. Defined cases: a null or empty
    text has the fingerprint 0 and is linked like any other; rows that share an id keep
    their own fingerprints; null ids are passed over when the smallest is sought, and a
    component of null ids only has none; an empty table gives an empty one. Options:
    ``shingle`` (words) and ``distance`` (bits).
    """
    return classified(docs, id_col, text_col, **options).select("id", "fp", "component_id")


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """The documents without their near-duplicates, with all their columns.

    Of each component the row with the smallest id stays. Defined cases: a null id is
    larger than any other; of rows with the same id the one with the smallest fingerprint
    stays, and one of those that are alike in both.
    """
    rows = classified(docs, id_col, text_col, shingle=shingle, distance=distance)
    order = F.struct(F.col("id").isNull().alias("missing"), "id", "fp")
    heads = stored(rows.groupBy("root").agg(F.min(order).alias("head")).select("head.id", "head.fp"), "heads")
    at_heads = join_on_key(rows, heads.select("id").distinct(), "id", "left_semi", null_keys_match=True)
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_col).alias("id"), F.col(text_col).alias("text"),
    )
    if at_heads.count() == heads.count():  # an id leads to one row only, which is the usual case
        kept = join_on_key(packed, heads.select("id"), "id", "left_semi", null_keys_match=True)
        return kept.select("row.*")
    # Ids are shared or missing: the fingerprint is needed to tell rows apart.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            codes = _signed([fingerprint(body(t), shingle) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes)], ["row", "id", "fp"])

    schema = T.StructType([*packed.schema.fields[:2], T.StructField("fp", T.LongType())])
    marked = packed.mapInArrow(run, schema).alias("d")
    heads = heads.alias("h")
    same = F.expr("d.id <=> h.id AND d.fp = h.fp")
    return marked.join(heads, same, "left_semi").dropDuplicates(["id", "fp"]).select("row.*")
