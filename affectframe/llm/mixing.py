"""Mixing sources to target weights by repeating documents.

The words of each source are added up, each source gets a target, and its rate is target
over size. A document is emitted floor(rate) times, plus once more with a probability
equal to the rest of the rate; the draw is a hash of the seed, the id and the size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affectframe.functions.once import with_column_once
from affectframe.llm.common import WORD, join_counted, stored

WEIGHTS = (1, 2, 3)
MOST = 3  # a source's target is at most so many times its size
SEED = "mix"


def word_count(text: Column) -> Column:
    """Words of a whole text; a null has none. Counted in place, so that no text leaves the row it is in."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def document_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``id, source, size``: words of each whole text."""
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")
    )


def source_key(source: Column) -> Column:
    """A key that is never null and sorts a missing source last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def numbered(table: DataFrame, key: str) -> DataFrame:
    """A stored table with the place of each row (from 0) in the order of a unique key.

    Ranges of keys are sorted side by side; only the ranges' row counts are added up.
    """
    ranged = stored(
        table.repartitionByRange(key).withColumn("part", F.spark_partition_id()), "ranged"
    )
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.withColumn(
        "before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    place = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    return ranged.withColumn("place", place).join(before.drop("n"), "part").withColumn(
        "place", F.col("place") + F.col("before")
    ).drop("part", "before")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST
) -> DataFrame:
    """``key, n_docs, source_size, weight, target`` of each source, from ``key, size``.

    Sources in the order of code points, a missing one last, weigh as listed, over and
    over. All sources together keep the words they have. A target above ``most`` times
    its source's size is cut there and the excess shared by weight among the others,
    until none is above. A source without words has the target 0.
    """
    sources = sizes.groupBy("key").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    listed = F.array(*[F.lit(int(w)) for w in weights]).cast("array<bigint>")
    sources = stored(
        numbered(sources, "key").withColumn("weight", F.get(listed, (F.col("place") % len(weights)).cast("int"))),
        "sources",
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    share = None  # words for each unit of weight
    while True:
        # Shares only grow from round to round, so a source that was cut stays cut.
        full = F.lit(False) if share is None else F.lit(share) * F.col("weight") > F.col("source_size") * most
        fixed, open_weight, n_full = sources.agg(
            F.sum(F.when(full, F.col("source_size") * most).otherwise(0)),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))),
            F.sum(full.cast("int")),
        ).first()
        new = (total - fixed) / open_weight if open_weight else float("inf")
        if share is not None and (n_full == before or not open_weight):
            break
        share, before = new, n_full
    cut = F.least(F.lit(float(share)) * F.col("weight"), (F.col("source_size") * most).cast("double"))
    return stored(sources.select("key", "n_docs", "source_size", "weight", cut.alias("target")), "targets")


def draw(doc_id: Column, size: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed, the id and the size only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), size.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def copies(size: Column, source_size: Column, target: Column, uniform: Column) -> Column:
    """How often a document is emitted."""
    rate = target / source_size
    times = F.floor(rate) + (uniform < rate - F.floor(rate)).cast("bigint")
    return F.when(source_size > 0, times).otherwise(0).cast("bigint")


def _planned(docs, id_col, text_col, source_col, weights, most, seed) -> DataFrame:
    sizes = stored(document_sizes(docs, id_col, text_col, source_col), "sizes")
    keyed = sizes.select("id", source_key(F.col("source")).alias("key"), "size")
    targets = source_targets(keyed.select("key", "size"), weights, most)
    total = keyed.count()
    rows = join_counted(keyed, targets, "key", "n_docs", total)
    times = copies(F.col("size"), F.col("source_size"), F.col("target"), draw(F.col("id"), F.col("size"), seed))
    return rows.select("id", "key", "size", "source_size", "target", times.alias("times"))


def mixed_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    *, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED,
) -> DataFrame:
    """``id, size, source_size, target, taken`` of each document; see :func:`mix`."""
    rows = _planned(docs, id_col, text_col, source_col, weights, most, seed)
    return rows.select("id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    *, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED,
) -> DataFrame:
    """The documents, each as often as the mix takes it, with all their columns.

    Defined cases: a null text has the size 0; a null source is a source of its own,
    after all others; rows alike in id and size share their draw, so a rerun over other
    partitions agrees; a source without words is left out; an empty table stays empty.
    Other columns are carried in one struct, so their names cannot clash.
    """
    sizes = stored(document_sizes(docs, id_col, text_col, source_col), "sizes")
    targets = source_targets(sizes.select(source_key(F.col("source")).alias("key"), "size"), weights, most)
    total = sizes.count()
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_col).alias("id"), source_key(F.col(source_col).cast("string")).alias("key"),
        word_count(F.col(text_col)).alias("size"),
    )
    rows = join_counted(packed, targets, "key", "n_docs", total)
    times = copies(F.col("size"), F.col("source_size"), F.col("target"), draw(F.col("id"), F.col("size"), seed))
    emitted = with_column_once(rows, "times", times).filter("times > 0")
    return emitted.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))).select("row.*")


def oracle(weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED) -> str:
    """DuckDB SQL for :func:`mixed_words` over ``documents``, with the ids as ``doc_id``.

    The sources that are cut are found by sorting: those whose limit is reached at the
    smallest share come first.
    """
    weight = reduce(lambda rest, w: f"CASE WHEN place % {len(weights)} = {w[0]} THEN {w[1]} ELSE {rest} END", enumerate(weights), "0")
    return rf"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), sources AS (
  SELECT key, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY key) - 1 AS place
  FROM sized GROUP BY key
), weighed AS (SELECT *, ({weight})::BIGINT AS weight FROM sources
), ranked AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
         coalesce(sum(source_size * {most}) OVER w, 0) AS fixed, coalesce(sum(weight) OVER w, 0) AS gone
  FROM weighed
  WINDOW w AS (ORDER BY source_size::DOUBLE / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), shares AS (
  SELECT *, (total - fixed)::BIGINT::DOUBLE / (all_weight - gone)::BIGINT::DOUBLE AS share FROM ranked
), chosen AS (
  -- the fewest cuts with which the next source is not above its limit
  SELECT min_by(share, gone) AS share FROM shares WHERE share * weight <= source_size * {most}
), targets AS (
  SELECT key, source_size, least(coalesce(share, 0) * weight, (source_size * {most})::DOUBLE) AS target
  FROM weighed, chosen
), drawn AS (
  SELECT *, target / source_size AS rate,
         ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || size::VARCHAR), 1, 13))::BIGINT
           / {float(1 << 52)!r}::DOUBLE AS uniform
  FROM sized JOIN targets USING (key)
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size > 0
            THEN size * (floor(rate) + (uniform < rate - floor(rate))::BIGINT)::BIGINT ELSE 0 END AS taken
FROM drawn
"""
