"""Joins against dimensions, and membership tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affectframe.constants import BROADCAST_BYTES, HOT_PARTS, SALTS
from affectframe.session import new_dir
from affectframe.tables import is_bounded


def hot_keys(df: DataFrame, key: str, hot_parts: int = HOT_PARTS) -> DataFrame:
    """Keys with at least 1/``hot_parts`` of all rows, in ``_hot``; so at most that many.

    They are counted once and stored: whoever joins with them reads a few rows.
    """
    counts = df.groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_rows"))
    rows = counts.agg(F.sum("_rows").alias("rows")).scalar()
    path = new_dir(df.sparkSession, "hot-keys")
    hot = counts.filter(F.col("_rows") * hot_parts >= rows).select("_hot")
    hot.write.parquet(path)
    return df.sparkSession.read.schema(hot.schema).parquet(path)


def split_hot(df: DataFrame, key: str, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a hot key, and the others. Neither part is moved."""
    is_hot = df[key].eqNullSafe(hot["_hot"])
    return (
        df.join(F.broadcast(hot), is_hot, "left_semi"),
        df.join(F.broadcast(hot), is_hot, "left_anti"),
    )


def join_on_key(
    facts: DataFrame,
    other: DataFrame,
    key: str,
    how: str,
    *,
    null_keys_match: bool = False,
    max_bytes: int = BROADCAST_BYTES,
    hot_parts: int = HOT_PARTS,
) -> DataFrame:
    """Inner, left, left semi or left anti join of facts with another table on one key.

    The other table is measured first. Up to ``max_bytes`` it is broadcast, and the
    facts stay where they are, however skewed their key.

    Beyond that, keys with at least 1/``hot_parts`` of all facts are treated apart; there
    are at most ``hot_parts`` of them by that definition. Their partners are measured in
    turn: if they can be broadcast, facts with such keys stay where they are; otherwise
    these facts are dealt over slices of their key, each of which gets all the key's
    partners. The other facts are joined by a shuffle in which no key is large.
    """
    right = other.withColumnRenamed(key, "_key")

    def joined(left: DataFrame, partners: DataFrame, kind: str) -> DataFrame:
        same = left[key].eqNullSafe(partners["_key"]) if null_keys_match else (
            left[key] == partners["_key"]
        )
        result = left.join(partners, same, kind)
        return result.drop("_key") if kind in ("inner", "left") else result

    if is_bounded(other, max_bytes):
        return joined(facts, F.broadcast(right), how)

    hot = hot_keys(facts, key, hot_parts)
    hot_partners = right.join(F.broadcast(hot), right["_key"].eqNullSafe(hot["_hot"]), "left_semi")
    if how in ("left_semi", "left_anti"):
        hot_partners = hot_partners.select("_key").distinct()
    hot_facts, cold_facts = split_hot(facts, key, hot)
    if is_bounded(hot_partners, max_bytes):
        joined_hot = joined(hot_facts, F.broadcast(hot_partners), how)
    else:
        joined_hot = _joined_in_slices(hot_facts, hot_partners, key, how, null_keys_match)
    return joined_hot.unionByName(joined(cold_facts, right, how))


def _joined_in_slices(
    facts: DataFrame, partners: DataFrame, key: str, how: str, null_keys_match: bool
) -> DataFrame:
    """A join on ``key`` = ``_key`` in which each key's facts are dealt over several tasks."""
    # A row's place in its partition: the same in every try of the task that reads it.
    dealt = facts.withColumn("_slice", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    repeated = partners.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = dealt[key].eqNullSafe(repeated["_key"]) if null_keys_match else dealt[key] == repeated["_key"]
    return dealt.join(repeated, same & (dealt["_slice"] == repeated["_piece"]), how).drop("_slice", "_key", "_piece")


def dimension_join(facts: DataFrame, dimension: DataFrame, key: str, **options) -> DataFrame:
    """Left join of facts with a dimension; facts without a partner keep null attributes.

    A key listed several times in the dimension repeats its facts. Options as for
    :func:`join_on_key`.
    """
    return join_on_key(facts, dimension, key, "left", **options)


def author_key(name: Column, ignore_case: bool = False) -> Column:
    """Author name without ``@``, optionally in lower case."""
    key = F.replace(name, F.lit("@"), F.lit(""))
    return F.lower(key) if ignore_case else key


def join_authors(
    posts: DataFrame,
    authors: DataFrame,
    *,
    ignore_case: bool = False,
    null_keys_match: bool = True,
    **options,
) -> DataFrame:
    """Add the authors' groups to posts.

    ``@`` signs are ignored on both sides. As in a data-frame merge, missing authors
    match missing authors and a name listed twice in the dimension doubles its posts.
    """
    keyed = posts.withColumn("_author", author_key(F.col("Author"), ignore_case))
    dimension = authors.select(
        author_key(F.col("Author"), ignore_case).alias("_author"),
        *[c for c in authors.columns if c != "Author"],
    )
    return dimension_join(
        keyed, dimension, "_author", null_keys_match=null_keys_match, **options
    ).drop("_author")


def keep_matching(df: DataFrame, members: DataFrame, key: str, **options) -> DataFrame:
    """Rows whose key occurs in another table."""
    return join_on_key(df, members.select(key), key, "left_semi", **options)


def drop_matching(df: DataFrame, members: DataFrame, key: str, **options) -> DataFrame:
    """Rows whose key does not occur in another table; null keys stay."""
    return join_on_key(df, members.select(key), key, "left_anti", **options)
