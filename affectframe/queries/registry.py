"""Registry of queries and helpers they share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affectframe.operators.joins import dimension_join
from affectframe.sources.readers import spread

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Runner
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Runner], Runner]:
    """Register a function under its name, with the equivalent SQL if there is one."""

    def register(run: Runner) -> Runner:
        if run.__name__ in REGISTRY:
            raise ValueError(f"query {run.__name__} exists already")
        REGISTRY[run.__name__] = Query(run, sql)
        return run

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Documents for work on their texts, with the named columns (all if none are)."""
    frame = table(spark, sf, "documents")
    return spread(frame.select(*columns) if columns else frame, "doc_id")


def authors(spark: SparkSession, sf: str) -> DataFrame:
    """Author dimension: ``Author, party, political_side``."""
    customer, nation, region = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(
            F.col("c_custkey").alias("Author"),
            F.col("c_mktsegment").alias("party"),
            F.col("r_name").alias("political_side"),
        )
    )


def bare_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts before the author join."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ID"),
        F.col("o_custkey").alias("Author"),
        F.col("o_orderstatus").alias("topic"),
        F.col("o_orderpriority").alias("predicted_emotions"),
        F.col("o_orderdate").alias("Date"),
    )


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled posts with their authors' groups."""
    return dimension_join(bare_posts(spark, sf), authors(spark, sf), "Author")


# The same table in SQL, for a WITH clause.
POSTS = """posts AS (
  SELECT o_orderkey AS "ID", o_custkey AS "Author", c_mktsegment AS party,
         r_name AS political_side, o_orderstatus AS topic,
         o_orderpriority AS predicted_emotions, o_orderdate AS moment
  FROM orders
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
)"""
