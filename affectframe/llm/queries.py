"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affectframe.llm import (
    alignment,
    balltree,
    discriminant,
    exact,
    gnat,
    lines,
    mixing,
    pieces,
    rules,
    sampling,
    secret_rules,
    simhash,
    substrings,
)

Runner = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Runner] = {}
SQL: dict[str, str] = {}


def _register(sql: str | None = None) -> Callable[[Runner], Runner]:
    def register(run: Runner) -> Runner:
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return register


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/labels.parquet")


@_register()
def op1_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Score of each whole text, learned from the labels that are not held out."""
    rows = discriminant.quality_scores(_documents(spark, sf), _labels(spark, sf))
    return rows.select(
        F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@_register(mixing.oracle())
def op3_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Words that the mix takes of each document."""
    rows = mixing.mixed_words(_documents(spark, sf))
    return rows.withColumnRenamed("id", "doc_id")


@_register("""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents
), g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT doc_id, keep_id, group_size,
       doc_id IS NOT DISTINCT FROM keep_id
         AND row_number() OVER (PARTITION BY body, doc_id) = 1 AS kept,
       sha256(body) AS text_sha256
FROM t JOIN g USING (body)
""")
def op6_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of equal texts, and the row of each that stays."""
    rows = exact.exact_groups(_documents(spark, sf))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


@_register(secret_rules.oracle())
def op4_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets of each whole text: counts of the base kinds, a hash of their spans, all spans."""
    rows = secret_rules.digests(secret_rules.scan(_documents(spark, sf)))
    return rows.withColumnRenamed("id", "doc_id")


@_register()
def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of each whole text, and whether the rules keep it."""
    rows = rules.quality_rules(_documents(spark, sf), _labels(spark, sf), learn=lambda i: ~discriminant.held_out(i))
    return rows.withColumnRenamed("id", "doc_id")


@_register()
def op7_simhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint of each whole text, and the smallest id that near fingerprints lead to."""
    rows = simhash.near_duplicates(_documents(spark, sf))
    return rows.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@_register()
def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces on the best path of each whole text."""
    return pieces.token_counts(_documents(spark, sf)).withColumnRenamed("id", "doc_id")


@_register()
def op10_piece_sampling(spark: SparkSession, sf: str) -> DataFrame:
    """A sampled segmentation of each whole text, its length and hash, and the text it decodes to."""
    rows = sampling.encode_and_decode(_documents(spark, sf).select("doc_id", "text"))
    return rows.select(
        "doc_id", F.size("pieces").cast("bigint").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "lossless",
    )


@_register()
def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each document, how many it loses to earlier ones, and a hash of what is left."""
    rows = lines.deduplicated(_documents(spark, sf))
    return rows.select(
        F.col("id").alias("doc_id"), "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@_register()
def op9_repeated_substrings(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of each whole text that strings of 200 repeated bytes cover, and a hash of the rest."""
    rows = substrings.without_repeats(_documents(spark, sf))
    length = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return rows.select(
        F.col("id").alias("doc_id"), "n_bytes", length.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@_register()
def op11_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of two tokenizers over each whole text: groups, overlap links, and their corpus-wide counts."""
    return alignment.aligned(_documents(spark, sf)).withColumnRenamed("id", "doc_id")


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def _whole(scale: int, label: str) -> str:
    """The rows that take part, with whole numbers for components."""
    return f"""
rows AS (
  SELECT row_number() OVER () AS row, vec_id, {label} AS label,
         list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)"""


@_register(f"""
WITH {_whole(1024, "0")}, s AS (
  SELECT q.row AS q, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM rows q JOIN rows c ON q.row <> c.row AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
""")
def op12_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The ten vectors with the highest inner products for each hundredth vector, among all."""
    return balltree.top_k(_embeddings(spark, sf), F.col("vec_id") % 100 == 0)


@_register(f"""
WITH {_whole(256, "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")}, s AS (
  SELECT a.row AS a, a.vec_id AS anchor_id, c.vec_id, c.row, a.label = c.label AS same,
         list_inner_product(a.v, c.v)::BIGINT AS score
  FROM rows a JOIN rows c ON a.row <> c.row AND len(a.v) = len(c.v)
  WHERE a.vec_id % 100 = 0 AND a.label IS NOT NULL AND c.label IS NOT NULL
), p AS (
  SELECT a, anchor_id, vec_id AS positive_id, row AS positive, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST) <= 5
), n AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.positive ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same
    AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""")
def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of other labels that score 30 to 90 percent of each positive of each hundredth vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return gnat.hard_negatives(_embeddings(spark, sf), F.col("vec_id") % 100 == 0, label)
