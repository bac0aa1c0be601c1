"""The corpus pipeline: stages that each call an operator on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affectframe.llm import discriminant, lines, mixing, rules, sampling, simhash
from affectframe.session import new_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the classifier learns from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rules.passing(docs, labels, learn=lambda doc_id: ~discriminant.held_out(doc_id))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that they share with earlier ones; ``n_chars`` follows the text."""
    edited = lines.deduplicated(docs)
    columns = [
        F.col("kept_text").alias(name) if name == "text"
        else F.length("kept_text").cast(kind).alias(name) if name == "n_chars"
        else F.col("row")[name].alias(name)
        for name, kind in docs.dtypes
    ]
    return edited.select(*columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return mixing.mix(docs)


def piece_sampling(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the pieces of a sampled segmentation, and whether they decode to its text."""
    rows = sampling.encode_and_decode(docs.select("doc_id", "source", "text"))
    return rows.select("doc_id", "source", "pieces", F.size("pieces").alias("n_pieces"), "lossless")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", piece_sampling),
]

# A trained model and a sampler are not expressed in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are stored before the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        path = new_dir(spark, f"stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
