"""Quality of texts by a regularised quadratic discriminant over their statistics.

Each class of labelled texts gets a mean and a covariance of the transformed statistics.
The covariances are shrunk towards the pooled one and its diagonal. A text's score
follows from the difference of its log densities, that is of Mahalanobis distances, for
which the Cholesky factors are computed once and sent with the tasks.

The classes are gathered as sums of whole numbers: the transformed statistics are rounded
to multiples of 1/``GRID`` and bounded, so sums do not depend on the order of the rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affectframe.llm import textstats as ts
from affectframe.llm.common import stored

GRID = 1024
LIMIT = 16 * GRID  # no transformed statistic is larger

# Of a class's covariance: so much comes from the pooled one, then so much from a diagonal.
TOWARDS_POOLED = 0.1
TOWARDS_DIAGONAL = 0.05
# Log-density differences of dependent statistics are too sure of themselves.
TEMPERATURE = 4.0

STATISTICS = (
    "words", "word_length", "distinct", "upper", "digits", "symbols", "marks", "points",
    "lines", "line_words", "dup_lines", "repeats", "short_words", "top_word", "not_ascii",
)


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of a text: logarithms of counts, square roots of shares."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    letters = ts.held(text, ts.UPPER_BYTES) + ts.held(text, ts.LOWER_BYTES)
    counts = Counter(words)
    n_lines, dup_lines = ts.duplicate_lines(text)
    chars = sum(map(len, words))
    return [
        np.log1p(n),
        np.log1p(chars / max(1, n)),
        len(counts) / max(1, n),
        (ts.held(text, ts.UPPER_BYTES) / max(1, letters)) ** 0.5,
        (ts.held(text, ts.DIGIT_BYTES) / size) ** 0.5,
        (ts.held(text, ts.SYMBOL_BYTES) / size) ** 0.5,
        (ts.held(text, ts.MARK_BYTES) / size) ** 0.5,
        (ts.held(text, ts.POINT_BYTES) / size) ** 0.5,
        np.log1p(n_lines),
        np.log1p(n / max(1, n_lines)),
        (dup_lines / max(1, n_lines)) ** 0.5,
        (ts.repeated_words(words) / max(1, n)) ** 0.5,
        sum(c for w, c in counts.items() if len(w) <= 3) / max(1, n),
        (max(counts.values(), default=0) / max(1, n)) ** 0.5,
        (ts.held(text, ts._HIGH) / size) ** 0.5,
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        rows = np.array([statistics(ts.body(t)) for t in texts]).reshape(len(texts), len(STATISTICS))
        grid = np.clip(np.rint(rows * GRID), -LIMIT, LIMIT).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(grid[:, i]) for i in range(len(STATISTICS)))],
            ["id", *STATISTICS],
        )


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` and the statistics, as multiples of 1/``GRID``."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = [narrow.schema["id"], *(T.StructField(s, T.LongType()) for s in STATISTICS)]
    return narrow.mapInArrow(_measure, T.StructType(kinds))


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log weights (prior and volume) of classes 0 and 1."""

    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    offsets: tuple[float, float]
    temperature: float = TEMPERATURE

    def scores(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets):
            z = (x - mean) @ factor.T
            logs.append(offset - 0.5 * np.einsum("ij,ij->i", z, z))
        difference = np.clip((logs[1] - logs[0]) / self.temperature, -500, 500)
        return 1.0 / (1.0 + np.exp(-difference))


def fit(
    rows: DataFrame, *, towards_pooled: float = TOWARDS_POOLED,
    towards_diagonal: float = TOWARDS_DIAGONAL, temperature: float = TEMPERATURE,
) -> Discriminant:
    """Fit on all rows of ``label`` (0 or 1) with the statistics.

    One aggregation over all rows gives two rows of sums, whatever their number. A class
    without rows takes the other one's distribution; then scores say nothing but the prior.
    """
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = rows.filter(F.col("label").isin(0, 1)).groupBy("label").agg(
        F.count("*").alias("n"),
        *[F.sum(s).alias(f"s{i}") for i, s in enumerate(STATISTICS)],
        *[F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"p{i}_{j}") for i, j in pairs],
    ).collect()
    n = np.zeros(2)
    means, covariances = np.zeros((2, d)), np.zeros((2, d, d))
    for row in sums:
        k = int(row.label)
        n[k] = row.n
        means[k] = [row[f"s{i}"] / row.n for i in range(d)]
        for i, j in pairs:
            covariances[k, i, j] = covariances[k, j, i] = row[f"p{i}_{j}"] / row.n - means[k, i] * means[k, j]
    means, covariances = means / GRID, covariances / GRID**2
    for k in (0, 1):
        if not n[k]:
            means[k], covariances[k] = means[1 - k], covariances[1 - k]
    total = max(1.0, n.sum())
    pooled = (covariances[0] * n[0] + covariances[1] * n[1]) / total
    factors, offsets = [], []
    for k in (0, 1):
        mixed = (1 - towards_pooled) * covariances[k] + towards_pooled * pooled
        # The floor is a thousandth of the range that the rounded statistics can tell apart.
        diagonal = np.diag(np.diag(mixed)) + np.eye(d) * 1e-3
        lower = np.linalg.cholesky((1 - towards_diagonal) * mixed + towards_diagonal * diagonal)
        factors.append(np.linalg.inv(lower))
        offsets.append(float(np.log((n[k] + 1) / (total + 2)) - np.log(np.diag(lower)).sum()))
    return Discriminant((means[0], means[1]), tuple(factors), tuple(offsets), temperature)


def scored(rows: DataFrame, model: Discriminant) -> DataFrame:
    """``id, score`` of measured rows."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(STATISTICS))])
            scores = model.scores(x.astype(float) / GRID)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["id", "score"])

    schema = T.StructType([rows.schema["id"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(score, schema)


def held_out(doc_id):
    """Whether a document's label may not be learned from. A null id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", **options,
) -> DataFrame:
    """``id, held_out, score`` of each document; the higher the score, the likelier label 1.

    Learns from labelled documents that are not held out; nothing but the text is an
    input of a score. Defined cases: a null text is empty; a label other than 0 and 1, or
    of no document, is ignored; an id that is listed several times counts as often as it
    is listed; without labels all scores are 0.5; an empty table gives an empty one.
    """
    rows = stored(measured(docs, id_col, text_col), "statistics")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(~held_out(F.col("id")) & F.col("label").isNotNull())
    model = fit(rows.join(known, "id"), **options)
    return scored(rows, model).select("id", held_out(F.col("id")).alias("held_out"), "score")
