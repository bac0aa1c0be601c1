"""Quality rules: fixed thresholds on counts, and a calibrated n-gram classifier.

A text fails at once by its counts. Otherwise the classifier decides: a logistic
regression over hashed word and character n-grams, trained on a bounded sample of
labelled rows, its probabilities calibrated on rows that the training has not seen.
Texts are scored in Arrow batches against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affectframe.llm import textstats as ts

# The thresholds of the counts.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
# The classifier rejects below this probability of being good.
LEAST_PROBABILITY = 0.3

BITS = 18  # of the hash of an n-gram
# Labelled rows that the classifier is fitted on: those with the smallest hashes of their ids.
SAMPLE_ROWS = 6_000
SEED = 42

_CHAR_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_WORD_FACTOR = np.uint32(0x27D4EB2F)
# Characters that one step looks at, which bounds the memory that a long text takes.
_STEP = 1 << 20
# Feature lists (two for each text) that training works on at once, which bounds its memory.
_BLOCK = 1_000
# Rows with their texts that a task sends back at once.
_ROWS = 500


def word_codes(words: list[bytes]) -> np.ndarray:
    """A hash of each word that does not depend on the process."""
    from zlib import crc32

    return np.fromiter(map(crc32, words), np.uint32, len(words))


def word_grams(codes: np.ndarray) -> np.ndarray:
    """Buckets of the words and of pairs of neighbours."""
    pairs = (codes[:-1] * _WORD_FACTOR) ^ (codes[1:] >> np.uint32(3)) * _CHAR_FACTORS[0]
    both = np.concatenate([codes * _CHAR_FACTORS[1], pairs])
    return both >> np.uint32(32 - BITS)


def char_grams(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of the text's three-character windows, step by step."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    for at in range(0, max(0, len(points) - 2), _STEP):
        p = points[at : at + _STEP + 2]
        mixed = (p[:-2] * _CHAR_FACTORS[0]) ^ (p[1:-1] * _CHAR_FACTORS[1]) ^ (p[2:] * _CHAR_FACTORS[2])
        yield (mixed * _WORD_FACTOR) >> np.uint32(32 - BITS)


def features(text: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words and for characters: different buckets, and their shares of all n-grams."""
    found = []
    for grams in ([word_grams(word_codes(text.split()))], char_grams(text)):
        counts = np.zeros(0, np.int64)
        for part in grams:
            more = np.bincount(part, minlength=1 << BITS)
            counts = more if not len(counts) else counts + more
        where = np.flatnonzero(counts)
        found.append((where, counts[where] / max(1, counts.sum())))
    return found


@dataclass(frozen=True)
class NgramModel:
    """Weights of word and character buckets, and a calibrated line for their sum."""

    words: np.ndarray
    chars: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, text: bytes) -> float:
        total, word = self.bias, word_grams(word_codes(text.split()))
        if len(word):
            total += float(self.words[word].mean(dtype=np.float64))
        summed = count = 0
        for part in char_grams(text):
            summed += float(self.chars[part].sum(dtype=np.float64))
            count += len(part)
        return total + summed / max(1, count)

    def probability(self, text: bytes) -> float:
        return float(_sigmoid(self.slope * self.margin(text) + self.shift))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def train_model(texts: list[bytes], labels: list[int], rounds: int = 300, rate: float = 2.0, decay: float = 1e-5) -> NgramModel:
    """Fit on four fifths of the texts, calibrate on the last.

    Gradient steps scaled by each weight's past gradients (AdaGrad) on the whole batch, so
    the result depends on the rows and their order only. With one class only, the
    probability is that class's share.
    """
    y = np.array(labels, float)
    if len(y) < 10 or y.min() == y.max():
        share = float((y.sum() + 1) / (len(y) + 2))
        flat = np.zeros(1 << BITS, np.float32)
        return NgramModel(flat, flat, float(np.log(share / (1 - share))))
    size, blocks, part = 2 << BITS, [], []
    for n, text in enumerate(texts):
        for channel, (where, share) in enumerate(features(text)):
            place = (where + (channel << BITS)).astype(np.int32)
            part.append((place, share.astype(np.float32), np.full(len(where), n, np.int32)))
        if len(part) >= _BLOCK or n == len(texts) - 1:
            blocks.append([np.concatenate(x) for x in zip(*part)])
            part = []

    def margins(w: np.ndarray) -> np.ndarray:
        return sum(np.bincount(row, value * w[place], len(y)) for place, value, row in blocks)

    fold = np.arange(len(y)) % 5 == 4
    # Both classes weigh the same in training; the calibration restores their shares.
    weight = np.where(y == 1, 0.5 / max(1, y[~fold].sum()), 0.5 / max(1, (1 - y[~fold]).sum()))
    weight[fold] = 0
    w, bias = np.zeros(size), 0.0
    seen, seen_bias = np.full(size, 1e-8), 1e-8
    for _ in range(rounds):
        error = weight * (_sigmoid(margins(w) + bias) - y)
        gradient = sum(np.bincount(place, value * error[row], size) for place, value, row in blocks) + decay * w
        seen += gradient**2
        seen_bias += error.sum() ** 2
        w -= rate * gradient / np.sqrt(seen)
        bias -= rate * error.sum() / np.sqrt(seen_bias)
    margin = margins(w) + bias
    slope, shift = _calibrated(margin[fold], y[fold])
    tables = w.astype(np.float32)
    return NgramModel(tables[: 1 << BITS], tables[1 << BITS :], float(bias), slope, shift)


def _calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through held-back rows (Platt's method)."""
    positive = y.sum()
    # Targets a little inside (0, 1), so rows without an error do not give an endless slope.
    t = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (len(y) - positive + 2))
    a, b = 1.0, 0.0
    x = np.column_stack([margin, np.ones(len(margin))])
    for _ in range(50):
        p = _sigmoid(a * margin + b)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-6
        step = np.linalg.solve(hessian, x.T @ (p - t))
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
    return float(max(a, 1e-3)), float(b)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """``place, text, label`` of at most so many labelled documents, those with the smallest hashes.

    The ids are chosen before a text is moved: of the labels, ``rows`` stay, and their
    number bounds what is broadcast.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    known = known.withColumn("place", F.xxhash64(F.lit(SEED), "id"))
    chosen = known.orderBy("place", "id", "label").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id").orderBy("place", "id", "label", F.xxhash64("text")).limit(rows)


def fit_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", *, sample_rows: int = SAMPLE_ROWS, learn=None,
) -> NgramModel:
    """The classifier, fitted in one task on the bounded sample of labelled rows.

    ``learn`` tells which ids may be learned from (all, if absent).
    """
    labels = labels if learn is None else labels.filter(learn(F.col(id_col)))
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, sample_rows)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            texts += [ts.body(t) for t in batch.column(0).cast(pa.large_binary())]
            marks += batch.column(1).to_pylist()
        model = train_model(texts, marks)
        packed = np.concatenate([model.words, model.chars]).tobytes()
        yield pa.RecordBatch.from_pydict({
            "weights": [packed], "bias": [model.bias], "slope": [model.slope], "shift": [model.shift]
        })

    schema = "weights binary, bias double, slope double, shift double"
    row = sample.select("text", "label").coalesce(1).mapInArrow(fit, schema).first()
    if row is None:  # no labelled row, so no task either
        return train_model([], [])
    weights = np.frombuffer(row.weights, np.float32)
    return NgramModel(weights[: 1 << BITS], weights[1 << BITS :], row.bias, row.slope, row.shift)


VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


def _verdicts(texts: pa.Array, model: NgramModel, least_probability: float) -> list[pa.Array]:
    """The columns of ``VERDICT`` for one batch of texts; a null text is empty."""
    texts = texts.cast(pa.large_binary())
    counts, probabilities = np.zeros((len(texts), 5), np.int64), np.zeros(len(texts))
    for n, text in enumerate(map(ts.body, texts)):
        counts[n] = ts.base_counts(text)
        probabilities[n] = model.probability(text)
    failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED_PERCENT * counts[:, 0])
    kept = ~failed & (probabilities >= least_probability)
    return [*(pa.array(counts[:, i]) for i in range(5)), pa.array(failed), pa.array(probabilities), pa.array(kept)]


def judged(rows: DataFrame, text_col: str, model: NgramModel, least_probability: float = LEAST_PROBABILITY) -> DataFrame:
    """The rows with their verdict, in the columns of ``VERDICT``, in place of the text column.

    A null text is empty. Rows stay where they are.
    """
    others = [c for c in rows.columns if c != text_col]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [*batch.columns[:-1], *_verdicts(batch.column(batch.num_columns - 1), model, least_probability)]
            yield pa.RecordBatch.from_arrays(columns, [*others, *names])

    added = T.StructType.fromDDL(VERDICT)
    names = added.fieldNames()
    ordered = rows.select(*[F.col(f"`{c}`") for c in others], F.col(text_col))
    return ordered.mapInArrow(judge, T.StructType([*ordered.schema.fields[:-1], *added.fields]))


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``id`` and the columns of ``VERDICT`` for each document.

    Defined cases: a null text has no words and fails; without labels of both classes the
    classifier gives every text the same probability; rows that share an id are judged
    each by its own text; an empty table gives an empty one.
    """
    model = fit_rules(docs, labels, id_col, text_col, **options)
    return judged(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", model)


def passing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    model = fit_rules(docs, labels, id_col, text_col, **options)
    named = docs.columns.index(text_col) if text_col in docs.columns else None
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    if named is None:  # a field of a column, or a name in other letters
        return judged(docs.select(row, F.col(text_col).alias("text")), "text", model).filter("kept").select("row.*")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                rows = batch.column(0).slice(at, _ROWS)
                *_, kept = _verdicts(rows.field(named), model, LEAST_PROBABILITY)
                yield pa.RecordBatch.from_arrays([rows.filter(kept)], ["row"])

    # Tasks get each text once, inside its row, and send back only the rows that stay.
    packed = docs.select(row)
    return packed.mapInArrow(judge, packed.schema).select("row.*")
