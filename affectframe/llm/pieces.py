"""Word pieces of a public tokenizer: the vocabulary, and counts of pieces by Viterbi.

The vocabulary is read from a tokenizer's file; nothing is trained. The pieces' scores are
those of a unigram model whose pieces follow a power law in the order of the file:
``-ln(rank + 1)``, rounded to 1/1024 so that sums are exact in any order.

Spaces are written as U+2581 and one stands before the text, as is usual. No piece goes on
beyond a word into the next space, nor holds a line break; so the best path of a text
consists of those of its words, and counts of words are remembered within a task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"

# Words whose counts a task remembers, and the longest of them.
_REMEMBERED, _LONGEST = 400_000, 64


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by number with their scores; ``byte_ids[b]`` is the piece that stands for byte b."""

    scores: dict[str, float]
    ids: dict[str, int]
    byte_ids: tuple[int, ...]
    unknown: float  # score of a character without a piece

    def alphabet(self) -> frozenset[str]:
        return frozenset(piece for piece in self.scores if len(piece) == 1)

    def table(self) -> dict[int, bytes]:
        """What each number stands for."""
        out = {i: piece.replace(SPACE, " ").encode() for piece, i in self.ids.items()}
        return out | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}


def vocabulary(scores: dict[str, float], ids: dict[str, int], byte_ids) -> Vocabulary:
    for piece in scores:
        if "\n" in piece or SPACE in piece.lstrip(SPACE):
            raise ValueError(f"piece {piece!r} goes on beyond a word")
    if SPACE not in scores or len(byte_ids) != 256:
        raise ValueError("the vocabulary needs a piece for the space and for each byte")
    return Vocabulary(scores, ids, tuple(byte_ids), min(scores.values()) - 10.0)


def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a SentencePiece file, read by the driver and sent with the tasks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    numbers = range(model.get_piece_size())
    plain = [i for i in numbers if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    plain.sort(key=lambda i: (-model.get_score(i), i))
    ids = {model.id_to_piece(i): i for i in plain}
    scores = {piece: -round(math.log(rank + 1) * 1024) / 1024 for rank, piece in enumerate(ids, 1)}
    by_byte = {int(model.id_to_piece(i)[3:-1], 16): i for i in numbers if model.is_byte(i)}
    return vocabulary(scores, ids, [by_byte[b] for b in sorted(by_byte)])


def automaton(vocab: Vocabulary):
    """Aho-Corasick automaton over the pieces; a match gives length, score and number."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for piece, score in vocab.scores.items():
        machine.add_word(piece, (len(piece), score, vocab.ids[piece]))
    machine.make_automaton()
    return machine


CHUNK = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


def chunks(text: str) -> list[str]:
    """Parts that no piece goes beyond."""
    return CHUNK.findall(SPACE + text.replace(" ", SPACE)) if text else []


def matches(chunk: str, machine, alphabet: frozenset[str], unknown: float):
    """``end, (length, score, number)`` of all pieces in a word, by end and then longest first.

    A character that is no piece by itself is listed with a negative number, after the
    pieces that end with it.
    """
    found = machine.iter(chunk)
    if alphabet.issuperset(chunk):
        return found
    missing = [(i, (1, unknown, -1 - i)) for i, c in enumerate(chunk) if c not in alphabet]
    return sorted([*found, *missing], key=lambda match: match[0])


def count_pieces(chunk: str, found) -> int:
    """Pieces on the best path; characters without a piece count their UTF-8 bytes.

    Of paths with equal scores up to a place, the one whose last piece starts first is
    taken: the longest match is listed first, and only a higher score wins.
    """
    best = [0.0] * (len(chunk) + 1)
    count = [0] * (len(chunk) + 1)
    before = -1
    for end, (length, score, number) in found:
        start = end + 1 - length
        score += best[start]
        if end != before or score > best[end + 1]:
            before = end
            best[end + 1] = score
            count[end + 1] = count[start] + (1 if number >= 0 else len(chunk[end].encode()))
    return count[-1]


class _Remembered(dict):
    """A word's value by a function, for as many words as fit."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, chunk):
        value = self.make(chunk)
        if len(chunk) <= _LONGEST:
            if len(self) >= _REMEMBERED:
                self.clear()
            self[chunk] = value
        return value


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocab: Vocabulary | None = None) -> DataFrame:
    """``id, n_chars, n_tokens`` of each document: pieces on the best path of the whole text.

    Defined cases: a null or empty text has none; equal rows are counted each; rows stay
    where they are, and other columns are not looked at.
    """
    vocab = vocab or load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(vocab)
        alphabet = vocab.alphabet()
        counts = _Remembered(lambda chunk: count_pieces(chunk, matches(chunk, machine, alphabet, vocab.unknown)))
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            tokens = [sum(map(counts.__getitem__, chunks(t))) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(tokens, pa.int64())],
                ["id", "n_chars", "n_tokens"],
            )

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([narrow.schema["id"], T.StructField("n_chars", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return narrow.mapInArrow(run, schema)
