"""Sampled segmentations of texts into word pieces, and their lossless decoding.

A word's lattice has a node for each place and an edge for each piece that fits. Forward
filtering gives each node the weight of all paths to it; backward sampling walks from the
last node and takes an edge with its share in the node's weight. Both run over many words
at once, place by place: filtering over words that no earlier text of the task had,
sampling over the words of a batch of texts, some thousands at a time.

Draws are hashes of the row's seed, the word's place in the text and the number of the
choice, so a segmentation depends on nothing else.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affectframe.llm.pieces import CHUNK, SPACE, Vocabulary, load

SEED = 42
# Sharpness of sampling: 0 takes all segmentations alike, the larger the nearer to the best one.
SHARPNESS = 0.5

# Characters of texts that are segmented together; a longer text makes a batch of its own.
_STEP = 1 << 17
# Words that are sampled at once, and characters of new words whose lattices are made at once
# (a longer word is alone); they bound the arrays that a step takes, however long a text is.
_WORDS = 1 << 15
_CHARACTERS = 1 << 15

# The space's mark where a text itself holds it; it is spelled in bytes.
_MARK = "\n" + SPACE

# Edges whose lattices a task keeps: 16 bytes each, and about as much again for the words.
_KEPT = 1_000_000

_POINT_BITS = 21


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


class Matcher:
    """The pieces as a tree of characters; a hash table holds the step from a node by a character."""

    _BITS = 19

    def __init__(self, vocab: Vocabulary, sharpness: float):
        self.byte_ids = np.array(vocab.byte_ids)
        self.unknown = sharpness * vocab.unknown
        self.lengths = max(map(len, vocab.scores))
        steps, ends = {-1: 0}, []
        for piece in vocab.scores:
            node = 0
            for letter in piece:
                node = steps.setdefault(node << _POINT_BITS | ord(letter), len(steps))
            ends.append(node)
        # The step that leads to each node; nothing leads to the root.
        self.steps = np.fromiter(steps, np.int64, len(steps))
        self.piece = np.full(len(steps), -1, np.int32)
        self.piece[ends] = np.arange(len(ends))
        self.weights = np.array([sharpness * score for score in vocab.scores.values()])
        self.numbers = np.array([vocab.ids[p] for p in vocab.scores])
        # Slots of a table hold one node each; those that find theirs taken go to a further table.
        self.slots, rest = [], np.arange(1, len(steps))
        while len(rest):
            table = np.zeros(1 << self._BITS, np.int32)
            own = self._slot(self.steps[rest], len(self.slots))
            table[own] = rest
            rest = rest[table[own] != rest]
            self.slots.append(table)

    def _slot(self, steps: np.ndarray, table: int) -> np.ndarray:
        factor = np.uint64(2 * table + 0xD1342543DE82EF95)
        return (steps.view(np.uint64) * factor >> np.uint64(64 - self._BITS)).view(np.int64)

    def _next(self, steps: np.ndarray) -> np.ndarray:
        """The node that each step leads to, 0 where there is none."""
        found = self.slots[0][self._slot(steps, 0)]
        other = np.flatnonzero((self.steps[found] != steps) & (found > 0))
        for n, slots in enumerate(self.slots[1:], 1):
            if not len(other):
                break
            found[other] = slots[self._slot(steps[other], n)]
            other = other[(self.steps[found[other]] != steps[other]) & (found[other] > 0)]
        found[self.steps[found] != steps] = 0
        return found

    def edges(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """``last, length, weight, number`` of the pieces in several words laid end to end.

        ``ends`` has the end of the word at each place. Edges come by their last place,
        longer ones first. A character without a piece has a negative number.
        """
        letters = points.astype(np.int64)
        places, nodes = np.arange(len(points)), np.zeros(len(points), np.int64)
        # The piece of each length that ends at each place; -1 for none.
        table = np.full((len(points), self.lengths), -1, np.int32)
        for length in range(1, self.lengths + 1):
            fits = places + length <= ends[places]
            places, nodes = places[fits], nodes[fits]
            nodes = self._next(nodes << _POINT_BITS | letters[places + (length - 1)]).astype(np.int64)
            goes_on = np.flatnonzero(nodes)
            places, nodes = places[goes_on], nodes[goes_on]
            if not len(places):
                break
            piece = self.piece[nodes]
            hit = np.flatnonzero(piece >= 0)
            table[places[hit] + (length - 1), self.lengths - length] = piece[hit]
        single = table[:, -1]
        single[single < 0] = len(self.numbers)
        cells = np.flatnonzero(table.ravel() >= 0)
        piece = table.ravel()[cells]
        last = cells // self.lengths
        number = np.append(self.numbers, 0)[piece]
        missing = np.flatnonzero(piece == len(self.numbers))
        number[missing] = -1 - letters[last[missing]]
        return last, self.lengths - cells % self.lengths, np.append(self.weights, self.unknown)[piece], number


def _put(array: np.ndarray, used: int, values: np.ndarray) -> np.ndarray:
    """The array with values behind its used part, made longer if they do not fit."""
    upto = used + len(values)
    if upto > len(array):
        array = np.concatenate([array[:used], np.empty(max(upto, 2 * used) - used, array.dtype)])
    array[used:upto] = values
    return array


def _blocks(words: list[str]) -> Iterator[list[str]]:
    """The words in parts of at most ``_CHARACTERS`` characters; a longer word is a part of its own."""
    start = held = 0
    for at, word in enumerate(words):
        if at > start and held + len(word) > _CHARACTERS:
            yield words[start:at]
            start, held = at, 0
        held += len(word)
    if words:
        yield words[start:]


class Lattices:
    """The lattices of different words after forward filtering.

    A word's lattice is made when the word first comes and kept for the words that
    follow. Beyond ``_KEPT`` edges all are given up before the next words are looked up.
    """

    def __init__(self, matcher: Matcher):
        self.matcher = matcher
        # Of each word, its first and last node; of each node, its edges; of each edge, where
        # it starts, its piece, and the share of the node's weight up to it.
        self.first, self.last, self.opens, self.closes, self.start, self.number = (np.empty(0, np.int32) for _ in range(6))
        self.upto = np.empty(0)
        self._clear()

    def _clear(self) -> None:
        self.known = defaultdict(count().__next__)
        self.n_words = self.n_nodes = self.n_edges = 0

    def of(self, words: list[str]) -> np.ndarray:
        """The numbers of the words, whose lattices are there from then on."""
        if self.n_edges > _KEPT:
            self._clear()
        codes = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        for new in _blocks(list(islice(self.known, self.n_words, None))):
            self._add(new)
        return codes

    def _add(self, words: list[str]) -> None:
        sizes = np.array([1 if w == _MARK else len(w) for w in words])
        points = _points([SPACE if w == _MARK else w for w in words])
        word = np.repeat(np.arange(len(words)), sizes)
        place, length, weight, number = self.matcher.edges(points, np.repeat(np.cumsum(sizes), sizes))
        marks = np.flatnonzero(np.array([w == _MARK for w in words]))
        if len(marks):
            number[np.isin(word[place], marks)] = -1 - ord(SPACE)
        # A word has one node more than places.
        first = np.cumsum(sizes + 1) - (sizes + 1)
        n_nodes = int(first[-1] + sizes[-1]) + 1
        end = place + word[place] + 1
        depth = end - first[word[place]]
        # Stable, so edges of one depth stay in the order of their nodes; short keys sort fast.
        order = np.argsort(depth.astype(np.uint16) if sizes.max() < 1 << 16 else depth, kind="stable")
        end, weight, depth = end[order], weight[order], depth[order]
        start = end - length[order]
        new = end[1:] != end[:-1]
        opens = np.flatnonzero(np.concatenate([[True], new]))
        closes = np.append(opens[1:], len(end))
        group = np.concatenate([[0], np.cumsum(new)])
        logs = np.zeros(n_nodes)  # of all paths to a node
        shares = np.empty(len(end))
        level = np.flatnonzero(np.concatenate([[True], depth[1:] != depth[:-1]]))
        for a, b in zip(level, np.append(level[1:], len(end))):
            ga, gb = group[a], group[b - 1] + 1
            cut = opens[ga:gb] - a
            mass = logs[start[a:b]] + weight[a:b]
            top = np.maximum.reduceat(mass, cut)
            own = group[a:b] - ga
            mass = np.exp(mass - top[own])
            total = np.add.reduceat(mass, cut)
            logs[end[opens[ga:gb]]] = top + np.log(total)
            shares[a:b] = mass / total[own]
        running = np.cumsum(shares)
        below = np.concatenate([[0.0], running[closes - 1]])[:-1]
        node_opens, node_closes = np.zeros(n_nodes, np.int32), np.zeros(n_nodes, np.int32)
        node_opens[end[opens]], node_closes[end[opens]] = opens + self.n_edges, closes + self.n_edges
        self.first = _put(self.first, self.n_words, first + self.n_nodes)
        self.last = _put(self.last, self.n_words, first + sizes + self.n_nodes)
        self.opens = _put(self.opens, self.n_nodes, node_opens)
        self.closes = _put(self.closes, self.n_nodes, node_closes)
        self.start = _put(self.start, self.n_edges, start + self.n_nodes)
        self.number = _put(self.number, self.n_edges, number[order])
        self.upto = _put(self.upto, self.n_edges, np.minimum(running - below[group], 1.0))
        self.n_words, self.n_nodes, self.n_edges = self.n_words + len(words), self.n_nodes + n_nodes, self.n_edges + len(end)

    def sample(self, words: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of one path for each listed word, and how many each has."""
        node, first, active, step = self.last[words], self.first[words], np.arange(len(words)), 0
        taken, found = np.zeros(len(words), np.int64), []
        while len(active):
            at, sought = node[active], uniform(seeds[active], step)
            edge, last = self.opens[at], self.closes[at] - 1
            below = np.flatnonzero((edge < last) & (self.upto[edge] <= sought))
            while len(below):  # nodes have few edges
                edge[below] += 1
                now = edge[below]
                below = below[(now < last[below]) & (self.upto[now] <= sought[below])]
            found.append((active, self.number[edge]))
            taken[active] += 1
            node[active] = at = self.start[edge]
            active = active[at != first[active]]
            step += 1
        # Paths were walked backwards.
        ends = np.cumsum(taken)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        for step, (active, numbers) in enumerate(found):
            out[ends[active] - 1 - step] = numbers
        return out, taken


def uniform(seeds: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) from 53 bits of a hash of seed and step."""
    x = seeds + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def row_seed(seed: int, key, text: str) -> int:
    """The seed of a row; a missing key is replaced by the text."""
    name = (f"{seed}:{key}" if key is not None else f"{seed}::{text}").encode()
    return crc32(name) | crc32(name, 1) << 32


def spelled(numbers: np.ndarray, counts: np.ndarray, byte_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces with characters that have none spelled in bytes, and the new counts of the words."""
    missing = np.flatnonzero(numbers < 0)
    if not len(missing):
        return numbers, counts
    points, which = np.unique(-1 - numbers[missing], return_inverse=True)
    spelling = [np.frombuffer(chr(p).encode(), np.uint8) for p in points]
    size = np.ones(len(numbers), np.int64)
    size[missing] = np.array([len(s) for s in spelling])[which]
    begin = np.cumsum(size) - size
    out = np.repeat(numbers, size)
    for k, letters in enumerate(spelling):
        at = begin[missing[which == k]]
        for i, letter in enumerate(letters):
            out[at + i] = byte_ids[letter]
    word = np.repeat(np.arange(len(counts)), counts)
    return out, np.bincount(word, size, len(counts)).astype(np.int64)


def parts(text: str) -> list[str]:
    """The words of a text, with a space in front; no piece goes beyond one."""
    found = []
    for k, part in enumerate(text.split(SPACE)):
        if k:
            found.append(_MARK)
        part = part.replace(" ", SPACE)
        found += CHUNK.findall(part if k else SPACE + part)
    return found


def segment(
    texts: list[str], seeds: list[int], matcher: Matcher, lattices: Lattices | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all texts in a row, and how many each text has. An empty text has none.

    ``lattices`` are those of earlier batches; what they hold does not change the pieces.
    """
    words, sizes = [], []
    for text in texts:
        own = parts(text) if text else []
        words += own
        sizes.append(len(own))
    sizes = np.array(sizes, np.int64)
    if not words:
        return np.zeros(0, np.int64), sizes
    lattices = lattices or Lattices(matcher)
    ends = np.cumsum(sizes)
    nth = np.arange(len(words)) - np.repeat(ends - sizes, sizes)
    own_seeds = np.repeat(np.array(seeds, np.uint64), sizes) ^ (nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    found = []
    for at in range(0, len(words), _WORDS):
        codes = lattices.of(words[at : at + _WORDS])
        found.append(spelled(*lattices.sample(codes, own_seeds[at : at + _WORDS]), matcher.byte_ids))
    numbers, counts = map(np.concatenate, zip(*found))
    upto = np.concatenate([[0], np.cumsum(counts)])
    upto = upto[np.concatenate([[0], ends])]
    return numbers, upto[1:] - upto[:-1]


def decoded(numbers, table: dict[int, bytes]) -> str:
    """The text of a segmentation: the pieces' bytes without the space put in front."""
    return b"".join(map(table.__getitem__, numbers))[1:].decode()


class Decoder:
    """Texts of many segmentations at once, as :func:`decoded` gives each of them."""

    def __init__(self, table: dict[int, bytes]):
        self.letters = np.frombuffer(b"".join(table.values()), np.uint8)
        sizes = np.array([len(piece) for piece in table.values()])
        self.begin, self.size = np.zeros((2, max(table) + 1), np.int64)
        self.begin[list(table)], self.size[list(table)] = np.cumsum(sizes) - sizes, sizes

    def texts(self, numbers: np.ndarray, ends: np.ndarray) -> list[str]:
        """Of each text, whose pieces are those between two neighbouring ends."""
        size = self.size[numbers]
        upto = np.concatenate([[0], np.cumsum(size)])
        places = np.repeat(self.begin[numbers] - upto[:-1], size) + np.arange(upto[-1])
        letters, cuts = self.letters[places].tobytes(), upto[ends].tolist()
        return [letters[a + 1 : b].decode() for a, b in zip(cuts[:-1], cuts[1:])]


def _packed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns as one struct, so that tasks get each value once, whatever its name."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))


def _place(docs: DataFrame, name: str) -> int:
    return [c.lower() for c in docs.columns].index(name.lower())


def _segmented(docs: DataFrame, id_col: str, text_col: str, vocab: Vocabulary, seed: int, sharpness: float, back: bool) -> DataFrame:
    """``row`` (the columns but for the text, if ``back``), ``pieces`` and, if ``back``, ``decoded, lossless``.

    Rows go on in small batches, as soon as their texts are segmented.
    """
    at_id, at_text = _place(docs, id_col), _place(docs, text_col)
    kept = [c for i, c in enumerate(docs.columns) if not back or i != at_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, decoder = Matcher(vocab, sharpness), Decoder(vocab.table()) if back else None
        lattices = Lattices(matcher)
        for batch in batches:
            row = batch.column(0)
            ids, bodies = row.field(at_id), row.field(at_text)
            at = 0
            while at < batch.num_rows:
                texts, seeds, missing, held, start = [], [], [], 0, at
                while at < batch.num_rows and held < _STEP:
                    text = bodies[at].as_py()
                    missing.append(text is None)
                    texts.append(text or "")
                    seeds.append(row_seed(seed, ids[at].as_py(), texts[-1]))
                    held += len(texts[-1])
                    at += 1
                numbers, counts = segment(texts, seeds, matcher, lattices)
                ends = np.concatenate([[0], np.cumsum(counts)])
                lists = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(numbers.astype(np.int32)), mask=pa.array(missing)
                )
                own = row.slice(start, at - start)
                if not back:
                    yield pa.RecordBatch.from_arrays([own, lists], ["row", "pieces"])
                    continue
                read = [None if gone else text for text, gone in zip(decoder.texts(numbers, ends), missing)]
                same = [x is None or x == text for x, text in zip(read, texts)]
                fields = [own.field(i) for i in range(len(docs_columns)) if i != at_text]
                yield pa.RecordBatch.from_arrays(
                    [pa.StructArray.from_arrays(fields, names=kept), lists, pa.array(read, pa.string()), pa.array(same)],
                    ["row", "pieces", "decoded", "lossless"],
                )

    docs_columns = docs.columns
    packed = _packed(docs, docs_columns)
    row = _packed(docs, kept).schema["row"]
    added = [T.StructField("pieces", T.ArrayType(T.IntegerType()))]
    if back:
        added += [T.StructField("decoded", T.StringType()), T.StructField("lossless", T.BooleanType())]
    return packed.mapInArrow(run, T.StructType([row, *added]))


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    vocab: Vocabulary | None = None, seed: int = SEED, sharpness: float = SHARPNESS, into: str = "pieces",
) -> DataFrame:
    """The documents with ``pieces array<int>``: one sampled segmentation of each whole text.

    The draw depends on the seed and the row's id (its text, if the id is null) only, so
    reruns agree, and rows alike in id and text get the same pieces. Defined cases: a null
    text has null pieces, an empty one an empty list; a character without a piece, and a
    U+2581 in the text, are spelled in bytes. Other columns are carried; one that is
    called as the new one stays, so pass another name in ``into``.
    """
    rows = _segmented(docs, id_col, text_col, vocab or load(), seed, sharpness, False)
    return rows.select("row.*", F.col("pieces").alias(into))


def decode(encoded: DataFrame, pieces_col: str = "pieces", *, vocab: Vocabulary | None = None, into: str = "decoded") -> DataFrame:
    """The rows with the text that their pieces stand for; null pieces give a null text."""
    vocab, at = vocab or load(), _place(encoded, pieces_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocab.table()
        for batch in batches:
            lists = batch.column(0).field(at)
            texts = [decoded(x.values.to_pylist(), table) if x.is_valid else None for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    packed = _packed(encoded, encoded.columns)
    schema = T.StructType([packed.schema["row"], T.StructField("text", T.StringType())])
    return packed.mapInArrow(run, schema).select("row.*", F.col("text").alias(into))


def encode_and_decode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    vocab: Vocabulary | None = None, seed: int = SEED, sharpness: float = SHARPNESS,
) -> DataFrame:
    """The documents with ``pieces``, ``decoded`` and ``lossless`` in place of the text.

    As :func:`encode` and then :func:`decode`, in one pass: the text that the pieces stand
    for is compared with the given one.
    """
    rows = _segmented(docs, id_col, text_col, vocab or load(), seed, sharpness, True)
    return rows.select("row.*", "pieces", "decoded", "lossless")
