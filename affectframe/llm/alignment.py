"""Alignment of two tokenizers' tokens over the bytes of the same text.

Tokens of A and B are rows of two incidence matrices whose columns are bytes. Row products
``A * B^T`` by Gustavson's rule hold how many bytes two tokens have in common: an entry is
an overlap link. Bytes where tokens of both end cut a text into groups; the product of the
two group incidences holds the pairs that share a group.

Both tokenizers cut before a space that follows a character other than white space, and no
token of either goes on beyond such a place. So the matrices are built for the different
stretches between these places, and what they give is remembered within a task.

Defined cases: a null or empty text, and one that the tokens of A or B do not spell (a text
with U+2581, which B takes for a space), has no tokens: zeros, no links. Equal rows and
shared or null ids are a document each. A long text is taken a million characters at a
time, so memory follows the different stretches and links of a text, not its length squared.
An empty table gives an empty one. Only the id and the text of a table are looked at, so
other columns may have any name.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affectframe.llm.common import join_counted, stored

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"

# Stretches that a task remembers, their characters, and characters of texts taken at once.
_REMEMBERED, _REMEMBERED_CHARS, _AT_ONCE = 400_000, 4_000_000, 1_000_000
# A link entry holds a pair of ids and, in its low bits, how often a document has it.
_PAIR_BITS, _COUNT_BITS = 39, 24

_CUT = re.compile(rf"(?<=[^\s{SPACE}])(?= .)", re.S)
_IRREGULAR = re.compile(rf"[\s{SPACE}] | \Z")


@dataclass(frozen=True)
class Csr:
    """A sparse matrix by rows: row i has columns ``indices[indptr[i]:indptr[i + 1]]`` with ``data``."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    n_columns: int

    def row_of_entry(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))


def incidence(lengths: np.ndarray) -> Csr:
    """Tokens by bytes: token i covers the ``lengths[i]`` bytes after those of the tokens before it."""
    indptr = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    n = int(indptr[-1])
    return Csr(indptr, np.arange(n), np.ones(n, np.int64), n)


def membership(group_of: np.ndarray, n_groups: int) -> Csr:
    """Tokens by groups: each token is in one."""
    n = len(group_of)
    return Csr(np.arange(n + 1), np.asarray(group_of, np.int64), np.ones(n, np.int64), n_groups)


def transposed(m: Csr) -> Csr:
    """Columns become rows; a column's rows stay in order."""
    order = np.argsort(m.indices, kind="stable")
    counts = np.bincount(m.indices, minlength=m.n_columns)
    indptr = np.concatenate([[0], np.cumsum(counts)])
    return Csr(indptr, m.row_of_entry()[order], m.data[order], len(m.indptr) - 1)


def row_product(left: Csr, right: Csr) -> Csr:
    """``left * right``, each row the sum of the right rows that its entries name (Gustavson)."""
    sizes = np.diff(right.indptr)[left.indices]
    rows = np.repeat(left.row_of_entry(), sizes)
    # Entry e of the left names right entries indptr[k] .. indptr[k] + sizes[e].
    first = np.repeat(right.indptr[left.indices] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    at = first + np.arange(len(rows))
    columns, values = right.indices[at], np.repeat(left.data, sizes) * right.data[at]
    key = rows * right.n_columns + columns
    order = np.argsort(key, kind="stable")
    key, values = key[order], values[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    summed = np.add.reduceat(values, starts) if len(key) else values
    key = key[starts]
    indptr = np.searchsorted(key, np.arange(len(left.indptr)) * max(right.n_columns, 1))
    return Csr(indptr, key % max(right.n_columns, 1), summed, right.n_columns)


def product_sizes(left: Csr, right: Csr) -> np.ndarray:
    """Entries that each row of the product gathers before equal columns are added up."""
    per_entry = np.diff(right.indptr)[left.indices]
    return np.add.reduceat(np.append(per_entry, 0), left.indptr[:-1]) * (np.diff(left.indptr) > 0)


@dataclass(frozen=True)
class Tokenizers:
    """The two files' contents; sent with the tasks, which build the tokenizers from them."""

    a: str
    b: bytes

    @staticmethod
    def load(a: str = TOKENIZER_A, b: str = TOKENIZER_B) -> Tokenizers:
        return Tokenizers(Path(a).read_text(encoding="utf-8"), Path(b).read_bytes())


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Tokens, groups and links of stretches of text, all new ones of a batch at once."""

    def __init__(self, files: Tokenizers):
        import sentencepiece
        from tokenizers import Tokenizer

        # A task has one core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(files.a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        alphabet = _byte_alphabet()
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [
            bytes(alphabet[c] for c in names[i]) if set(names.get(i, "\0")) <= alphabet.keys() else b""
            for i in range(max(names) + 1)
        ]
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))
        ]
        self.n_b = len(self.b_bytes)
        if len(self.a_bytes) * self.n_b >= 1 << _PAIR_BITS:
            raise ValueError("the vocabularies are too large for pairs of ids in a link entry")
        if any(SPACE in self.b.id_to_piece(i).lstrip(SPACE) for i in range(self.n_b)):
            raise ValueError("a piece of B goes on beyond a word")
        self.a_lengths = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_lengths = np.array(list(map(len, self.b_bytes)), np.int64)

    def encoded(self, stretches: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B for stretches without the space that stands before each."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + s for s in stretches], add_special_tokens=False)]
        return a, self.b.encode(stretches, num_threads=1)

    def _spelled(self, bodies: list[bytes], lists: list[list[int]], names: list[bytes]) -> np.ndarray:
        """Which of the bodies the tokens spell."""
        ids = [i for own in lists for i in own]
        if b"".join(map(names.__getitem__, ids)) == b"".join(bodies):
            lengths = np.array(list(map(len, names)), np.int64)[np.array(ids, np.int64)]
            ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([len(own) for own in lists], dtype=np.int64)]
            if np.array_equal(ends, np.cumsum([len(x) for x in bodies])):
                return np.ones(len(bodies), bool)
        return np.array([b"".join(map(names.__getitem__, own)) == x for x, own in zip(bodies, lists, strict=True)], bool)

    def align(self, stretches: list[str]) -> Aligned:
        """What each stretch gives; nothing for one that the tokens do not spell."""
        a_lists, b_lists = self.encoded(stretches) if stretches else ([], [])
        bodies = [(" " + s).encode() for s in stretches]
        valid = self._spelled(bodies, a_lists, self.a_bytes) & self._spelled(bodies, b_lists, self.b_bytes)
        if not valid.all():
            a_lists = [own if ok else [] for own, ok in zip(a_lists, valid, strict=True)]
            b_lists = [own if ok else [] for own, ok in zip(b_lists, valid, strict=True)]
        a = np.array([i for own in a_lists for i in own], np.int64)
        b = np.array([i for own in b_lists for i in own], np.int64)
        a_at, b_at = (np.concatenate([[0], np.cumsum([len(own) for own in x], dtype=np.int64)]) for x in (a_lists, b_lists))
        by_bytes_a, by_bytes_b = incidence(self.a_lengths[a]), incidence(self.b_lengths[b])
        overlaps = row_product(by_bytes_a, transposed(by_bytes_b))
        # Ends are byte offsets in all stretches together; each stretch ends a token of both.
        a_ends, b_ends = by_bytes_a.indptr[1:], by_bytes_b.indptr[1:]
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        shared = product_sizes(membership(a_group, len(cuts)), transposed(membership(b_group, len(cuts))))
        link_at = overlaps.indptr[a_at]
        group_at = np.concatenate([[0], a_group + 1])[a_at]
        shared_at = np.concatenate([[0], np.cumsum(shared)])[a_at]
        counts = np.stack([np.diff(x) for x in (a_at, b_at, group_at, link_at, shared_at)], axis=1)
        pairs = a[overlaps.row_of_entry()] * self.n_b + b[overlaps.indices]
        return Aligned(valid, counts.astype(np.int64), _written(a, a_group, b, b_group, a_at + b_at), link_at, pairs)


@dataclass
class Aligned:
    """By stretch: whether it is spelled; tokens of A, of B, groups, overlap links, group links; its groups
    as written; and the pairs of ids of its overlap links, from ``link_at[n]`` on."""

    valid: np.ndarray
    counts: np.ndarray
    groups: list[str]
    link_at: np.ndarray
    pairs: np.ndarray

    def extended(self, more: Aligned) -> Aligned:
        return Aligned(
            np.concatenate([self.valid, more.valid]), np.concatenate([self.counts, more.counts]),
            self.groups + more.groups, np.concatenate([self.link_at, more.link_at[1:] + self.link_at[-1]]),
            np.concatenate([self.pairs, more.pairs]),
        )

    def pairs_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the named stretches one after the other, and how many each has."""
        sizes = self.counts[numbers, 3]
        first = np.repeat(self.link_at[numbers] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        return self.pairs[first + np.arange(len(first))], sizes


def _written(a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray, at: np.ndarray) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each stretch, whose tokens of both end at ``at[n + 1]``."""
    group, ids = np.concatenate([a_group, b_group]), np.concatenate([a, b])
    side = np.repeat([0, 1], [len(a), len(b)])
    order = np.lexsort((side, group))
    group, side, ids = group[order], side[order], ids[order]
    following = np.append(group[1:] * 2 + side[1:], -1)
    ends = np.where(following == group * 2 + side, 0, side + 1).tolist()
    items = [f"{i}{mark}" for i, mark in zip(ids.tolist(), map(",|;".__getitem__, ends), strict=True)]
    at = at.tolist()
    return ["".join(items[i:j])[:-1] for i, j in zip(at[:-1], at[1:], strict=True)]


def stretches(text: str) -> list[str]:
    """The text between the places that both tokenizers cut at, without the space before each."""
    if _IRREGULAR.search(text) is None and text[:1] != " ":
        return text.split(" ")
    return [s[1:] for s in _CUT.split(" " + text)]


def _parts(text: str) -> Iterator[str]:
    """A text cut into parts of about ``_AT_ONCE`` characters, at places both tokenizers cut at."""
    start = 0
    while (found := len(text) - start > _AT_ONCE and _CUT.search(text, start + _AT_ONCE)):
        yield text[start:found.start()]
        start = found.start() + 1
    yield text[start:]


def _blocks(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """Parts of texts with the number of their text, as many as make up a block."""
    block, size = [], 0
    for number, text in enumerate(texts):
        for part in _parts(text) if text else ():
            if block and size + len(part) > _AT_ONCE:
                yield block
                block, size = [], 0
            block.append((number, part))
            size += len(part)
    if block:
        yield block


class _Remembered:
    """The stretches that a task has aligned, until they are too many."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.found = self.aligner.align([])
        self.size = 0

    def look_up(self, parts: list[list[str]]) -> np.ndarray:
        """The number of each stretch of the parts, one after the other."""
        if len(self.numbers) > _REMEMBERED or self.size > _REMEMBERED_CHARS:
            self.forget()
        numbers = self.numbers
        fresh = list(dict.fromkeys(s for own in parts for s in own if s not in numbers))
        if fresh:
            numbers.update(zip(fresh, range(len(numbers), len(numbers) + len(fresh)), strict=True))
            self.size += sum(map(len, fresh))
            self.found = self.found.extended(self.aligner.align(fresh))
        return np.array([numbers[s] for own in parts for s in own], np.int64)


class _Batch:
    """Counts, hashes and link entries of a batch of documents, gathered block by block."""

    def __init__(self, n: int):
        self.counts = np.zeros((n, 5), np.int64)
        self.valid = np.ones(n, bool)
        self.hashes = [None] * n
        self.documents, self.entries = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(self, block: list[tuple[int, str]], known: _Remembered) -> None:
        parts = [stretches(part) for _, part in block]
        numbers = known.look_up(parts)
        found, sizes = known.found, [len(own) for own in parts]
        document = np.repeat([number for number, _ in block], sizes)
        np.logical_and.at(self.valid, document, found.valid[numbers])
        np.add.at(self.counts, document, found.counts[numbers])
        written, at = list(map(found.groups.__getitem__, numbers.tolist())), 0
        for (number, _), size in zip(block, sizes, strict=True):
            if self.hashes[number] is None:
                self.hashes[number] = hashlib.sha256()
            else:
                self.hashes[number].update(b";")
            self.hashes[number].update(";".join(written[at:at + size]).encode())
            at += size
        pair, links = found.pairs_of(numbers)
        order = np.argsort(np.repeat(document - document[0], links) << _PAIR_BITS | pair, kind="stable")
        owner, pair = np.repeat(document, links)[order], pair[order]
        starts = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])])[:len(pair)])
        times = np.diff(np.append(starts, len(pair)))
        # A block has far fewer than 2^24 links, so a count fits its bits.
        self.documents.append(owner[starts])
        self.entries.append((pair[starts] << _COUNT_BITS) | times)

    def columns(self) -> list[pa.Array]:
        self.counts[~self.valid] = 0
        documents, entries = np.concatenate(self.documents), np.concatenate(self.entries)
        kept = self.valid[documents]
        offsets = np.searchsorted(documents[kept], np.arange(len(self.valid) + 1)).astype(np.int32)
        hashes = [h.hexdigest() if h and ok else "" for h, ok in zip(self.hashes, self.valid, strict=True)]
        counts = [pa.array(self.counts[:, i]) for i in range(5)]
        return [*counts, pa.array(hashes, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(entries[kept]))]


def _digests(files: Tokenizers):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Remembered(Aligner(files))
        for batch in batches:
            gathered = _Batch(batch.num_rows)
            for block in _blocks(batch.column(2).to_pylist()):
                gathered.add(block, known)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *gathered.columns()],
                ["row", "id", "n_a", "n_b", "n_groups", "n_links", "n_group_links", "groups_sha256", "links"],
            )

    return run


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, files: Tokenizers | None = None) -> DataFrame:
    """Counts of tokens, groups and links of each document, its groups' hash, and its link entries.

    ``links`` lists pairs of ids with how often the document has them, packed into a number
    each; :func:`exploded` unpacks them. ``row`` tells documents with the same id apart.
    """
    files = files or Tokenizers.load()
    narrow = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")
    )
    counts = [T.StructField(name, T.LongType()) for name in ("n_a", "n_b", "n_groups", "n_links", "n_group_links")]
    schema = T.StructType([
        T.StructField("row", T.LongType()), narrow.schema["id"], *counts,
        T.StructField("groups_sha256", T.StringType()), T.StructField("links", T.ArrayType(T.LongType())),
    ])
    return narrow.mapInArrow(_digests(files), schema)


def exploded(digested: DataFrame) -> DataFrame:
    """``row, pair, n``: how often each document links each pair of ids (within a part of it)."""
    return digested.select("row", F.explode("links").alias("link")).select(
        "row", F.shiftright("link", _COUNT_BITS).alias("pair"),
        F.col("link").bitwiseAND((1 << _COUNT_BITS) - 1).alias("n"),
    )


def pair_counts(links: DataFrame, n_b: int) -> DataFrame:
    """``pair, total, best``: links of each pair of ids corpus-wide, and whether no pair of its B id has more.

    The pairs of a B id are at most as many as A has ids.
    """
    from pyspark.sql import Window

    counted = links.groupBy("pair").agg(F.sum("n").alias("total"))
    most = F.max("total").over(Window.partitionBy(F.col("pair") % n_b))
    return counted.withColumn("best", F.col("total") == most)


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, files: Tokenizers | None = None) -> DataFrame:
    """One row per document: tokens, groups and links, and what the corpus-wide counts say of its links.

    ``n_best`` are the links whose pair is the most frequent of its B id, ties included;
    ``count_sum`` adds up the pair's count over the links. The counts are broadcast if
    they were measured to be small, or else joined beside the frequent pairs; each link
    entry of a document is added up where it is before anything is shuffled.
    """
    import sentencepiece

    files = files or Tokenizers.load()
    n_b = sentencepiece.SentencePieceProcessor(model_proto=files.b).get_piece_size()
    digested = stored(digests(docs, id_col, text_col, files=files), "alignment")
    links = exploded(digested)
    counts = stored(pair_counts(links, n_b), "pair-counts")
    total = digested.agg(F.sum("n_links")).first()[0] or 0
    sums = join_counted(links, counts, "pair", "total", total).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(F.lit(0))).alias("n_best"),
        F.sum(F.col("n") * F.col("total")).alias("count_sum"),
    )
    zero = F.lit(0).cast("bigint")
    return digested.drop("links").join(sums, "row", "left").select(
        "id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256", "n_group_links",
    )


LINKS = T.StructType([
    T.StructField(name, T.LongType())
    for name in ("a_index", "b_index", "a_token", "b_token", "a_start", "a_end", "b_start", "b_end", "overlap")
])


def links(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shared_group: bool = False,
    files: Tokenizers | None = None,
) -> DataFrame:
    """The links themselves, one row each: token numbers and ids, byte ranges, bytes in common.

    With ``shared_group`` all pairs of tokens in one group, overlapping or not. Byte 0 is the
    space before the text. Rows follow from a text part by part, so a long text's links are
    never held together.
    """
    files = files or Tokenizers.load()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([narrow.schema["id"], *LINKS.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(files)
        for batch in batches:
            for number, text in enumerate(batch.column(1).to_pylist()):
                if not text or not all(aligner.align(_distinct(part)).valid.all() for part in _parts(text)):
                    continue
                at = (0, 0, 0)
                for part in _parts(text):
                    columns, at = _linked(aligner, part, at, shared_group)
                    ids = pa.array([batch.column(0)[number].as_py()] * len(columns[0]), batch.schema.field(0).type)
                    yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], schema.names)

    return narrow.mapInArrow(run, schema)


def _distinct(part: str) -> list[str]:
    return list(dict.fromkeys(stretches(part)))


def _linked(aligner: Aligner, part: str, at: tuple[int, int, int], shared_group: bool):
    """Columns of a part's links, and the tokens and bytes up to its end."""
    a_lists, b_lists = aligner.encoded(stretches(part))
    a = np.array([i for ids in a_lists for i in ids], np.int64)
    b = np.array([i for ids in b_lists for i in ids], np.int64)
    in_a, in_b = incidence(aligner.a_lengths[a]), incidence(aligner.b_lengths[b])
    if shared_group:
        cuts = np.intersect1d(in_a.indptr[1:], in_b.indptr[1:])
        found = row_product(
            membership(np.searchsorted(cuts, in_a.indptr[1:]), len(cuts)),
            transposed(membership(np.searchsorted(cuts, in_b.indptr[1:]), len(cuts))),
        )
    else:
        found = row_product(in_a, transposed(in_b))
    i, j = found.row_of_entry(), found.indices
    a_start, a_end, b_start, b_end = in_a.indptr[i], in_a.indptr[i + 1], in_b.indptr[j], in_b.indptr[j + 1]
    overlap = np.maximum(np.minimum(a_end, b_end) - np.maximum(a_start, b_start), 0)
    columns = [i + at[0], j + at[1], a[i], b[j], *(x + at[2] for x in (a_start, a_end, b_start, b_end)), overlap]
    return columns, (at[0] + len(a), at[1] + len(b), at[2] + int(in_a.indptr[-1]))
