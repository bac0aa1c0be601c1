"""Deleting lines that a document shares with an earlier one, by aligning pairs of texts.

Texts that are equal as a whole form a class; its first document stands for it. Two classes
are aligned if they share a rare line (few classes hold it, so all pairs of its holders are
few), and a class is aligned with the first holder of each of its runs that would go by
itself: three lines, or fewer with many characters. So common lines form pairs as well, one
for each holder, and no pair of all holders. Lines without a word are left aside.

A pair is aligned by patience diff: lines that stand once in both are anchors, their
longest common order is kept, and matches spread from there; a stretch without anchors is
aligned by the nth occurrence of its lines. Aligned blocks of several lines or many
characters are deleted from the later text, however many texts hold them. What is left of
it is aligned again, so passages that were moved, or stand twice, go as well. Lines are
compared by 64-bit hashes of what is left after trimming white space.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Hashable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affectframe.llm.common import join_counted, stored
from affectframe.operators.joins import join_on_key

# All holders of a line are paired if so many different texts hold it at most. Only pairs
# are found by it: what is deleted does not depend on the number of holders.
RARE = 10
# A block is deleted if it has at least so many lines with a word.
LEAST_LINES = 3
# Or if its lines have at least so many characters; any passage of more than 50 words has.
LEAST_CHARS = 100

_BLANK = 0
_SPACES = " \t\n\x0b\x0c\r"


def line_hashes(text: Column) -> Column:
    """One number for each line; 0 for a line without a word."""
    def of(line: Column) -> Column:
        bare = F.btrim(line, F.lit(_SPACES))
        return F.when(bare == "", F.lit(_BLANK).cast("bigint")).otherwise(F.xxhash64(bare))

    return F.transform(F.split(text, "\n"), of)


def line_chars(text: Column) -> Column:
    """The number of characters of each line after trimming white space."""
    return F.transform(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(_SPACES))))


def _increasing(values: Sequence[int]) -> list[int]:
    """Places of a longest increasing run of different values, in order (patience sorting)."""
    piles, tops, back = [], [], []
    for place, value in enumerate(values):
        k = bisect_left(piles, value)
        back.append(tops[k - 1] if k else -1)
        if k == len(piles):
            piles.append(value)
            tops.append(place)
        else:
            piles[k], tops[k] = value, place
    found, at = [], tops[-1] if tops else -1
    while at >= 0:
        found.append(at)
        at = back[at]
    return found[::-1]


def _anchors(a: Sequence[Hashable], b: Sequence[Hashable], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Places of lines that stand once in both stretches, or else of the nth occurrence of equal lines, in common order."""
    in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    if any(n == 1 and in_b.get(h) == 1 for h, n in in_a.items()):
        where = {h: j for j, h in enumerate(b[b0:b1], b0) if in_b[h] == 1}
        pairs = [(i, where[h]) for i, h in enumerate(a[a0:a1], a0) if in_a[h] == 1 and h in where]
    else:
        seen: Counter = Counter()
        where = {}
        for j, h in enumerate(b[b0:b1], b0):
            if h in in_a:
                where[h, seen[h]] = j
                seen[h] += 1
        seen.clear()
        pairs = []
        for i, h in enumerate(a[a0:a1], a0):
            if h in in_b:
                if (h, seen[h]) in where:
                    pairs.append((i, where[h, seen[h]]))
                seen[h] += 1
    return [pairs[k] for k in _increasing([j for _, j in pairs])]


def patience(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Aligned places of two sequences of lines, in order."""
    pairs, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        anchors = _anchors(a, b, a0, a1, b0, b1)
        if anchors:
            # Each part starts at an anchor, which its first step aligns.
            starts = [(a0, b0), *anchors]
            todo += [(x[0], y[0], x[1], y[1]) for x, y in zip(starts, [*anchors, (a1, b1)]) if x != y]
    return sorted(pairs)


def _blocks(pairs: list[tuple[int, int]]) -> Iterator[range]:
    """Places of the later text in runs of pairs that follow each other on both sides."""
    start = 0
    for k in range(1, len(pairs) + 1):
        if k == len(pairs) or (pairs[k][0] - pairs[k - 1][0], pairs[k][1] - pairs[k - 1][1]) != (1, 1):
            yield range(pairs[start][1], pairs[k - 1][1] + 1)
            start = k


def _goes(block: Sequence[int], chars: Sequence[int], least: int) -> bool:
    return len(block) >= least or sum(chars[j] for j in block) >= LEAST_CHARS


def _shortest_runs(lines: Sequence[Hashable], chars: Sequence[int], least: int) -> Iterator[range]:
    """From each line on, the shortest run that would go by itself."""
    for start in range(len(lines)):
        for end in range(start + 1, min(start + least, len(lines)) + 1):
            if _goes(range(start, end), chars, least):
                yield range(start, end)
                break


def _one_shared_run(earlier: Sequence[Hashable], later: Sequence[Hashable], chars: Sequence[int], least: int) -> list[tuple[int, int]]:
    """The pairs of the first run of both that would go, where no common order has brought it together."""
    held: dict[tuple, int] = {}
    for size in range(1, least + 1):
        for i in range(len(earlier) - size + 1):
            held.setdefault(tuple(earlier[i:i + size]), i)
    for run in _shortest_runs(later, chars, least):
        i = held.get(tuple(later[j] for j in run))
        if i is not None:
            return [(i + n, j) for n, j in enumerate(run)]
    return []


def doomed_lines(earlier: Sequence[Hashable], later: Sequence[Hashable], chars: Sequence[int], least: int = LEAST_LINES) -> list[range]:
    """Blocks of the later text (lines with a word only) that alignment with the earlier one deletes."""
    rest, found = list(later), []
    common = set(earlier)
    while any(h in common for h in rest):
        blocks = [b for b in _blocks(patience(earlier, rest)) if _goes(b, chars, least)]
        if not blocks:
            blocks = list(_blocks(_one_shared_run(earlier, rest, chars, least)))
        if not blocks:
            break
        found += blocks
        for block in blocks:
            for j in block:
                rest[j] = ("gone", j)  # equal to no line
    return found


def _aligned(pairs: DataFrame, least: int) -> DataFrame:
    """``key, places``: what each pair deletes from the later text, and the lines without a word inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            later, places = [], []
            for key, before, lines, chars, at in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                blocks = doomed_lines(before, lines, chars, least)
                if blocks:
                    later.append(key)
                    places.append(sorted({k for b in blocks for k in range(at[b[0]], at[b[-1]] + 1)}))
            yield pa.RecordBatch.from_arrays([pa.array(later, pa.string()), pa.array(places, pa.list_(pa.int32()))], ["key", "places"])

    return pairs.select("later", "earlier_lines", "lines", "chars", "places").mapInArrow(run, "key string, places array<int>")


def _worded(classes: DataFrame) -> DataFrame:
    """``holder, key, w``: the lines with a word of each class, with place and characters."""
    numbered = F.transform(
        F.arrays_zip("lines", "chars"), lambda x, i: F.struct(i.alias("place"), x["lines"].alias("line"), x["chars"].alias("chars"))
    )
    order = F.struct(F.col("least").isNull().alias("missing"), "least", "key")
    return classes.select(order.alias("holder"), "key", F.filter(numbered, lambda x: x["line"] != _BLANK).alias("w"))


def _runs(worded: DataFrame, least_lines: int) -> DataFrame:
    """``holder, size, run, goes``: all lines, and the longer runs that would go by themselves."""
    names = [f"w{k}" for k in range(least_lines)]
    rows = worded.select("holder", *[F.slice("w", k + 1, F.greatest(F.size("w"), F.lit(1))).alias(f"w{k}") for k in range(least_lines)])
    rows = rows.select("holder", F.explode(F.arrays_zip(*names)).alias("r"))

    def run(size: int) -> Column:
        parts = [F.col(f"r.w{k}") for k in range(size)]
        chars = parts[0]["chars"]
        for part in parts[1:]:
            chars = chars + part["chars"]
        enough = F.lit(True) if size == least_lines else chars >= LEAST_CHARS
        # A line by itself is named in any case: it may be rare.
        named = parts[0].isNotNull() if size == 1 else parts[-1].isNotNull() & enough
        hashed = parts[0]["line"] if size == 1 else F.xxhash64(*[part["line"] for part in parts])
        return F.when(named, F.struct(F.lit(size).alias("size"), hashed.alias("run"), enough.alias("goes")))

    each = F.explode(F.array_compact(F.array(*[run(size) for size in range(1, least_lines + 1)]))).alias("x")
    return rows.select("holder", each).select("holder", "x.*")


def overlapping(worded: DataFrame, least_lines: int) -> DataFrame:
    """``earlier, later``: keys of classes to align."""
    held = stored(_runs(worded, least_lines).distinct(), "runs")
    owners = held.groupBy("size", "run").agg(F.count("*").alias("held_by"), F.min("holder").alias("owner"))
    rare = (F.col("size") == 1) & (F.col("held_by") <= RARE)
    owners = stored(owners.filter("held_by > 1"), "owners")
    shared = stored(join_counted(held, owners, ["size", "run"], "held_by", held.count()).filter(rare | F.col("goes")), "shared")
    with_first = shared.filter(F.col("goes") & (F.col("owner.key") != F.col("holder.key"))).select(
        F.col("owner.key").alias("earlier"), F.col("holder.key").alias("later")
    )
    # At most RARE holders meet in a group.
    holders = shared.filter(rare).groupBy("run").agg(F.sort_array(F.collect_list("holder")).alias("held"))
    places = F.posexplode(F.col("held")).alias("i", "first")
    among = holders.select("held", places).select(F.col("first.key").alias("earlier"), F.explode(F.slice("held", F.col("i") + 2, RARE)).alias("second"))
    return with_first.unionByName(among.select("earlier", F.col("second.key").alias("later"))).distinct()


def _doomed(classes: DataFrame, least_lines: int) -> DataFrame:
    """``key, doomed``: the places of the lines that each class loses."""
    worded = stored(_worded(classes), "worded")
    pairs = stored(overlapping(worded, least_lines), "pairs")
    lines = F.transform("w", lambda x: x["line"])
    earlier = worded.select(F.col("key").alias("earlier"), lines.alias("earlier_lines"))
    later = worded.select(
        F.col("key").alias("later"), lines.alias("lines"), F.transform("w", lambda x: x["chars"]).alias("chars"),
        F.transform("w", lambda x: x["place"]).alias("places"),
    )
    # One class may be the first holder in very many pairs; as the later one it is in few.
    both = join_on_key(pairs, earlier.join(pairs.select("earlier").distinct(), "earlier", "left_semi"), "earlier", "inner")
    return _aligned(both.join(later, "later"), least_lines).groupBy("key").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("doomed")
    )


def edits(
    docs: DataFrame, id_col: str, text_col: str, *, least_lines: int = LEAST_LINES
) -> DataFrame:
    """``key, least, n_rows, doomed``: for each text with copies or lines to delete.

    ``key`` is the text's MD5, ``least`` the id of its first document, ``doomed`` the
    places of the lines that the first document loses. Copies of it lose all lines.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", F.md5("text").alias("key"), line_hashes(F.col("text")).alias("lines"), line_chars(F.col("text")).alias("chars"))
    classes = stored(
        rows.groupBy("key").agg(
            F.min("id").alias("least"), F.count("*").alias("n_rows"), F.first("lines").alias("lines"), F.first("chars").alias("chars")
        ),
        "classes",
    )
    found = classes.select("key", "least", "n_rows").join(_doomed(classes, least_lines), "key", "left")
    found = found.filter((F.col("n_rows") > 1) | F.col("doomed").isNotNull())
    return stored(found.withColumn("doomed", F.coalesce("doomed", F.array().cast("array<int>"))), "edits")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``row`` (all columns), ``id``, ``kept_text``, ``n_lines`` and ``n_removed`` of each document.

    Later documents are those with the larger id. Defined cases: a null id counts as later
    than any other; rows alike in id and text are one document and lose the same lines; a
    null text stays null; a text without words loses nothing; lines without a word go only
    inside a deleted block; lines repeated within one document stay, unless an earlier one
    has them; a very long text is aligned as a whole, in time that grows with its lines and
    rounds; an empty table gives an empty one. The row is kept as one column, so columns of
    any name can be carried. Option: ``least_lines``.
    """
    found = edits(docs, id_col, text_col, **options)
    body = F.coalesce(F.col(text_col), F.lit(""))
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.md5(body).alias("key"),
    )
    joined = join_on_key(packed, found, "key", "left")
    lines = F.split("text", "\n")
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    kept_places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("doomed"))
    trimmed = F.array_join(F.transform(kept_places, lambda i: F.get(lines, i)), "\n")
    is_copy = F.col("key").isNotNull() & F.col("n_rows").isNotNull() & ~F.col("id").eqNullSafe(F.col("least"))
    has_word = F.btrim("text", F.lit(_SPACES)) != ""
    changed = has_word & (is_copy | (F.size("doomed") > 0))
    kept = F.when(changed, F.when(is_copy, F.lit("")).otherwise(trimmed)).otherwise(F.col("text"))
    removed = F.when(changed, F.when(is_copy, n_lines).otherwise(F.size("doomed"))).otherwise(0)
    return joined.select(
        "row", "id", kept.alias("kept_text"), n_lines.cast("bigint").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("bigint").alias("n_removed"),
    )
