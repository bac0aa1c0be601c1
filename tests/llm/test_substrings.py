import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from affectframe.llm import substrings
from affectframe.llm.suffixes import common_prefixes, suffix_array

from .conftest import prose


def brute(rows, span):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + span] for _, b in bodies for k in range(len(b) - span + 1))
    out = []
    for i, b in bodies:
        gone = np.zeros(len(b) + 2, np.int8)
        for k in range(len(b) - span + 1):
            if seen[b[k : k + span]] > 1:
                gone[k + 1 : k + 1 + span] = 1
        edges = np.flatnonzero(np.diff(gone)).tolist()
        kept = bytes(x for x, g in zip(b, gone[1:]) if not g)
        out.append((i, len(b), list(zip(edges[::2], edges[1::2])), kept))
    return sorted(out, key=repr)


def got(frame, **options):
    rows = substrings.without_repeats(frame, **options).collect()
    return sorted(((r.id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in rows), key=repr)


def test_messy_rows(messy, nothing):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    short = messy.filter("doc_id <> 8 AND doc_id <> 9 OR doc_id IS NULL")
    rows = [r for r in rows if r[0] not in (8, 9)]
    assert got(short) == brute(rows, 200)
    assert got(short, span=20) == brute(rows, 20)
    assert got(nothing) == []


@pytest.mark.parametrize("many_runs", [substrings.MANY_RUNS, 1])
def test_planted_passages(spark, many_runs):
    rng = random.Random(4)
    passage, long = prose(1, 60), prose(2, 300)
    texts = [f"{prose(10 + k, rng.randint(0, 40))} {passage} {prose(90 + k, 30)}" for k in range(12)]
    texts += [long, long, long[:700] + "X" + long[701:], long[300:499], long[300:500]]
    texts += ["ab" * 400, "a" * 3000, "é" * 150, prose(5, 50) * 3, passage * 2, "z" * 200, "q" * 201, " " * 199]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs, many_runs=many_runs) == brute(rows, 200)
    assert got(docs, many_runs=many_runs, span=50) == brute(rows, 50)


def test_texts_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(substrings, "_BLOCK", 700)
    rows = [(1, prose(1, 2000)), (2, prose(1, 2000)[5000:7000]), (3, "xyz" * 1500)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, 200)


def test_a_block_and_a_shard_take_little_memory():
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 123, 3_000, np.uint8).tobytes() for _ in range(400)]
    hashes = substrings.Hashes()
    strings = [rng.integers(97, 123, 300, np.uint8).tobytes() for _ in range(substrings._SHARD // 300)]

    def hashed():
        for lot in substrings.blocks(texts, 200):
            substrings.runs_of([part for _, _, part in lot], hashes)

    for work, most in ((hashed, 32), (lambda: substrings.repeated_strings(strings, 200), 64)):
        tracemalloc.start()
        try:
            work()
            assert tracemalloc.get_traced_memory()[1] < most << 20
        finally:
            tracemalloc.stop()


@pytest.mark.parametrize("seed", range(8))
def test_suffix_arrays_and_common_prefixes(seed):
    rng = random.Random(seed)
    for _ in range(60):
        letters = rng.choice([1, 2, 3, 26])
        b = bytes(rng.randrange(letters) + 97 for _ in range(rng.randint(1, 60)))
        b = rng.choice([b, b * 3, b + b"\xff" + b])
        t = np.frombuffer(b, np.uint8)
        order = suffix_array(t)
        expected = sorted(range(len(b)), key=lambda i: b[i:])
        assert order.tolist() == expected
        former, common = common_prefixes(t, order)
        for x, y in zip(expected, expected[1:]):
            n = 0
            while max(x, y) + n < len(b) and b[x + n] == b[y + n]:
                n += 1
            assert (former[y], common[y]) == (x, n)
