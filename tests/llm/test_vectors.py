import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from affectframe.llm import balltree, gnat, vectors
from affectframe.llm.queries import QUERIES, SQL
from tests.compare import connect, differences

SCHEMA = "vec_id long, embedding array<float>, label int, row string, score int"


def rows_of(seed, n, dim=6):
    """Vectors in clusters, a third of them close copies of one, some equal; odd rows besides."""
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(5)]
    out = []
    for i in range(n):
        centre = centres[0] if i % 3 == 0 else rng.choice(centres)
        spread = 0 if i % 9 == 0 else 0.3
        out.append((i, [c + rng.uniform(-spread, spread) for c in centre], rng.randrange(4), "x", i))
    nan, inf = float("nan"), float("inf")
    return out + [
        (0, out[0][1], 1, "x", 1), (10, out[10][1], out[10][2], None, None), (20, out[20][1], None, "x", 1),
        (None, out[3][1], 2, "x", 1), (30, None, 1, "x", 1), (40, [], 1, "x", 1), (41, [], 2, "x", 1), (50, [1.0, 2.0], 1, None, 2),
        (60, [None] + [0.0] * 5, 1, "x", 1), (70, [nan] + [0.0] * 5, 1, "x", 1), (80, [inf] + [0.0] * 5, 2, "x", 1),
        (90, [1e30] + [0.0] * 5, 2, "x", 1), (100, [30000.0] * 6, 1, "x", 1), (110, [-30000.5] * 6, 2, "x", 1), (120, [0.0] * 6, 3, "x", 1),
    ]


def usable(rows, scale, labelled=False):
    out = []
    for number, (i, v, label, *_) in enumerate(rows):
        if v is None or any(x is None or not math.isfinite(x) for x in v) or labelled and label is None:
            continue
        whole = [math.floor(scale * float(np.float32(x))) for x in v]
        if sum(x * x for x in whole) < vectors.MAX_SQUARES:
            out.append((number, i, label, whole))
    return out


def scored(a, rows):
    """All other rows of the same length with their scores, best first."""
    found = [(sum(x * y for x, y in zip(a[3], r[3], strict=True)), r) for r in rows if r[0] != a[0] and len(r[3]) == len(a[3])]
    return sorted(found, key=lambda f: (-f[0], f[1][1] is None, f[1][1] or 0, f[1][0]))


def best_brute(rows, k, every):
    rows = usable(rows, 1024)
    return [
        (a[1], rank, r[1], score)
        for a in rows if a[1] is not None and a[1] % every == 0
        for rank, (score, r) in enumerate(scored(a, rows)[:k], 1)
    ]


def mined_brute(rows, every, positives=5, negatives=10):
    rows = usable(rows, 256, labelled=True)
    out = []
    for a in rows:
        if a[1] is None or a[1] % every:
            continue
        found = scored(a, rows)
        for p_score, p in [f for f in found if f[1][2] == a[2]][:positives]:
            window = [f for f in found if f[1][2] != a[2] and 30 * p_score <= 100 * f[0] <= 90 * p_score]
            out += [(a[1], p[1], rank, n[1], p_score, score) for rank, (score, n) in enumerate(window[:negatives], 1)]
    return out


def ordered(rows):
    return sorted([tuple(r) for r in rows], key=repr)


@pytest.mark.parametrize("values, balls", [(1 << 22, 64 << 20), (200, 64 << 20), (700, 0)])
def test_top_k_against_brute_force(spark, monkeypatch, values, balls):
    """Also with many shards, and where the shards' balls are too many for a task."""
    monkeypatch.setattr(vectors, "BALL_BYTES", balls)
    rows = rows_of(1, 400)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = balltree.top_k(df, F.col("vec_id") % 10 == 0, 7, shard_values=values).collect()
    assert ordered(got) == ordered(best_brute(rows, 7, 10))


@pytest.mark.parametrize("values, balls", [(1 << 22, 64 << 20), (300, 64 << 20), (700, 0)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, values, balls):
    monkeypatch.setattr(vectors, "BALL_BYTES", balls)
    rows = rows_of(2, 400)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = gnat.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label"), shard_values=values).collect()
    assert ordered(got) == ordered(mined_brute(rows, 10))


@pytest.mark.parametrize("name", ["op12_exact_top_k", "op13_hard_negatives"])
def test_queries_against_sql(spark, name):
    sf = "/root/testdata/sf0.1"
    assert differences(QUERIES[name](spark, sf), connect(sf), SQL[name]) == []


def test_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert balltree.top_k(df, F.col("vec_id") % 10 == 0).collect() == []
    assert gnat.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label")).collect() == []


def some(seed, n=900, dim=5):
    rng = np.random.default_rng(seed)
    v = np.concatenate([rng.integers(-300, 300, (n // 2, dim)), rng.integers(90, 110, (n - n // 2 - 60, dim)), np.full((60, dim), 100)])
    return rng.permutation(v)


def test_balls_hold_their_rows():
    v = some(1)
    order, tree = balltree.grow(v, leaf=10)
    assert sorted(order) == list(range(len(v)))
    for level in range(int(tree["depth"]) + 1):
        ends = len(v) * np.arange((1 << level) + 1) // (1 << level)
        for i, (start, end) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            apart = np.sqrt(((v[order[start:end]] - tree[f"centres{level}"][i]) ** 2).sum(1))
            assert apart.max() <= tree[f"radii{level}"][i] + 1e-6
    assert int(tree["depth"]) == 7


def test_ranges_hold_the_distances_to_siblings():
    v = some(2)
    order, tree = gnat.grow(v, leaf=10)
    assert sorted(order) == list(range(len(v)))
    first_point = np.concatenate([[0], np.cumsum(tree["children"][:, 1])])
    leaves = 0
    for node, (child, m) in enumerate(tree["children"]):
        if m == 0:
            leaves += tree["end"][node] - tree["start"][node]
        for i in range(m):
            point = tree["points"][first_point[node] + i]
            for j in range(m):
                own = v[order[tree["start"][child + j]:tree["end"][child + j]]]
                apart = np.sqrt(((own - point) ** 2).sum(1))
                at = tree["ranges"][node] + i * m + j
                assert tree["near"][at] - 1e-6 <= apart.min() and apart.max() <= tree["far"][at] + 1e-6
    assert leaves == len(v)


def offered(tree_module, v, q, lo, hi, k):
    """Rows found by a tree, and how many were looked at."""
    order, tree = tree_module.grow(v)
    n = len(v)
    shard = {"v": v[order], "row": order.astype(np.int64), "id": order.astype(np.int64), "label": np.zeros(n, np.int64),
             "no_id": np.zeros(n, bool)} | tree
    block = {"q": np.full(len(q), -1), "label": np.zeros(len(q), np.int64), "v": q, "lo": lo, "hi": hi}
    vectors.prepare(shard)
    vectors.prepare(block)
    best, looked = vectors.Best(shard, block, k, vectors.ANY), []
    offer = best.offer
    best.offer = lambda slots, scores, start: (looked.append(scores.size), offer(slots, scores, start))
    tree_module.search(shard, block, best)
    best.settle()
    slot, score, at = best.kept
    return [(int(s), int(x), int(order[a])) for s, x, a in zip(slot, score, at, strict=True)], sum(looked)


@pytest.mark.parametrize("module", [balltree, gnat])
def test_trees_leave_out_most_of_clustered_rows_and_lose_none(module):
    rng = np.random.default_rng(3)
    centres = rng.integers(-1000, 1000, (40, 8))
    v = centres[rng.integers(0, 40, 8000)] + rng.integers(-20, 20, (8000, 8))
    q = v[:30]
    lo, hi = np.full((30, 1), vectors.LOWEST), np.full((30, 1), vectors.HIGHEST)
    if module is gnat:
        hi = ((q * q).sum(1) * 9 // 10).reshape(-1, 1)
    got, looked = offered(module, v, q, lo, hi, 10)
    want = []
    for i in range(30):
        scores = v @ q[i]
        inside = np.flatnonzero(scores <= hi[i, 0])
        want += [(i, int(scores[j]), int(j)) for j in inside[np.lexsort((inside, -scores[inside]))][:10]]
    assert got == want
    assert looked < 0.5 * 30 * 8000
