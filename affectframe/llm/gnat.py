"""Hard negatives by a multiway hyperplane tree with distance ranges (after GNAT).

A node of a shard's tree has some split points; each row belongs to the subtree of the
split point nearest to it, so hyperplanes part them. For each pair of split points the node
stores the range of distances from the one to the rows in the other's subtree. A request
knows its distances to the split points; with the ranges, the triangle inequality gives the
distances that it can have to a subtree's rows. A window of scores is an annulus around the
request, as ``|q - x|^2 = |q|^2 + |x|^2 - 2 q . x`` and the rows' lengths are bounded in each
subtree: subtrees whose distances miss the annulus are left out. Leaves are exact.

Positives are the best rows of an anchor's label, by the same search with an open window;
each positive's score then gives the window of its negatives. What holds for odd rows is
stated in :mod:`affectframe.llm.vectors`; rows without a label take no part either, an
anchor without positives has no rows, and a window whose upper end is lower than its lower
end (a positive with a negative score) holds nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affectframe.llm import vectors
from affectframe.llm.common import stored

LEAF, SPLITS, DEPTH = 128, 8, 40


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(1)[:, None] + (points * points).sum(1) - 2 * (x @ points.T)
    return np.sqrt(np.maximum(squares, 0.0))


def grow(v: np.ndarray, leaf: int = LEAF, splits: int = SPLITS, seed: int = 1) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """An order of the rows in which subtrees are runs, and the nodes.

    ``start, end``: the runs; ``least, most``: squared lengths in them; ``children``: first
    child and number of children; ``points``: split points of a node's children; ``near, far``:
    by node, the ranges of distances from split point i to the rows of child j, at ``ranges + i * m + j``.
    """
    x, rng = v.astype(np.float64), np.random.default_rng(seed)
    squares, order = (x * x).sum(1), np.arange(len(v))
    start, end, children, points, ranges, near, far = [0], [len(v)], [], [], [], [], []
    depths, node = [0], 0
    while node < len(start):
        own = order[start[node]:end[node]]
        chosen = own[rng.choice(len(own), min(splits, len(own)), replace=False)] if len(own) > leaf and depths[node] < DEPTH else []
        if len(chosen):
            apart = _distances(x[own], x[chosen])
            nearest = np.argmin(apart, axis=1)
            used = np.unique(nearest)
        if not len(chosen) or len(used) < 2:  # few rows, or rows that no hyperplane parts
            children.append((0, 0))
            ranges.append(0)
            node += 1
            continue
        apart, nearest = apart[:, used], np.searchsorted(used, nearest)
        by_child = np.argsort(nearest, kind="stable")
        order[start[node]:end[node]] = own[by_child]
        ends = start[node] + np.cumsum(np.bincount(nearest))
        children.append((len(start), len(used)))
        ranges.append(sum(map(len, near)))
        starts = np.concatenate([[start[node]], ends[:-1]])
        runs = starts - start[node]
        near.append(np.minimum.reduceat(apart[by_child], runs, axis=0).T.reshape(-1))
        far.append(np.maximum.reduceat(apart[by_child], runs, axis=0).T.reshape(-1))
        points.append(x[chosen[used]])
        start += starts.tolist()
        end += ends.tolist()
        depths += [depths[node] + 1] * len(used)
        node += 1
    runs = [squares[order[s:e]] for s, e in zip(start, end, strict=True)]
    flat = lambda parts, shape: np.concatenate(parts) if parts else np.zeros(shape)
    return order, {
        "start": np.array(start), "end": np.array(end), "children": np.array(children), "ranges": np.array(ranges),
        "least": np.array([r.min() for r in runs]), "most": np.array([r.max() for r in runs]),
        "points": flat(points, (0, v.shape[1])), "near": flat(near, 0), "far": flat(far, 0),
    }


def _open(shard: dict, node: int, least: np.ndarray, most: np.ndarray, own: np.ndarray, best: vectors.Best, squares: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """Of the slots, those whose annulus meets the distances ``least`` to ``most`` of a subtree."""
    lo, hi, q = best.lo[own], best.hi[own], own // best.width
    outer = squares[q] + shard["most"][node] - 2.0 * lo
    inner = squares[q] + shard["least"][node] - 2.0 * hi
    # Doubles are not exact: distances may be off by less than the slack.
    return (lo <= hi) & (np.maximum(least - slack[q], 0.0) ** 2 <= outer * (1 + 1e-12) + 1) & ((most + slack[q]) ** 2 >= inner * (1 - 1e-12) - 1)


def search(shard: dict, block: dict, best: vectors.Best) -> None:
    """Offer all rows that can be among the k best of any window."""
    squares = block["squares"]
    slack = 1e-7 * (np.sqrt(squares) + np.sqrt(shard["squares"].max())) + 1e-6
    slots = np.arange(len(best.lo))
    # Subtrees to visit, the most promising last: a node, its slots, and their distances to its rows.
    waiting = [(0, slots, np.zeros(len(slots)), np.full(len(slots), np.inf))]
    first_point = np.concatenate([[0], np.cumsum(shard["children"][:, 1])])
    while waiting:
        node, own, least, most = waiting.pop()
        own = own[_open(shard, node, least, most, own, best, squares, slack)]
        if not len(own):
            continue
        child, m = shard["children"][node]
        asking, slot_of = np.unique(own // best.width, return_inverse=True)
        if m == 0:
            start, end = int(shard["start"][node]), int(shard["end"][node])
            # Requests by rows in parts of bounded size, as a leaf may hold many equal rows.
            for at in range(start, end, 4 * LEAF):
                until = min(at + 4 * LEAF, end)
                best.offer(own, vectors.products(block, asking, shard, at, until)[slot_of], at)
            best.settle()
            continue
        p = first_point[node]
        apart = _distances(block["doubles"][asking], shard["points"][p:p + m])
        r = shard["ranges"][node]
        near, far = (shard[name][r:r + m * m].reshape(m, m) for name in ("near", "far"))
        # By request and child, over all split points: no nearer and no farther than this.
        nearest = np.maximum(apart[:, :, None] - far, near - apart[:, :, None]).max(axis=1)
        farthest = (apart[:, :, None] + far).min(axis=1)
        for j in np.argsort(-nearest.mean(axis=0), kind="stable"):
            waiting.append((child + j, own, nearest[slot_of, j], farthest[slot_of, j]))


def _floor(a: Column, b: int) -> Column:
    """Floor of a / b in whole numbers."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def hard_negatives(
    df: DataFrame, asks: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", *,
    scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    shard_values: int = vectors.SHARD_VALUES,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    For each anchor (a row that asks) and each of its best rows of the same label: the best
    rows of other labels that score between ``low`` and ``high`` percent of the positive.
    """
    rows = vectors.whole_numbers(df, id_col, vec_col, scale, asks, label)
    shards = vectors.sharded(rows, grow, shard_values=shard_values)
    asked = vectors.requests(shards)
    open_window = asked.withColumns({"lo": F.array(F.lit(vectors.LOWEST)), "hi": F.array(F.lit(vectors.HIGHEST))})
    found = vectors.answered(open_window, shards, search, positives, vectors.SAME)
    by_anchor = found.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "row", "score"))).alias("p"))

    # As many windows for each anchor; those beyond its positives are empty.
    def edge(score: Column, percent: int, up: bool) -> Column:
        return -_floor(-score * percent, 100) if up else _floor(score * percent, 100)

    places = F.sequence(F.lit(0), F.lit(positives - 1))
    score = lambda i: F.get("p", i)["score"]
    windows = asked.join(by_anchor, "q").withColumns({
        "lo": F.transform(places, lambda i: F.coalesce(edge(score(i), low, True), F.lit(vectors.HIGHEST))),
        "hi": F.transform(places, lambda i: F.coalesce(edge(score(i), high, False), F.lit(vectors.LOWEST))),
    })
    windows = stored(windows, "windows")
    mined = vectors.answered(windows.drop("p"), shards, search, negatives, vectors.OTHER)
    names = windows.select("q", F.col("id").alias("anchor_id"), F.posexplode("p").alias("w", "p"))
    return mined.join(names, ["q", "w"]).select(
        "anchor_id", F.col("p.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
