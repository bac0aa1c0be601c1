"""Exact top-k by inner product: ball trees, branch and bound.

Each shard's tree halves its rows along the line between two far rows, so a node is a run of
rows with a ball around their mean. No row of a node scores more than
``q . centre + |q| * radius``. Nodes that cannot reach the k-th score so far are cut;
the leaves left are visited in the order of their bounds, and the k-th score rises as they
are. That score starts from the one shared over all shards. What holds for odd rows is
stated in :mod:`affectframe.llm.vectors`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affectframe.llm import vectors

LEAF = 128


def grow(v: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """An order of the rows, and by level the ball of each node.

    Level l has 2^l nodes; node i holds rows ``n * i // 2^l`` up to ``n * (i + 1) // 2^l``.
    """
    n, depth = len(v), 0
    while n >> depth > leaf:
        depth += 1
    order, x = np.arange(n), v.astype(np.float64)
    tree = {"depth": np.array(depth)}
    for level in range(depth + 1):
        ends = n * np.arange((1 << level) + 1) // (1 << level)
        centres, radii = np.zeros((1 << level, v.shape[1])), np.zeros(1 << level)
        for i, (start, end) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            own = x[order[start:end]]
            centres[i] = own.mean(axis=0)
            apart = ((own - centres[i]) ** 2).sum(1)
            radii[i] = np.sqrt(apart.max())
            if level < depth:
                first = own[np.argmax(apart)]
                second = own[np.argmax(((own - first) ** 2).sum(1))]
                half = n * (2 * i + 1) // (2 << level) - start
                order[start:end] = order[start:end][np.argpartition(own @ (second - first), half)]
        tree[f"centres{level}"], tree[f"radii{level}"] = centres, radii
    return order, tree


def search(shard: dict, block: dict, best: vectors.Best) -> None:
    """Offer all rows that can be among the k best (of the one window of each request)."""
    n, depth = len(shard["row"]), int(shard["depth"])
    q = block["doubles"]
    lengths = np.sqrt(block["squares"])
    open_ = np.ones((len(q), 1), bool)
    for level in range(depth + 1):
        centres, radii = shard[f"centres{level}"], shard[f"radii{level}"]
        middle = q @ centres.T
        # Sums of doubles are not exact: the bound is raised by more than they can be off.
        slack = 1e-9 * lengths[:, None] * (np.sqrt((centres * centres).sum(1)) + radii) + 1e-6
        bound = middle + lengths[:, None] * radii + slack
        open_ = (open_ if level == 0 else np.repeat(open_, 2, axis=1)) & (bound >= best.lo[:, None]) & (best.lo <= best.hi)[:, None]
    ends = n * np.arange((1 << depth) + 1) // (1 << depth)
    bound[~open_] = -np.inf
    ranking, visited, step = np.argsort(-bound, axis=1, kind="stable"), 0, 1
    while visited < ranking.shape[1]:
        leaves = ranking[:, visited:visited + step]
        wanted = np.take_along_axis(bound, leaves, axis=1) >= best.lo[:, None]
        if not wanted.any():
            return  # bounds only get lower from here on
        asking, at = np.nonzero(wanted)
        leaf = leaves[asking, at]
        order = np.argsort(leaf, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
            start, end = ends[leaf[group[0]]], ends[leaf[group[0]] + 1]
            own = asking[group]
            best.offer(own, vectors.products(block, own, shard, start, end), start)
        best.settle()
        visited, step = visited + step, step * 2


def top_k(
    df: DataFrame, asks: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", *,
    scale: int = 1024, shard_values: int = vectors.SHARD_VALUES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows with the highest inner products for each row that asks.

    Components are ``floor(scale * x)``. A row does not find itself; ties go to the smaller id.
    """
    rows = vectors.whole_numbers(df, id_col, vec_col, scale, asks)
    shards = vectors.sharded(rows, grow, shard_values=shard_values)
    asked = vectors.requests(shards).withColumns({
        "lo": F.array(F.lit(vectors.LOWEST)), "hi": F.array(F.lit(vectors.HIGHEST))
    })
    found = vectors.answered(asked, shards, search, k)
    names = asked.select("q", F.col("id").alias("query_id"))
    return found.join(names, "q").select("query_id", "rank", F.col("id").alias("vec_id"), "score")
