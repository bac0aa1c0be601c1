import numpy as np
import pytest

from affectframe.operators import nearest
from affectframe.operators.nearest import Groups, nearest_prototypes


def brute(vectors, means):
    """Label and cosine of the best prototype of each vector, all tried."""
    good = sorted((label, np.array(p)) for label, p in means if p is not None and any(p))
    out = {}
    for i, v in vectors:
        if v is None or len(v) != 4 or not np.isfinite(v).all() or not any(v):
            out[i] = (None, None)
            continue
        scores = [float(np.dot(v, p) / np.linalg.norm(v) / np.linalg.norm(p)) for _, p in good]
        best = max(range(len(good)), key=lambda k: (round(scores[k], 9), -k))
        out[i] = (good[best][0], pytest.approx(scores[best], abs=1e-9))
    return out


@pytest.mark.parametrize("values", [1 << 21, 200])
def test_against_trying_all(spark, values):
    """Also with the prototypes in many blocks, equal ones, and vectors that cannot be compared."""
    rng = np.random.default_rng(1)
    means = [(k, rng.normal(size=4).tolist()) for k in range(300)]
    means += [(300 + k, means[k][1]) for k in range(50)] + [(500, [0.0] * 4), (501, None)]
    vectors = [(i, rng.normal(size=4).tolist()) for i in range(200)]
    vectors += [(900 + k, means[k][1]) for k in range(20)]
    vectors += [(1000, None), (1001, [0.0] * 4), (1002, [float("nan"), 1.0, 1.0, 1.0]), (1003, [1.0]), (1004, [])]
    got = nearest_prototypes(
        spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id int, v array<double>, label string").repartition(3), "vec_id", "v",
        spark.createDataFrame(means, "label int, prototype array<double>"), block_values=values,
    ).collect()
    assert {r.vec_id: (r.label, r.score) for r in got} == brute(vectors, means) and len(got) == len(vectors)


def test_no_prototypes_and_no_vectors(spark):
    none = spark.createDataFrame([], "label int, prototype array<double>")
    some = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id int, v array<double>")
    assert [tuple(r) for r in nearest_prototypes(some, "vec_id", "v", none).collect()] == [(1, None, None)]
    one = spark.createDataFrame([(7, [2.0, 0.0])], "label int, prototype array<double>")
    assert [tuple(r) for r in nearest_prototypes(some, "vec_id", "v", one).collect()] == [(1, 7, 1.0)]
    assert nearest_prototypes(some.limit(0), "vec_id", "v", one).collect() == []


def test_far_groups_are_skipped():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    unit = np.repeat(centres, 100, axis=0) + rng.normal(scale=0.02, size=(4000, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    x = unit[::40] + rng.normal(scale=0.001, size=(100, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    place, cosine = np.full(100, -1), np.full(100, -2.0)
    compared = Groups(np.arange(4000), unit).improve(x, place, cosine)
    assert (place == (x @ unit.T).argmax(axis=1)).all() and compared < 0.2 * 100 * 4000


def test_vectors_of_one_file_are_spread(spark, tmp_path, monkeypatch):
    """Every vector may have to meet every prototype: that is no work for the task that reads the file."""
    monkeypatch.setattr(nearest, "new_dir", lambda _spark, name: str(tmp_path / name))
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=4).tolist()) for i in range(400)]
    means = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(20)], "label int, prototype array<double>")
    frame = spark.createDataFrame(vectors, "vec_id int, v array<double>").coalesce(1)
    assert nearest_prototypes(frame, "vec_id", "v", means).count() == 400
    assert len(list((tmp_path / "nearest" / "pass-0").glob("part-*.parquet"))) >= spark.sparkContext.defaultParallelism


def test_products_in_single_precision_only_sort_out():
    """In all directions no group is skipped; what differs by less than a float tells is told apart in doubles."""
    rng = np.random.default_rng(4)
    unit = rng.normal(size=(5000, 32))
    unit[2500:] = unit[:2500] + rng.normal(scale=1e-5, size=(2500, 32))
    unit[100:200] = unit[4000:4100]
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    x = rng.normal(size=(200, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:100] = unit[::50]
    place, cosine = np.full(200, -1), np.full(200, -2.0)
    Groups(np.arange(5000), unit).improve(x, place, cosine)
    every = np.einsum("ij,kj->ik", x, unit)
    assert np.abs(cosine - every.max(axis=1)).max() < 1e-14
    assert (every[np.arange(200), place] >= every.max(axis=1) - 1e-14).all()
    twins = (x[:, None] == unit[None, 100:200]).all(axis=2)
    assert twins.any() and (place[twins.any(axis=1)] < 200).all()


def test_tiles_hold_many_groups():
    """Vectors and prototypes meet in few large products, not group by group."""
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(8000, 32))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    groups = Groups(np.arange(8000), unit)
    assert len(list(groups._tiles())) < len(groups.starts) / 5
