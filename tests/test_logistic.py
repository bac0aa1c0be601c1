import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from affectframe.operators import bayes, logistic
from affectframe.queries.regression import lr_predict
from affectframe.queries.registry import documents

BITS = 6
POSTS = [
    ("good good day", "Happy"), ("bad day", "Anger"), ("good sun", "Happy"), ("bad bad night", "Anger"),
    ("night fear", "Fear"), ("day night fear fear", "Fear"), ("?!", "Fear"), ("", "Happy"),
] * 3 + [(f"sun day {i}", "Happy") for i in range(40)] + [(None, "Happy"), ("no label", None)]


def dense(rows, bits=BITS):
    """Features, label numbers and parts, worked out row by row."""
    labels = sorted({label for text, label in rows if text is not None and label is not None})
    x, y, held = [], [], []
    for text, label in rows:
        if text is None or label is None:
            continue
        words = [w for w in re.split(r"[^\w]+", text.lower()) if w]
        row = np.zeros((1 << bits) + 1)
        for w in words:
            row[int(hashlib.md5(w.encode()).hexdigest()[:5], 16) % (1 << bits)] += 1 / len(words)
        row[-1] = 1
        x.append(row)
        y.append(labels.index(label))
        held.append(hashlib.md5(text.encode()).hexdigest()[0] == "0")
    return np.array(x), np.array(y), np.array(held)


def loss(w, x, y):
    z = x @ w
    top = z.max(axis=1)
    return np.log(np.exp(z - top[:, None]).sum(axis=1)) + top - z[np.arange(len(y)), y]


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame([(i, *p, "x") for i, p in enumerate(POSTS)], "ID int, Text string, emotion string, idx string")


def test_gradient_against_differences_of_a_dense_loss(spark, posts, tmp_path):
    stored = logistic.features(posts, "Text", "emotion", ["Anger", "Fear", "Happy"], BITS)
    x, y, held = dense(POSTS)
    assert held.any() and not held.all()
    rng = np.random.default_rng(1)
    w = rng.normal(size=(x.shape[1], 3))
    g, shares, losses = logistic.gradient(stored.repartition(3), w, first=True)
    fitted, part = x[~held], y[~held]
    assert shares == pytest.approx(fitted.sum(axis=0), abs=1e-4)
    for i, j in [(i, j) for i in np.flatnonzero(fitted.any(axis=0)) for j in range(3)]:
        step = np.zeros_like(w)
        step[i, j] = 1e-5
        slope = (loss(w + step, fitted, part).sum() - loss(w - step, fitted, part).sum()) / 2e-5
        assert g[i, j] == pytest.approx(slope, abs=1e-4)
    for side, rows in ((logistic._LOSS, ~held), (logistic._HELD_LOSS, held)):
        assert losses[side] == (pytest.approx(loss(w, x[rows], y[rows]).sum(), abs=1e-4), rows.sum())


def test_rounds_lower_the_loss_and_do_not_depend_on_the_partitioning(spark, posts, tmp_path):
    one = logistic.train(posts.coalesce(1), "Text", "emotion", bits=BITS, rounds=20, patience=20, path=str(tmp_path / "a"))
    many = logistic.train(posts.repartition(7, "ID"), "Text", "emotion", bits=BITS, rounds=20, patience=20, path=str(tmp_path / "b"))
    assert one.labels == ("Anger", "Fear", "Happy") and one.losses == many.losses
    assert (one.dense() == many.dense()).all()
    assert one.losses[0][0] == pytest.approx(math.log(3), abs=1e-5) and one.losses[-1][0] < 0.5 * one.losses[0][0]
    assert (logistic.resumed(spark, str(tmp_path / f"a/round-{one.kept}"), 3) == one.dense()).all()


def test_the_fit_ends_when_the_held_back_loss_rises(spark, tmp_path):
    # What is held back contradicts the rest, so that each step makes it worse.
    texts = [f"word{i}" for i in range(400)]
    rows = [(t, "a" if logistic_side(t) else "b") for t in texts] + [("word0 x", "a"), ("word1 y", "b")]
    model = logistic.train(spark.createDataFrame(rows, "t string, l string"), "t", "l", rounds=30, patience=2, path=str(tmp_path / "m"))
    assert model.kept == 0 and len(model.losses) == 3
    assert model.losses[1][0] < model.losses[0][0] and model.losses[1][1] > model.losses[0][1]


def logistic_side(text):
    return hashlib.md5(text.encode()).hexdigest()[0] == "0"


def test_scores_of_odd_posts(spark, posts, tmp_path):
    model = logistic.train(posts, "Text", "emotion", bits=BITS, rounds=8, path=str(tmp_path / "m"))
    texts = ["good night", "unheard words", "Fear, FEAR! day bad", None, "  ", "?!", "day " * 200_000]
    new = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "ID int, Text string, scores string")
    got = {r.ID: r for r in logistic.predict(model, new, "Text", "ID").collect()}
    w = model.dense()
    for i, text in enumerate(texts):
        if text is None or not text.strip():
            assert got[i].scores == [] and got[i].pred is None
            continue
        x, _, _ = dense([(text, "Fear")])
        assert [s.score for s in got[i].scores] == pytest.approx((x @ w)[0].tolist(), abs=1e-9)
        assert sum(p.score for p in got[i].probabilities) == pytest.approx(1)


def test_nothing_to_fit(spark, tmp_path):
    empty = spark.createDataFrame([], "ID int, Text string, emotion string")
    model = logistic.train(empty, "Text", "emotion", path=str(tmp_path / "m"))
    assert model.labels == () and model.losses == () and model.weights.count() == 0
    with pytest.raises(ValueError):
        logistic.train(empty, "Text", "emotion", bits=21, path=str(tmp_path / "n"))


def test_as_accurate_as_bayes(spark):
    sf = "/root/testdata/sf0.01"
    posts = documents(spark, sf, "doc_id", "text", "lang")
    right = lambda rows: rows.filter(F.col("pred") == F.col("lang")).count()
    ours = lr_predict(spark, sf).join(posts, "doc_id")
    theirs = bayes.predict(bayes.train(posts, "text", "lang"), posts, "text", "doc_id", ["lang"])
    assert right(ours) >= right(theirs)
