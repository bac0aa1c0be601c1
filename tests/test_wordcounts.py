import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from affectframe.operators import bayes, dedupe, logistic, wordcounts

TEXTS = ["a b a", None, "", "?!", "B, c. c c", "only once", "a b a", "İstanbul ıslak", "x " * 50]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def posts(spark, tmp_path):
    """Posts in a file of their own; some share an ID, some have none."""
    rows = [(i if i % 4 else None if i % 8 else 1, text, "u" if i % 3 else "v") for i, text in enumerate(TEXTS * 4)]
    spark.createDataFrame(rows, "ID int, Text string, emotion string").write.parquet(str(tmp_path / "posts.parquet"))
    return spark.read.parquet(str(tmp_path / "posts.parquet"))


def _words(text):
    return [w for w in re.split(r"[^\w]+", (text or "").replace("İ", "i̇").lower()) if w and w != "̇"]


def test_words_of_posts_are_counted_in_parts_and_not_moved(spark, monkeypatch):
    monkeypatch.setattr(wordcounts, "SLICE", 8)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if i != 7], "ID int, Text string")
    counted = wordcounts.words_of_posts(frame, "Text", ["ID"])
    assert "Exchange" not in _plan(counted)
    got = {(r.ID, r.token): r.tf for r in counted.collect()}
    assert got == {(i, w): n for i, t in enumerate(TEXTS) if i != 7 for w, n in Counter(_words(t)).items()}


def test_only_posts_that_share_an_id_meet_to_be_counted(spark, posts):
    """a word of a post is no row of a shuffle."""
    model = bayes.train(posts, "Text", "emotion")
    single = posts.filter("ID between 9 and 11")
    assert "hashpartitioning(ID" not in _plan(bayes._counts(single, "Text", ["ID"], 1 << 20))
    assert "hashpartitioning(ID#" not in _plan(bayes.explain(model, single, "Text", "ID").filter("token is not null"))
    rows = [(r.ID, w) for r in posts.collect() for w in bayes_words(r.Text)]
    for max_bytes in (1 << 20, 0):
        counts = bayes._counts(posts, "Text", ["ID"], max_bytes).collect()
        assert {(r.ID, r.token): r.tf for r in counts} == Counter(rows) and len(counts) == len(set(rows))


def bayes_words(text):
    """As Spark lower-cases: the dotted capital I becomes two characters, of which one is no word character."""
    return [w for w in re.split(r"[^\w]+", (text or "").lower().replace("̇", " ")) if w]


@pytest.mark.parametrize("limits", [{"max_bytes": 0, "head": 2}, {"max_bytes": 0, "head": 100_000}, {"max_bytes": 200, "head": 1}])
def test_a_large_model_gives_the_same_scores_from_texts_read_once(spark, posts, limits):
    """F6, F7."""
    model = bayes.train(posts.filter("Text not like '%only%'"), "Text", "emotion")
    new = posts.selectExpr("monotonically_increasing_id() as ID", "Text")
    new.write.parquet(path := bayes.new_dir(spark, "scored"))
    new = spark.read.parquet(path)
    small = {r.ID: r.scores for r in bayes.score(model, new, "Text", "ID").collect()}
    scored = bayes.score(model, new, "Text", "ID", **limits)
    assert _plan(scored).count("ReadSchema: struct<ID:bigint,Text:string>") == 1
    assert {r.ID: r.scores for r in scored.collect()} == small and len(small) == 36


def test_frequent_words_are_broadcast_as_far_as_there_is_room(spark):
    words = spark.createDataFrame([(f"w{i}", 1 << i, [0, 0]) for i in range(20)], "token string, n long, w array<bigint>")
    assert bayes._least_hot(words, 0, 100) == -(-(2**20 - 1) // 100)
    assert bayes._least_hot(words, 5 * 70, 1) == 1 << 16


def test_repeated_keys_are_counted_once(spark, posts):
    """keys may be hashes of texts."""
    once = dedupe.drop_repeated(posts.selectExpr("md5(Text) as _text", "Text"), "_text")
    assert _plan(once).count("ReadSchema: struct<Text:string>") == 2
    assert sorted(r.Text for r in once.collect() if r.Text is not None) == sorted({t for t in TEXTS if t is not None})


def test_hashed_words_in_parts(spark, posts, monkeypatch):
    """F5, F8: memory is bounded by the words of a part; each different word is hashed once."""
    spaced = pa.array(["a b a", None, "", " c ", "x " * 50])
    whole = [np.concatenate(x) for x in list(zip(*logistic._hashed(spaced, 8)))[2:]]
    monkeypatch.setattr(wordcounts, "SLICE", 6)
    parts = list(logistic._hashed(spaced, 8))
    assert len(parts) > 2 and parts[0][0] == 0 and parts[-1][1] == len(spaced)
    for mine, theirs in zip(whole, list(zip(*parts))[2:], strict=True):
        assert np.array_equal(mine, np.concatenate(theirs))
    assert _plan(logistic.features(posts, "Text", "emotion", ["u", "v"])).count("md5") == 1


def test_gradient_in_parts(spark, posts, monkeypatch):
    stored = logistic.features(posts, "Text", "emotion", ["u", "v"], 6)
    at = np.random.default_rng(1).normal(size=(65, 2))
    batches = list(stored.toArrow().to_batches())
    point = type("Point", (), {"value": at})
    whole = pa.Table.from_batches(logistic._sums(point, True)(iter(batches)))
    monkeypatch.setattr(logistic, "_ENTRIES", 3)
    assert sum(1 for _ in logistic._parts(iter(batches))) > 5
    assert pa.Table.from_batches(logistic._sums(point, True)(iter(batches))).equals(whole)


def test_a_word_moves_once_for_the_posts_of_a_slice(spark, monkeypatch):
    """no row of a shuffle for each word of each post."""
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if i != 7], "ID int, Text string").coalesce(1)
    for limit in (1 << 20, 8):
        monkeypatch.setattr(wordcounts, "SLICE", limit)
        held = wordcounts.posts_of_words(frame, "Text", ["ID"])
        assert "Exchange" not in _plan(held)
        rows = held.collect()
        got = {(i, r.token): n for r in rows for i, n in zip(r.ID, r.tf, strict=True)}
        assert got == {(i, w): n for i, t in enumerate(TEXTS) if i != 7 for w, n in Counter(_words(t)).items()}
        assert (len(rows) == len({r.token for r in rows})) == (limit > 8)


def test_scoring_with_a_large_model_groups_by_post_alone(spark, posts):
    """F2: a large model's scores need no hash table over the words of all posts of a task."""
    model = bayes.train(posts, "Text", "emotion")
    plan = _plan(bayes.score(model, posts.selectExpr("ID", "Text"), "Text", "ID", max_bytes=0, head=2))
    assert "hashpartitioning(token" in plan and not re.search(r"keys=\[ID#\d+, _blank#\d+, token", plan)
    assert "hashpartitioning(ID" in plan and not re.search(r"hashpartitioning\(ID#\d+, _blank#\d+, token", plan)
