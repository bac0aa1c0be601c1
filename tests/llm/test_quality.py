import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from affectframe.llm import discriminant, rules, textstats

from .conftest import prose, same_columns

SF = "/root/testdata/sf0.01"


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text("ab é日#|\n\t \x0b\x1c\x85 ", max_size=80))
def test_counts(text):
    assert textstats.base_counts(text.encode()) == brute_counts(text)


def test_messy_rows(messy, labels, nothing):
    rows = rules.quality_rules(messy, labels).collect()
    texts = {(r.doc_id, r.text) for r in messy.collect()}
    assert len(rows) == messy.count()
    assert sorted(
        (r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows if r.id is not None
    ) == sorted((r.doc_id, *brute_counts(r.text or "")) for r in messy.collect() if r.doc_id is not None)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed) and 0 <= r.probability <= 1
    assert texts
    out = rules.passing(messy, labels)
    same_columns(out, messy)
    assert out.count() == sum(r.kept for r in rows)
    assert rules.quality_rules(nothing, labels).collect() == []
    scores = discriminant.quality_scores(messy, labels).collect()
    assert len(scores) == messy.count() and all(0 <= r.score <= 1 for r in scores)
    assert discriminant.quality_scores(nothing, labels).collect() == []


def test_tasks_get_each_text_once(messy, labels):
    out = rules.passing(messy, labels)
    assert re.search(r"MapInArrow judge\(row#\d+\)", out._jdf.queryExecution().executedPlan().toString())
    other = rules.passing(messy, labels, "DOC_ID", "TEXT")
    same_columns(other, messy)
    rows = out.collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, other.collect()))
    kept = [r.id for r in rules.quality_rules(messy, labels).collect() if r.kept]
    assert sorted(map(repr, kept)) == sorted(repr(r.doc_id) for r in rows)


def test_without_labels(messy, labels):
    none = labels.limit(0)
    assert {r.score for r in discriminant.quality_scores(messy, none).collect()} == {0.5}
    assert len({r.probability for r in rules.quality_rules(messy, none).collect()}) == 1


def test_labels_of_held_out_rows_do_not_count(messy, labels):
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(discriminant.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, discriminant.quality_scores(messy, x).collect()), key=repr) for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("method", ["discriminant", "rules"])
def test_held_out_accuracy(spark, method):
    docs, known = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    if method == "discriminant":
        rows = discriminant.quality_scores(docs, known).filter("held_out").select("id", "score")
    else:
        from pyspark.sql import functions as F

        rows = rules.quality_rules(docs, known, learn=lambda i: ~discriminant.held_out(i))
        rows = rows.filter(discriminant.held_out(F.col("id"))).select("id", "probability")
    label = {r.doc_id: r.quality for r in known.collect()}
    pairs = [(s, label[i]) for i, s in map(tuple, rows.collect()) if i in label]
    good, bad = ([s for s, y in pairs if y == k] for k in (1, 0))
    better = np.mean([[g > b for b in bad] for g in good])
    assert len(bad) > 5 and better > 0.9


def test_calibrated_probabilities_follow_the_shares():
    texts, marks = [], []
    draw = random.Random(1)
    for n in range(400):
        noisy = draw.random() < 0.3
        texts.append((prose(n, 60) + (" ##" if n % 4 == 0 or noisy else "")).encode())
        marks.append(int(not noisy))
    model = rules.train_model(texts, marks)
    mean = np.mean([model.probability(t) for t in texts])
    assert abs(mean - np.mean(marks)) < 0.1


def test_discriminant_is_that_of_the_formula(spark):
    rng = np.random.default_rng(5)
    d = len(discriminant.STATISTICS)
    x = np.vstack([rng.normal(0, 1, (300, d)), rng.normal(0.5, 2, (200, d))])
    grid, y = np.rint(x * discriminant.GRID).astype(int), [0] * 300 + [1] * 200
    frame = spark.createDataFrame([(int(k), *map(int, r)) for k, r in zip(y, grid)], ["label", *discriminant.STATISTICS])
    model = discriminant.fit(frame, towards_pooled=0, towards_diagonal=0, temperature=1)
    x = grid / discriminant.GRID
    logs = []
    for k, n in ((0, 300), (1, 200)):
        part = x[np.array(y) == k]
        c = np.cov(part.T, bias=True)
        z = x - part.mean(0)
        logs.append(np.log((n + 1) / 502) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z))
    assert model.scores(x) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])), abs=1e-6)
