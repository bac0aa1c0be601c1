import math

import pytest
from pyspark.sql import functions as F

from affectframe.operators import bayes as B, evaluation as E
from affectframe.operators.topics import prototype_scores, prototypes
from affectframe.plans.explain import explain_examples
from affectframe.plans.label import add_emotions
from affectframe.plans.train import train_and_evaluate
from affectframe.queries import REGISTRY

POSTS = [
    (1, "good good day", "Happy"), (2, "bad day", "Anger"), (3, "good sun", "Happy"),
    (4, "bad bad night", "Anger"), (5, "night fear", "Fear"), (6, "day night fear fear", "Fear"),
]


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame(POSTS, "ID int, Text string, emotion string")


@pytest.fixture(scope="module")
def model(posts, tmp_path_factory):
    return B.train(posts, "Text", "emotion", path=str(tmp_path_factory.mktemp("m") / "model"))


def _expected(text):
    """Log scores by the textbook formula."""
    labels = ["Anger", "Fear", "Happy"]
    vocabulary = {w for _, t, _ in POSTS for w in t.split()}
    scores = []
    for label in labels:
        seen = [w for _, t, l in POSTS if l == label for w in t.split()]
        score = math.log(sum(l == label for _, _, l in POSTS) / len(POSTS))
        for word in text.split():
            if word in vocabulary:
                score += math.log((seen.count(word) + 1) / (len(seen) + len(vocabulary)))
        scores.append(score)
    return scores


@pytest.mark.parametrize("options", [{}, {"max_bytes": 0, "head": 3}, {"max_bytes": 0, "head": 10**9}])
def test_scores(spark, model, options):
    texts = ["good night", "unheard words", "Fear, FEAR! day bad", None, "  ", "?!"]
    new = spark.createDataFrame(list(enumerate(texts)), "ID int, Text string")
    got = {r.ID: r for r in B.predict(model, new, "Text", "ID", **options).collect()}
    assert len(got) == len(texts)
    for i, text in [(0, "good night"), (1, ""), (2, "fear fear day bad"), (5, "")]:
        assert [s.score for s in got[i].scores] == pytest.approx(_expected(text), abs=1e-8)
        assert [s.label for s in got[i].scores] == ["Anger", "Fear", "Happy"]
        assert sum(p.score for p in got[i].probabilities) == pytest.approx(1)
    assert got[3].scores == [] and got[3].pred is None and got[4].scores == []
    assert got[2].pred == "Fear"


def test_word_counts(model):
    rows = model.weights.collect()
    assert sum(r.n for r in rows) == sum(len(t.split()) for _, t, _ in POSTS)
    assert (model.labels, model.docs) == (("Anger", "Fear", "Happy"), (2, 2, 2))


def test_a_frequent_word_unknown_to_a_large_model(spark, model):
    new = spark.range(200).select(F.col("id").alias("ID"), F.lit("spam spam spam night").alias("Text"))
    scored = B.score(model, new, "Text", "ID", max_bytes=0, head=2)
    (only,) = scored.select("scores").distinct().collect()
    assert [s.score for s in only.scores] == pytest.approx(_expected("night"), abs=1e-8)


@pytest.mark.parametrize("options", [{}, {"max_bytes": 0, "head": 3}])
def test_contributions_add_up(spark, posts, model, options):
    rows = B.explain(model, posts, "Text", "ID", **options).collect()
    base = [r.base for r in B.base_values(model).orderBy("idx").collect()]
    for id_, text, _ in POSTS:
        mine = [r for r in rows if r.ID == id_]
        assert sorted(r.token for r in mine if r.token) == sorted(set(text.split()))
        assert sum(r.token is None for r in mine) == 1
        sums = [sum(r.phi[i] for r in mine) + base[i] for i in range(3)]
        scores = _expected(text)
        mean = sum(scores) / 3
        assert sums == pytest.approx([s - mean for s in scores], abs=1e-6)


def test_trigger_words(posts, model):
    top = B.trigger_words(model, posts, "Text", "emotion", 1)
    assert {(r.label, r.token) for r in top.collect()} == {("Happy", "good"), ("Anger", "bad"), ("Fear", "fear")}


def test_label_lists(spark, posts, model):
    blank = posts.unionByName(spark.createDataFrame([(9, None, None)], posts.schema))
    got = {r.ID: r for r in add_emotions(blank, model).collect()}
    assert got[1].predicted_emotions == ["Happy"] and len(got[1].top3_emotions) == 3
    assert got[9].predicted_emotions == [] and got[9].top3_emotions == []
    loose = {r.ID: r for r in add_emotions(posts, model, threshold=0.05).collect()}
    assert len(loose[6].predicted_emotions) == 2


def test_examples_in_label_order(posts, model):
    labelled = posts.withColumnRenamed("emotion", "predicted_emotions")
    rows = explain_examples(labelled, model, labels=["Happy", "Anger"], n=1).collect()
    assert [r.ID for r in rows if r.token is None] == [1, 2]
    assert {r.ordinal for r in rows} == {1}


def test_report(spark):
    pairs = [("a", "a", 5), ("a", "b", 1), ("b", "b", 2), ("b", "a", 2), ("c", "a", 1)]
    frame = spark.createDataFrame(pairs, "label string, pred string, count long")
    report = {r["class"]: r for r in E.classification_report(frame, digits=6).collect()}
    assert (report["a"].precision, report["a"].recall) == (0.625, pytest.approx(5 / 6, abs=1e-6))
    assert (report["c"].precision, report["c"].recall, report["c"].f1, report["c"].support) == (0, 0, 0, 1)
    assert report["accuracy"].f1 == pytest.approx(7 / 11, abs=1e-6) and report["accuracy"].precision is None
    assert report["macro avg"].recall == pytest.approx((5 / 6 + 0.5 + 0) / 3, abs=1e-6)
    assert report["weighted avg"].recall == pytest.approx(7 / 11, abs=1e-6)
    assert report["weighted avg"].support == 11
    scores = E.accuracy(frame).first()
    assert scores.accuracy == scores.micro_f1 == pytest.approx(7 / 11)
    matrix = {r.label: (r.a, r.b, r.c) for r in E.confusion_matrix(frame, ["a", "b", "c"]).collect()}
    assert matrix == {"a": (5, 1, 0), "b": (2, 2, 0), "c": (1, 0, 0)}


def test_prediction_outside_the_labels_counts_as_class(spark):
    frame = spark.createDataFrame([("a", "x", 1), ("a", "a", 1)], "label string, pred string, count long")
    report = {r["class"]: r for r in E.classification_report(frame).collect()}
    assert report["x"].support == 0 and report["x"].recall == 0
    assert E.accuracy(frame).first().accuracy == 0.5


def test_training_job(spark, tmp_path):
    rows = [(i, f"w{i % 3} common x{i}", "abc"[i % 3]) for i in range(300)] + [(300, " ", "a"), (301, None, "b")]
    frame = spark.createDataFrame(rows, "id int, text string, emotion string")
    result = train_and_evaluate(frame, path=str(tmp_path / "model"))
    assert result.accuracy.first().accuracy == 1.0
    assert result.report.filter("class = 'accuracy'").first().support == 45
    assert B.load(spark, str(tmp_path / "model")).labels == ("a", "b", "c")


def test_prototypes(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.2], 1), (3, [0.0, 2.0], 0), (4, [0.0, 1.0], None)]
    vectors = spark.createDataFrame(rows, "id int, v array<float>, label int")
    got = {r.id: r for r in prototype_scores(vectors, "v", prototypes(vectors, "label", "v")).collect()}
    assert [s.label for s in got[4].scores] == ["0", "1"]
    assert got[3].scores[0].score == pytest.approx(1.0)
    assert got[1].scores[1].score == pytest.approx(1 / math.hypot(1, 0.1), abs=1e-6)
    assert got[1].scores[0].score == pytest.approx(0.0)


def _predictions(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    return {r.doc_id: r for r in REGISTRY[name].run(spark, str(tmp_path)).collect()}


@pytest.mark.parametrize("name", ["nb_predict", "nb_predict_large_model"])
def test_documents_without_a_text_come_out_without_a_prediction(spark, tmp_path, name):
    """F1, F2: their score vectors are empty, which ended the query."""
    texts = ["guten tag", "good day", "buenos dias", "bonjour", None, "", " \n", "?!"]
    got = _predictions(spark, tmp_path, name, [(i, text, ("de", "en", "es", "fr")[i % 4]) for i, text in enumerate(texts)])
    assert sorted(got) == list(range(8))
    assert [got[i].pred for i in range(4)] == ["de", "en", "es", "fr"]
    # Seven posts are counted with their labels, the one without any text is not.
    assert (got[7].score_de, got[7].score_fr) == (round(math.log(1 / 7), 4), round(math.log(2 / 7), 4))
    for i in (4, 5, 6):
        assert set(got[i].asDict().values()) == {i, None}


@pytest.mark.parametrize("name", ["nb_predict", "nb_predict_large_model"])
def test_scores_come_by_the_names_of_the_labels(spark, tmp_path, name):
    """documents need not be in all languages, nor in these alone."""
    got = _predictions(spark, tmp_path, name, [(1, "good day", "en"), (2, "bonjour", "fr"), (3, "?!", "cs"), (4, "?!", "fr")])
    assert (got[3].score_en, got[3].score_fr) == (round(math.log(1 / 4), 4), round(math.log(1 / 2), 4))
    assert got[1].pred == "en" and got[1].score_de is None and got[1].score_es is None
