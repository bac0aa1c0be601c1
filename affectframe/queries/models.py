"""Label index, split, classifier, decoding, evaluation and explanation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affectframe.functions.scores import best, decode_labels as decode, score_of, softmax, top_labels
from affectframe.operators.bayes import BayesModel, base_values, explain, predict, score, train
from affectframe.operators.bayes import trigger_words as top_words
from affectframe.operators.scorer import score_externally
from affectframe.operators.split import label_index as index_labels, stratified_split as split
from affectframe.operators.topics import prototype_scores, prototypes
from affectframe.plans.label import emotions_of
from affectframe.plans.train import Evaluation, train_and_evaluate
from affectframe.queries.registry import documents, query, table

LABELS = ("de", "en", "es", "fr")


@query("""SELECT (row_number() OVER (ORDER BY lang) - 1)::INT AS idx, lang AS label
FROM (SELECT DISTINCT lang FROM documents)""")
def label_index(spark: SparkSession, sf: str) -> DataFrame:
    return index_labels(table(spark, sf, "documents"), "lang")


@query("""SELECT (row_number() OVER (ORDER BY c_custkey) - 1)::INT AS idx, c_custkey AS label
FROM (SELECT DISTINCT c_custkey FROM customer)""")
def label_index_many(spark: SparkSession, sf: str) -> DataFrame:
    """As many labels as there are customers."""
    return index_labels(table(spark, sf, "customer"), "c_custkey")


def _quota_sql(source: str, label: str) -> str:
    return f"""sizes AS (SELECT {label} AS l, count(*) AS n FROM {source} GROUP BY 1),
held AS (SELECT l, n, ceil(sum(n) OVER () * 0.15::DOUBLE)::BIGINT AS h, sum(n) OVER () AS total FROM sizes),
parts AS (SELECT l, n, h, (h * n // total) AS base, (h * n % total) AS rest FROM held),
quotas AS (SELECT l, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, l) <= h - sum(base) OVER ()
                             THEN 1 ELSE 0 END AS quota FROM parts),
split AS (SELECT s.*, row_number() OVER (PARTITION BY {label} ORDER BY md5('42|' || doc_id), doc_id) <= quota AS held_out
          FROM {source} s JOIN quotas ON l = {label})"""


@query(f"WITH {_quota_sql('documents', 'lang')} SELECT doc_id, lang, held_out FROM split")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return split(table(spark, sf, "documents"), "lang", "doc_id").select("doc_id", "lang", "held_out")


@query(f"""WITH shared AS (SELECT (doc_id // 7) AS doc_id, lang FROM documents),
{_quota_sql('shared', 'lang')} SELECT lang, held_out, count(*) AS rows FROM split GROUP BY ALL""")
def split_repeated_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Several rows share an ID; the quotas are met all the same."""
    shared = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 7).alias("doc_id"), "lang", "text")
    return split(shared, "lang", "doc_id").groupBy("lang", "held_out").agg(F.count("*").alias("rows"))


# --- Naive Bayes in SQL, over a table `seen` (training posts) and `scored` posts ----------

_WORDS = r"""SELECT {columns}, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+')) AS token FROM {table}"""


def _words_sql(table_name: str, columns: str) -> str:
    return f"(SELECT * FROM ({_WORDS.format(table=table_name, columns=columns)}) WHERE token <> '')"


def _model_sql(seen: str, label: str, labels: tuple) -> str:
    counts = ", ".join(f"count(*) FILTER ({label} = '{x}') AS n{i}" for i, x in enumerate(labels))
    sums = ", ".join(f"sum(n{i}) AS t{i}" for i in range(len(labels)))
    weights = ", ".join(
        f"round(ln((n{i} + 1)::DOUBLE / (t{i} + v)::DOUBLE) * 1e9)::BIGINT AS w{i}" for i in range(len(labels))
    )
    priors = ", ".join(
        f"round(ln(count(*) FILTER ({label} = '{x}')::DOUBLE / count(*)) * 1e9)::BIGINT AS p{i}"
        for i, x in enumerate(labels)
    )
    return f"""counts AS MATERIALIZED (SELECT token, {counts} FROM {_words_sql(seen, label)} GROUP BY token),
totals AS (SELECT count(*) AS v, {sums} FROM counts),
model AS MATERIALIZED (SELECT token, {" + ".join(f"n{i}" for i in range(len(labels)))} AS n, {weights} FROM counts, totals),
priors AS (SELECT count(*) AS docs, {priors} FROM {seen})"""


def _scores_sql(scored: str, carried: str, labels: tuple) -> str:
    sums = ", ".join(f"coalesce(sum(w{i}), 0)::BIGINT AS s{i}" for i in range(len(labels)))
    totals = ", ".join(f"(s{i} + p{i}) / 1e9 AS z{i}" for i in range(len(labels)))
    every = ", ".join(f"z{i}" for i in range(len(labels)))
    pred = "CASE " + " ".join(
        f"WHEN z{i} >= greatest({every}) THEN '{x}'" for i, x in enumerate(labels)
    ) + " END"
    return f"""sums AS (SELECT d.doc_id, {carried}, {sums} FROM {scored} d
  LEFT JOIN {_words_sql(scored, "doc_id")} t ON t.doc_id = d.doc_id
  LEFT JOIN model m ON m.token = t.token GROUP BY ALL),
logs AS (SELECT sums.*, {totals} FROM sums, priors),
predicted AS (SELECT *, {pred} AS pred, greatest({every}) AS top FROM logs)"""


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf, "doc_id", "text", "lang")


def _model(spark: SparkSession, sf: str) -> BayesModel:
    return train(_documents(spark, sf), "text", "lang")


_MODEL = _model_sql("documents", "lang", LABELS)


@query(f"WITH {_MODEL} SELECT token, n, "
       + ", ".join(f"round(w{i} / 1e9, 6) AS w_{x}" for i, x in enumerate(LABELS)) + " FROM model")
def nb_model(spark: SparkSession, sf: str) -> DataFrame:
    model = _model(spark, sf)
    return model.weights.select("token", "n", *[
        F.round(F.col("w")[i] / 1e9, 6).alias(f"w_{name}") for i, name in enumerate(model.labels)
    ])


_NB = f"WITH {_MODEL}, {_scores_sql('documents', 'lang', LABELS)} "
_NB_ROWS = _NB + (
    "SELECT doc_id, pred, "
    + ", ".join(f"round(z{i}, 4) AS score_{x}" for i, x in enumerate(LABELS)) + ", "
    + "round(1 / (" + " + ".join(f"exp(z{i} - top)" for i in range(len(LABELS))) + "), 6) AS probability "
    + "FROM predicted"
)


def _prediction_rows(predictions: DataFrame) -> DataFrame:
    """One row per document; one without a text has no prediction and no scores."""
    return predictions.select(
        "doc_id", "pred",
        *[F.round(score_of(F.col("scores"), x), 4).alias(f"score_{x}") for x in LABELS],
        F.round(best(F.col("probabilities"))["score"], 6).alias("probability"),
    )


@query(_NB_ROWS)
def nb_predict(spark: SparkSession, sf: str) -> DataFrame:
    return _prediction_rows(predict(_model(spark, sf), _documents(spark, sf), "text", "doc_id"))


@query(_NB_ROWS)
def nb_predict_large_model(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the join for models too large to broadcast, forced by the limits."""
    scored = predict(
        _model(spark, sf), _documents(spark, sf), "text", "doc_id", max_bytes=0, head=1_000
    )
    return _prediction_rows(scored)


@query(_NB + "SELECT doc_id, lang, pred AS predicted_emotions, len(string_split(pred, ',')) AS labels FROM predicted")
def nb_label_lists(spark: SparkSession, sf: str) -> DataFrame:
    scored = score(_model(spark, sf), _documents(spark, sf), "text", "doc_id", ["lang"])
    decoded = emotions_of(scored)
    return decoded.select(
        "doc_id", "lang",
        F.array_join("predicted_emotions", ",").alias("predicted_emotions"),
        F.size("predicted_emotions").cast("bigint").alias("labels"),
    )


# --- Decoding of score vectors --------------------------------------------------------

_VECTORS = """means AS (
  SELECT label, pos, avg(x) AS m FROM (
    SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
  GROUP BY ALL),
prototypes AS (SELECT label, list(m ORDER BY pos) AS v FROM means GROUP BY label),
cosines AS (SELECT vec_id, e.label AS true_label, p.label AS label,
  list_cosine_similarity(embedding::DOUBLE[], v) AS score FROM embeddings e, prototypes p),
probabilities AS (SELECT *, exp(10 * score) / sum(exp(10 * score)) OVER (PARTITION BY vec_id) AS p,
  row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS place FROM cosines)"""


def _vector_scores(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return prototype_scores(vectors, "embedding", prototypes(vectors, "label", "embedding"))


def _sharpened(spark: SparkSession, sf: str) -> DataFrame:
    scaled = F.transform("scores", lambda s: F.struct(
        s["idx"].alias("idx"), s["label"].alias("label"), (s["score"] * 10).alias("score")
    ))
    return _vector_scores(spark, sf).withColumn("scores", scaled)


@query(f"""WITH {_VECTORS} SELECT vec_id, string_agg(label, ',' ORDER BY place) AS predicted_emotions
FROM probabilities WHERE (p >= 0.3 AND place <= 2) OR (place = 1) GROUP BY vec_id""")
def decode_labels(spark: SparkSession, sf: str) -> DataFrame:
    lists = decode(softmax(F.col("scores")), 0.3, 2)
    return _sharpened(spark, sf).select("vec_id", F.array_join(lists, ",").alias("predicted_emotions"))


@query(f"""WITH {_VECTORS} SELECT vec_id, string_agg(label, ',' ORDER BY place) AS top3_emotions,
  round(max(p), 6) AS probability FROM probabilities WHERE place <= 3 GROUP BY vec_id""")
def decode_top3(spark: SparkSession, sf: str) -> DataFrame:
    return _sharpened(spark, sf).select(
        "vec_id",
        F.array_join(top_labels(F.col("scores")), ",").alias("top3_emotions"),
        F.round(best(softmax(F.col("scores")))["score"], 6).alias("probability"),
    )


# --- Evaluation -----------------------------------------------------------------------


def _evaluation(spark: SparkSession, sf: str) -> Evaluation:
    return train_and_evaluate(_documents(spark, sf), "text", "lang", "doc_id")


def _held_out_sql(source: str, label: str, labels: tuple) -> str:
    return f"""{_quota_sql(source, label)},
seen AS MATERIALIZED (SELECT * FROM split WHERE NOT held_out),
unseen AS MATERIALIZED (SELECT * FROM split WHERE held_out),
{_model_sql("seen", label, labels)}, {_scores_sql("unseen", label, labels)},
pairs AS (SELECT {label} AS label, pred, count(*) AS count FROM predicted GROUP BY ALL),
sides AS (SELECT label AS class, CASE WHEN label = pred THEN count ELSE 0 END AS tp, count AS support, 0 AS predicted FROM pairs
          UNION ALL SELECT pred, 0, 0, count FROM pairs),
classes AS (SELECT class, sum(tp)::DOUBLE AS tp, sum(support)::DOUBLE AS support, sum(predicted)::DOUBLE AS predicted
            FROM sides GROUP BY class),
report AS (SELECT class, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, 2 * tp / (support + predicted) AS f1, support, tp FROM classes)"""


def _report_sql(source: str, label: str, labels: tuple) -> str:
    return f"""WITH {_held_out_sql(source, label, labels)}
SELECT 0 AS section, class, round(precision, 2) AS precision, round(recall, 2) AS recall, round(f1, 2) AS f1, support::BIGINT AS support FROM report
UNION ALL SELECT 1, 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 2), sum(support)::BIGINT FROM report
UNION ALL SELECT 2, 'macro avg', round(avg(precision), 2), round(avg(recall), 2), round(avg(f1), 2), sum(support)::BIGINT FROM report
UNION ALL SELECT 3, 'weighted avg', round(sum(precision * support) / sum(support), 2), round(sum(recall * support) / sum(support), 2),
  round(sum(f1 * support) / sum(support), 2), sum(support)::BIGINT FROM report"""


@query(_report_sql("documents", "lang", LABELS))
def eval_report(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluation(spark, sf).report


@query(f"""WITH {_held_out_sql("documents", "lang", LABELS)}
SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(sum(tp) / sum(support), 6) AS micro_f1 FROM report""")
def eval_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluation(spark, sf).accuracy.select(
        F.round("accuracy", 6).alias("accuracy"), F.round("micro_f1", 6).alias("micro_f1")
    )


@query(f"""WITH {_held_out_sql("documents", "lang", LABELS)}
SELECT label, {", ".join(f"coalesce(sum(count) FILTER (pred = '{x}'), 0)::BIGINT AS {x}" for x in LABELS)}
FROM pairs GROUP BY label""")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluation(spark, sf).confusion


# A second, lopsided label: few of the judged documents are toxic.
_JUDGED = """judged AS (SELECT d.doc_id, text, CASE toxic WHEN 1 THEN 'toxic' ELSE 'fine' END AS verdict
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


@query(_report_sql("judged", "verdict", ("fine", "toxic")).replace("WITH ", f"WITH {_JUDGED}, ", 1))
def eval_report_rare_class(spark: SparkSession, sf: str) -> DataFrame:
    judged = documents(spark, sf, "doc_id", "text").join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "text", F.when(F.col("toxic") == 1, "toxic").otherwise("fine").alias("verdict")
    )
    return train_and_evaluate(judged, "text", "verdict", "doc_id").report


# --- Explanation ----------------------------------------------------------------------

_MEAN_W = "(" + " + ".join(f"w{i}" for i in range(len(LABELS))) + f") / {float(len(LABELS))}"
_PHI = ", ".join(
    f"round((w{i} - {_MEAN_W}) / 1e9 * (tf - n::DOUBLE / docs), 6) AS phi_{x}" for i, x in enumerate(LABELS)
)


def _phi_columns(df: DataFrame) -> list:
    return [F.round(F.col("phi")[i], 6).alias(f"phi_{x}") for i, x in enumerate(LABELS)]


@query(f"""WITH {_MODEL}, tf AS (SELECT doc_id, token, count(*) AS tf FROM {_words_sql("documents", "doc_id")} GROUP BY ALL)
SELECT doc_id, tf.token AS token, tf, {_PHI} FROM tf JOIN model ON model.token = tf.token, priors""")
def token_contributions(spark: SparkSession, sf: str) -> DataFrame:
    rows = explain(_model(spark, sf), _documents(spark, sf), "text", "doc_id")
    present = rows.filter(F.col("token").isNotNull())
    return present.select("doc_id", "token", "tf", *_phi_columns(present))


@query(_NB + "SELECT doc_id, " + ", ".join(
    f"round(z{i} - (" + " + ".join(f"z{j}" for j in range(len(LABELS))) + f") / {float(len(LABELS))}, 4) AS centred_{x}"
    for i, x in enumerate(LABELS)
) + " FROM predicted")
def contribution_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Contributions and base values of a post add up to its centred scores."""
    model = _model(spark, sf)
    rows = explain(model, _documents(spark, sf), "text", "doc_id")
    base = base_values(model).agg(F.array_sort(F.collect_list(F.struct("idx", "base")))).scalar()
    sums = rows.groupBy("doc_id").agg(*[F.sum(F.col("phi")[i]).alias(f"sum{i}") for i in range(len(LABELS))])
    return sums.withColumn("_base", base).select("doc_id", *[
        F.round(F.col(f"sum{i}") + F.col("_base")[i]["base"], 4).alias(f"centred_{x}")
        for i, x in enumerate(LABELS)
    ])


_MEAN_PHI = "CASE label " + " ".join(
    f"WHEN '{x}' THEN (w{i} - {_MEAN_W}) / 1e9" for i, x in enumerate(LABELS)
) + " END * (uses::DOUBLE / size - n::DOUBLE / docs)"


@query(f"""WITH {_MODEL}, uses AS (SELECT lang AS label, token, count(*) AS uses FROM {_words_sql("documents", "lang")} GROUP BY ALL),
sizes AS (SELECT lang AS l, count(*) AS size FROM documents GROUP BY 1),
phi AS (SELECT label, uses.token AS token, uses, round({_MEAN_PHI}, 9) AS mean_phi
        FROM uses JOIN model ON model.token = uses.token JOIN sizes ON l = label, priors)
SELECT label, token, uses, round(mean_phi, 6) AS mean_phi,
  row_number() OVER (PARTITION BY label ORDER BY mean_phi DESC, token)::INT AS rank FROM phi QUALIFY rank <= 10""")
def trigger_words(spark: SparkSession, sf: str) -> DataFrame:
    top = top_words(_model(spark, sf), _documents(spark, sf), "text", "lang", 10)
    return top.withColumn("mean_phi", F.round("mean_phi", 6))


# --- A model outside Spark --------------------------------------------------------------


def _vowel_counts(texts: list[str]) -> list[list[float]]:
    """A toy model: how often each vowel occurs in a text."""
    return [[text.count(vowel) for vowel in "aeo"] for text in texts]


@query("""SELECT doc_id, (length(text) - length(replace(text, 'a', '')))::DOUBLE AS a,
  (length(text) - length(replace(text, 'e', '')))::DOUBLE AS e,
  (length(text) - length(replace(text, 'o', '')))::DOUBLE AS o, false AS failed
FROM documents""")
def external_scorer(spark: SparkSession, sf: str) -> DataFrame:
    scored = score_externally(documents(spark, sf, "doc_id", "text"), "text", "doc_id", list("aeo"), _vowel_counts)
    return scored.select("doc_id", *[
        F.col("scores")[i]["score"].alias(v) for i, v in enumerate("aeo")
    ], F.col("error").isNotNull().alias("failed"))
