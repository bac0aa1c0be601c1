"""Logistic regression: the model, its predictions, and a report on held-out posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affectframe.functions.scores import best
from affectframe.operators.evaluation import classification_report, pair_counts
from affectframe.operators.logistic import BITS, L2, UNIT, LogisticModel, momenta, predict, train
from affectframe.operators.split import stratified_split as split
from affectframe.queries.models import LABELS, _quota_sql, _words_sql
from affectframe.queries.registry import documents, query

ROUNDS = 12
_K = range(len(LABELS))


def _each(form: str, joint: str = ", ") -> str:
    return joint.join(form.format(i=i, label=x) for i, x in enumerate(LABELS))


def _features_sql(name: str, source: str) -> str:
    """Shares of the words by bucket, and the intercept's."""
    return f"""{name} AS MATERIALIZED (
  SELECT doc_id, idx, n / sum(n) OVER (PARTITION BY doc_id) AS share FROM (
    SELECT doc_id, ('0x' || substr(md5(token), 1, 5))::INT % {1 << BITS} AS idx, count(*)::DOUBLE AS n
    FROM {_words_sql(source, "doc_id")} GROUP BY ALL)
  UNION ALL SELECT doc_id, {1 << BITS}, 1.0 FROM {source})"""


def _sides_sql(name: str, source: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT doc_id, lang, left(md5(text), 1) = '0' AS held FROM {source})"


def _logits_sql(rows: str, features: str, weights: str) -> str:
    sums = _each("coalesce(sum(share * w{i}), 0) AS z{i}")
    return f"""SELECT d.doc_id, any_value(lang) AS lang, any_value(held) AS held, {sums}
  FROM {rows} d JOIN {features} f ON f.doc_id = d.doc_id LEFT JOIN {weights} a ON a.idx = f.idx GROUP BY d.doc_id"""


def _fit_sql(seen: str) -> str:
    """The rounds of the fit over a table of training posts, as ``model (idx, w0 ..)``."""
    parts = [
        _features_sql("features", seen), _sides_sql("sides", seen),
        f"""curvature AS MATERIALIZED (SELECT idx, sum(round_even(share * {UNIT}, 0))::DOUBLE / {UNIT} AS c
  FROM features JOIN sides ON sides.doc_id = features.doc_id WHERE NOT held GROUP BY idx)""",
        f"a0 AS MATERIALIZED (SELECT idx, {_each('0::DOUBLE AS w{i}, 0::DOUBLE AS l{i}')} FROM curvature)",
    ]
    for r, momentum in enumerate(momenta(ROUNDS)):
        every = _each("z{i}")
        own = "CASE lang " + _each("WHEN '{label}' THEN z{i}", " ") + " END"
        parts.append(f"""p{r} AS MATERIALIZED (
  SELECT doc_id, held, {_each("e{i} / (" + _each("e{i}", " + ") + ") - (lang = '{label}')::INT AS p{i}")},
         round_even((ln({_each("e{i}", " + ")}) - own) * {UNIT}, 0) AS loss
  FROM (SELECT *, {own} - greatest({every}) AS own, {_each(f"exp(z{{i}} - greatest({every})) AS e{{i}}")}
        FROM ({_logits_sql("sides", "features", f"a{r}")})))""")
        sums = _each(f"sum(round_even(p{{i}} * share * {UNIT}, 0))::DOUBLE / {UNIT} AS g{{i}}")
        step = f"(w{{i}} - (g{{i}} + {L2!r}::DOUBLE * w{{i}}) / (c + {L2!r}::DOUBLE))"
        parts.append(f"""a{r + 1} AS MATERIALIZED (
  SELECT a.idx, {_each(f"{step} + {momentum!r}::DOUBLE * ({step} - l{{i}}) AS w{{i}}, {step} AS l{{i}}")}
  FROM a{r} a JOIN curvature USING (idx)
  JOIN (SELECT idx, {sums} FROM features f JOIN p{r} ON p{r}.doc_id = f.doc_id WHERE NOT held GROUP BY idx) USING (idx))""")
    losses = " UNION ALL ".join(f"SELECT {r} AS round, sum(loss) AS loss FROM p{r} WHERE held" for r in range(ROUNDS))
    every = " UNION ALL ".join(f"SELECT {r} AS round, * FROM a{r}" for r in range(ROUNDS))
    parts.append(f"kept AS MATERIALIZED (SELECT round FROM ({losses}) ORDER BY loss, round LIMIT 1)")
    parts.append(f"model AS MATERIALIZED (SELECT idx, {_each('w{i}')} FROM ({every}) JOIN kept USING (round))")
    return ",\n".join(parts)


def _predicted_sql(scored: str) -> str:
    every = _each("z{i}")
    pred = "CASE " + _each(f"WHEN z{{i}} >= greatest({every}) THEN '{{label}}'", " ") + " END"
    return f"""{_features_sql("words", scored)}, {_sides_sql("scored", scored)},
predicted AS MATERIALIZED (SELECT *, {pred} AS pred, greatest({every}) AS top FROM ({_logits_sql("scored", "words", "model")}))"""


def _fitted(posts: DataFrame) -> LogisticModel:
    return train(posts, "text", "lang", rounds=ROUNDS, patience=ROUNDS)


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf, "doc_id", "text", "lang")


@query(f"WITH {_fit_sql('documents')} SELECT idx, {_each('round(w{i}, 2) AS w_{label}')} FROM model")
def lr_model(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of every bucket that the training posts use, those of the best round."""
    model = _fitted(_documents(spark, sf))
    return model.weights.select("idx", *[F.round(F.col("w")[i], 2).alias(f"w_{x}") for i, x in enumerate(model.labels)])


@query(f"""WITH {_fit_sql('documents')}, {_predicted_sql('documents')}
SELECT doc_id, pred, round(1 / ({_each("exp(z{i} - top)", " + ")}), 3) AS probability FROM predicted""")
def lr_predict(spark: SparkSession, sf: str) -> DataFrame:
    posts = _documents(spark, sf)
    scored = predict(_fitted(posts), posts, "text", "doc_id")
    return scored.select("doc_id", "pred", F.round(best(F.col("probabilities"))["score"], 3).alias("probability"))


_CLASSES = "UNION ALL ".join(
    f"""SELECT '{x}' AS class, count(*) FILTER (lang = '{x}' AND pred = '{x}')::DOUBLE AS tp,
  count(*) FILTER (lang = '{x}')::DOUBLE AS support, count(*) FILTER (pred = '{x}')::DOUBLE AS predicted FROM predicted """
    for x in LABELS
)


@query(f"""WITH {_quota_sql('documents', 'lang')},
seen AS MATERIALIZED (SELECT * FROM split WHERE NOT held_out), unseen AS MATERIALIZED (SELECT * FROM split WHERE held_out),
{_fit_sql('seen')}, {_predicted_sql('unseen')}, classes AS ({_CLASSES}),
report AS (SELECT class, tp, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, 2 * tp / (support + predicted) AS f1
  FROM classes WHERE support + predicted > 0)
SELECT 0 AS section, class, round(precision, 2) AS precision, round(recall, 2) AS recall, round(f1, 2) AS f1, support::BIGINT AS support FROM report
UNION ALL SELECT 1, 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 2), sum(support)::BIGINT FROM report
UNION ALL SELECT 2, 'macro avg', round(avg(precision), 2), round(avg(recall), 2), round(avg(f1), 2), sum(support)::BIGINT FROM report
UNION ALL SELECT 3, 'weighted avg', round(sum(precision * support) / sum(support), 2), round(sum(recall * support) / sum(support), 2),
  round(sum(f1 * support) / sum(support), 2), sum(support)::BIGINT FROM report""")
def lr_report(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted on a stratified part of the posts, judged on the rest."""
    posts = split(_documents(spark, sf), "lang", "doc_id")
    model = _fitted(posts.filter(~F.col("held_out")))
    predicted = predict(model, posts.filter("held_out"), "text", "doc_id", ["lang"])
    return classification_report(pair_counts(predicted, "lang", "pred"))
