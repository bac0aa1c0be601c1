"""Whole jobs, as a user runs them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affectframe.constants import EVENT_KEYWORDS, SMALL_SHARE
from affectframe.plans.analyse import analyse
from affectframe.plans.clean import clean_posts, clean_report
from affectframe.plans.collect import collect_posts
from affectframe.plans.explain import explain_examples
from affectframe.plans.label import add_emotions, add_topics
from affectframe.queries.models import LABELS, _MODEL, _NB, _PHI, _documents, _model, _words_sql
from affectframe.queries.registry import POSTS, authors, documents, posts, query
from affectframe.queries.texts import DECORATED, _CLEAN_SQL, _W, _decorated
from affectframe.queries.topics import LEXICON, _TOPIC_SCORES


@query("""WITH landed AS (
  SELECT doc_id, source, text, CASE lang WHEN 'es' THEN 'old' WHEN 'fr' THEN 'repost' ELSE 'new' END AS kind,
         TIMESTAMP '2021-01-01' + to_minutes(n_chars::INT) AS moment FROM documents)
SELECT doc_id AS "ID", source AS "Author" FROM landed WHERE kind = 'new'
QUALIFY row_number() OVER (PARTITION BY source ORDER BY moment DESC, doc_id DESC) <= 7""")
def collect_job(spark: SparkSession, sf: str) -> DataFrame:
    """Landed posts, some of them twice, to the newest eligible ones of each author."""
    minutes = F.timestamp_add("MINUTE", F.col("n_chars").cast("int"), F.lit("2021-01-01").cast("timestamp"))
    old = F.lit("Thu Dec 31 23:59:59 +0000 2020")
    landed = documents(spark, sf).select(
        F.col("doc_id").alias("ID"),
        F.col("source").alias("Author"),
        F.concat(F.when(F.col("lang") == "fr", "RT @").otherwise(""), F.col("text")).alias("Text"),
        F.when(F.col("lang") == "es", old)
        .otherwise(F.date_format(minutes, "EEE MMM dd HH:mm:ss +0000 yyyy")).alias("Date"),
    )
    twice = landed.unionByName(landed.filter(F.col("Author") == "src1"))
    return collect_posts(twice, per_author=7).select("ID", "Author")


def _raw_posts(spark: SparkSession, sf: str) -> DataFrame:
    return _decorated(spark, sf).select(
        F.col("doc_id").alias("ID"),
        F.concat(F.lit("author"), F.col("doc_id").cast("string")).alias("Author"),
        # Some announce an event, some are short.
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("Yarın büyük miting var "), F.col("text")))
        .when(F.col("doc_id") % 11 == 0, "two words").otherwise(F.col("text")).alias("Text"),
        F.lit("Fri Jan 01 00:00:00 +0000 2021").alias("Date"),
    )


_CLEANED = f"""{DECORATED}, phrased AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Yarın büyük miting var ' || text
  WHEN doc_id % 11 = 0 THEN 'two words' ELSE text END AS text FROM decorated),
cleaned AS MATERIALIZED (SELECT doc_id, {_CLEAN_SQL} AS text FROM phrased),
flags AS (SELECT doc_id, text,
  {" OR ".join(f"contains(lower(text), '{k}')" for k in EVENT_KEYWORDS)} AS announces,
  len(list_filter(regexp_split_to_array(text, '[^{_W}]+'), lambda x: x <> '')) >= 3 AS long FROM cleaned)"""


@query(f"""WITH {_CLEANED} SELECT doc_id AS "ID", 'author' || doc_id AS "Author", c_mktsegment AS party,
  r_name AS political_side, length(text) AS characters
FROM flags LEFT JOIN customer ON doc_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey WHERE long AND NOT announces""")
def clean_job(spark: SparkSession, sf: str) -> DataFrame:
    people = authors(spark, sf).withColumn(
        "Author", F.concat(F.lit("@author"), F.col("Author").cast("string"))
    )
    cleaned = clean_posts(_raw_posts(spark, sf), people)
    return cleaned.select(
        "ID", "Author", "party", "political_side", F.length("Text").cast("bigint").alias("characters")
    )


@query(f"""WITH {_CLEANED}
SELECT 1 AS stage, 'event announcements' AS name, count(*) FILTER (announces) AS removed, count(*) FILTER (NOT announces) AS kept FROM flags
UNION ALL SELECT 2, 'short texts', count(*) FILTER (NOT announces AND NOT long), count(*) FILTER (NOT announces AND long) FROM flags""")
def clean_job_report(spark: SparkSession, sf: str) -> DataFrame:
    return clean_report(_raw_posts(spark, sf))


@query(_NB.rstrip() + f""", {_TOPIC_SCORES}, topics AS (SELECT doc_id, CASE WHEN top < 0.5 THEN 'uncertain'
  WHEN s0 = top THEN 'economy' WHEN s1 = top THEN 'foreign_policy' WHEN s2 = top THEN 'sports' ELSE 'disaster' END AS topic FROM best),
long AS (SELECT doc_id, unnest(['de', 'en', 'es', 'fr']) AS label, unnest([z0, z1, z2, z3]) AS z FROM predicted),
ranks AS (SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY z DESC, label) AS place FROM long),
lists AS (SELECT doc_id, string_agg(label, ',' ORDER BY place) AS top3_emotions FROM ranks WHERE place <= 3 GROUP BY doc_id)
SELECT predicted.doc_id AS "ID", topic, pred AS predicted_emotions, top3_emotions, length(text) AS characters
FROM predicted JOIN topics USING (doc_id) JOIN lists USING (doc_id) JOIN documents USING (doc_id)""")
def label_job(spark: SparkSession, sf: str) -> DataFrame:
    """Topic and emotions of every post, with its text."""
    raw = _documents(spark, sf).select(F.col("doc_id").alias("ID"), F.col("text").alias("Text"))
    labelled = add_emotions(add_topics(raw, LEXICON), _model(spark, sf))
    return labelled.select(
        "ID", "topic",
        F.array_join("predicted_emotions", ",").alias("predicted_emotions"),
        F.array_join("top3_emotions", ",").alias("top3_emotions"),
        F.length("Text").cast("bigint").alias("characters"),
    )


@query(_NB.rstrip() + """ SELECT CASE WHEN doc_id % 10 <> 0 THEN doc_id // 3 END AS "ID", length(text) AS characters,
  pred AS predicted_emotions FROM predicted JOIN documents USING (doc_id)""")
def label_repeated_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that share an ID, or have none, get the labels of their own texts."""
    raw = _documents(spark, sf).select(
        F.when(F.col("doc_id") % 10 != 0, F.floor(F.col("doc_id") / 3)).alias("ID"), F.col("text").alias("Text")
    )
    return add_emotions(raw, _model(spark, sf)).select(
        "ID", F.length("Text").cast("bigint").alias("characters"),
        F.array_join("predicted_emotions", ",").alias("predicted_emotions"),
    )


@query(f"""WITH {POSTS}, long AS (
  SELECT party, political_side, nullif(topic, 'P') AS topic, unnest([
    upper(predicted_emotions[1]) || lower(predicted_emotions[2:]), topic]) AS label FROM posts
), shares AS (
  SELECT 'party_shares_without_excluded' AS name, party AS part, label, count(*) AS count FROM long
  WHERE topic IS DISTINCT FROM 'F' GROUP BY ALL
  UNION ALL SELECT 'side_shares', political_side, label, count(*) FROM long GROUP BY ALL
  UNION ALL SELECT 'party_shares', party, label, count(*) FROM long GROUP BY ALL)
SELECT *, round(100.0::DOUBLE * count / sum(count) OVER (PARTITION BY name, part), 6) AS percentage FROM shares""")
def analysis_job(spark: SparkSession, sf: str) -> DataFrame:
    """Shares out of one table of counts; posts carry two labels, some have no topic."""
    labelled = posts(spark, sf).withColumns({
        "predicted_emotions": F.concat_ws(",", "predicted_emotions", "topic"),
        "topic": F.nullif("topic", F.lit("P")),
    })
    tables = analyse(labelled, excluded_topics=["F"], focus=["O"])
    group = {
        "party_shares_without_excluded": "party", "side_shares": "political_side", "party_shares": "party",
    }
    parts = [
        tables[name].select(
            F.lit(name).alias("name"), F.col(column).alias("part"),
            F.col("predicted_emotions").alias("label"), "count", F.round("percentage", 6).alias("percentage"),
        )
        for name, column in group.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Posts with up to four labels; some have no topic, two labels have small shares.
_LABELS = f"""WITH {POSTS}, long AS (
  SELECT party, political_side, nullif(posts.topic, 'P') AS topic, moment, unnest([
    upper(predicted_emotions[1]) || lower(predicted_emotions[2:]), posts.topic,
    CASE WHEN "ID" % 101 = 0 THEN 'Rare' END, CASE WHEN "ID" % 103 = 0 THEN 'Scarce' END]) AS predicted_emotions FROM posts
), labels AS (SELECT * FROM long WHERE predicted_emotions IS NOT NULL)"""


def _analysed(spark: SparkSession, sf: str, name: str) -> DataFrame:
    labelled = posts(spark, sf).withColumns({
        "predicted_emotions": F.concat_ws(
            ",", "predicted_emotions", "topic",
            F.when(F.col("ID") % 101 == 0, "rare"), F.when(F.col("ID") % 103 == 0, "scarce"),
        ),
        "topic": F.nullif("topic", F.lit("P")),
    })
    tables = analyse(
        labelled, excluded_topics=["F"], focus=["O", "none", "F"], series_emotions=["O", "1-urgent"],
        event_date="1998-05-14", event_parties=["BUILDING", "MACHINERY"], event_emotions=["1-urgent", "2-high"],
    )
    return tables[name]


_PARTY_TOP = """ SELECT party, predicted_emotions, count(*) AS count,
  row_number() OVER (PARTITION BY party ORDER BY count(*) DESC, predicted_emotions)::INT AS rank
  FROM labels {} GROUP BY party, predicted_emotions QUALIFY rank <= 3"""


@query(_LABELS + " SELECT party, predicted_emotions, count(*) AS count FROM labels GROUP BY ALL")
def analysis_party_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _analysed(spark, sf, "party_counts")


@query(_LABELS + _PARTY_TOP.format(""))
def analysis_party_top3(spark: SparkSession, sf: str) -> DataFrame:
    return _analysed(spark, sf, "party_top3")


@query(_LABELS + f""", top AS ({_PARTY_TOP.format("")}) SELECT party, party || ': ' ||
  string_agg(predicted_emotions || '=' || count, ', ' ORDER BY rank) AS line FROM top GROUP BY party""")
def analysis_party_top3_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _analysed(spark, sf, "party_top3_lines")


@query(_LABELS + _PARTY_TOP.format("WHERE topic IS DISTINCT FROM 'F'"))
def analysis_party_top3_without_excluded(spark: SparkSession, sf: str) -> DataFrame:
    return _analysed(spark, sf, "party_top3_without_excluded")


@query(_LABELS + """ SELECT topic, count(*) AS count, (CASE topic WHEN 'O' THEN 1 ELSE 3 END)::INT AS position
FROM labels WHERE topic IN ('O', 'F') GROUP BY topic""")
def analysis_focus_topics(spark: SparkSession, sf: str) -> DataFrame:
    return _analysed(spark, sf, "focus_topics")


@query(_LABELS + """ SELECT topic, party, predicted_emotions, count(*) AS count FROM labels WHERE topic IN ('O', 'F')
GROUP BY topic, party, predicted_emotions
QUALIFY row_number() OVER (PARTITION BY topic, party ORDER BY count(*) DESC, predicted_emotions) = 1""")
def analysis_topic_party_tops(spark: SparkSession, sf: str) -> DataFrame:
    return _analysed(spark, sf, "topic_party_tops").select("topic", "party", "predicted_emotions", "count")


@query(_LABELS + """ SELECT topic, party, predicted_emotions, count(*) AS count,
  round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY topic, party), 6) AS percentage
FROM labels WHERE topic IN ('O', 'F') GROUP BY topic, party, predicted_emotions""")
def analysis_topic_party_shares(spark: SparkSession, sf: str) -> DataFrame:
    shares = _analysed(spark, sf, "topic_party_shares")
    return shares.select("topic", "party", "predicted_emotions", "count", F.round("percentage", 6).alias("percentage"))


@query(_LABELS + f""", counts AS (
  SELECT topic, predicted_emotions AS label, count(*) AS n FROM labels WHERE topic IN ('O', 'F') GROUP BY ALL
), marked AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY topic) < {SMALL_SHARE} AS small FROM counts
), folding AS (SELECT *, small AND count(*) FILTER (small) OVER (PARTITION BY topic) > 1 AS folds FROM marked
), folded AS (
  SELECT topic, CASE WHEN folds THEN 'Other' ELSE label END AS label, folds, sum(n)::BIGINT AS count FROM folding GROUP BY ALL
), totals AS (SELECT *, sum(count) OVER (PARTITION BY topic)::BIGINT AS total FROM folded
), tenths AS (SELECT *, (count * 2000 + total) // (total * 2) AS t FROM totals)
SELECT topic, label AS predicted_emotions, count, round(count::DOUBLE / total, 6) AS share,
  CASE WHEN count * 100 >= total * 5
       THEN (t // 10) || '.' || (t % 10) || '%' || chr(10) || '(' || count || ')' ELSE '' END AS text,
  row_number() OVER (PARTITION BY topic ORDER BY folds, count DESC, label)::INT AS position FROM tenths""")
def analysis_topic_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _analysed(spark, sf, "topic_shares").withColumn("share", F.round("share", 6))


@query(_LABELS + """ SELECT political_side, predicted_emotions, count(*) AS count,
  row_number() OVER (PARTITION BY political_side ORDER BY count(*) DESC, predicted_emotions)::INT AS rank
FROM labels GROUP BY political_side, predicted_emotions QUALIFY rank <= 3""")
def analysis_side_top3(spark: SparkSession, sf: str) -> DataFrame:
    return _analysed(spark, sf, "side_top3")


@query(_LABELS + """, picked AS (SELECT moment, predicted_emotions AS e FROM labels WHERE predicted_emotions IN ('O', '1-urgent')
), span AS (SELECT floor((epoch_us(max(moment)) - epoch_us(min(moment))) / 86400000000.0) > 90 AS monthly FROM picked)
SELECT strftime(CASE WHEN monthly THEN date_trunc('month', moment) ELSE date_trunc('day', moment) END, '%Y-%m-%d') AS ts_period,
  count(*) FILTER (e = 'O') AS "O", count(*) FILTER (e = '1-urgent') AS "1-urgent" FROM picked, span GROUP BY 1""")
def analysis_series(spark: SparkSession, sf: str) -> DataFrame:
    return _analysed(spark, sf, "series").withColumn("ts_period", F.date_format("ts_period", "yyyy-MM-dd"))


@query(_LABELS + """ SELECT party, strftime(date_trunc('week', moment), '%Y-%m-%d') AS ts_period,
  count(*) FILTER (predicted_emotions = '1-urgent') AS "1-urgent", count(*) FILTER (predicted_emotions = '2-high') AS "2-high"
FROM labels WHERE moment BETWEEN TIMESTAMP '1998-03-14' AND TIMESTAMP '1998-07-14'
  AND party IN ('BUILDING', 'MACHINERY') AND predicted_emotions IN ('1-urgent', '2-high') GROUP BY ALL""")
def analysis_event_series(spark: SparkSession, sf: str) -> DataFrame:
    return _analysed(spark, sf, "event_series").withColumn("ts_period", F.date_format("ts_period", "yyyy-MM-dd"))


@query(f"""WITH {_MODEL}, chosen AS (
  SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id)::INT AS ordinal FROM documents
  WHERE lang IN ('fr', 'de') QUALIFY ordinal <= 5),
tf AS (SELECT doc_id, token, count(*) AS tf FROM {_words_sql("chosen", "doc_id")} GROUP BY ALL)
SELECT lang AS predicted_emotions, ordinal, tf.token AS token, tf, {_PHI}
FROM tf JOIN chosen ON chosen.doc_id = tf.doc_id JOIN model ON model.token = tf.token, priors""")
def explain_job(spark: SparkSession, sf: str) -> DataFrame:
    """Word contributions for the first posts of some labels, as examples."""
    labelled = _documents(spark, sf).withColumnRenamed("lang", "predicted_emotions")
    rows = explain_examples(
        labelled, _model(spark, sf), labels=["fr", "de"], n=5, text="text", id="doc_id"
    )
    return rows.filter(F.col("token").isNotNull()).select(
        "predicted_emotions", "ordinal", "token", "tf",
        *[F.round(F.col("phi")[i], 6).alias(f"phi_{x}") for i, x in enumerate(LABELS)],
    )
