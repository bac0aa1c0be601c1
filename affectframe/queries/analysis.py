"""Counts, shares, ranks, folds and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affectframe.functions.predicates import has_words, mentions_any
from affectframe.functions.text import capitalize
from affectframe.operators.counts import (
    author_profile as profile,
    busiest_topics,
    common_values,
    count_by,
    distinct_values,
    explode_labels,
    focus_topics,
    fold_small_shares,
    label_distribution as distribution_of_labels,
    missing_values,
    party_emotions,
    side_emotions,
    stage_counts as count_stages,
    topic_party_emotions,
    value_distribution as distribution_of,
    with_percentage,
)
from affectframe.operators.filters import drop_blank, drop_missing, drop_values, keep_values
from affectframe.operators.joins import dimension_join, drop_matching, keep_matching
from affectframe.operators.ranking import cap_per_author as cap, top_counts, top_line
from affectframe.plans.analyse import topic_tops
from affectframe.queries.registry import (
    POSTS,
    authors,
    bare_posts,
    documents,
    posts,
    query,
    table,
)


@query(f"""WITH {POSTS}
SELECT party, predicted_emotions, count(*) AS count FROM posts
WHERE party IS NOT NULL AND predicted_emotions IS NOT NULL GROUP BY ALL""")
def party_emotion_counts(spark: SparkSession, sf: str) -> DataFrame:
    return party_emotions(posts(spark, sf))


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"""WITH {POSTS}
SELECT party, predicted_emotions, count(*) AS count,
       round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY party), 6) AS percentage
FROM posts GROUP BY party, predicted_emotions""")
def party_emotion_share(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(with_percentage(party_emotions(posts(spark, sf)), "party"), "percentage")


_TOP3 = f"""WITH {POSTS}, counts AS (
  SELECT party, predicted_emotions, count(*) AS count FROM posts GROUP BY ALL
), top AS (
  SELECT *, row_number() OVER (PARTITION BY party ORDER BY count DESC, predicted_emotions)::INT AS rank
  FROM counts QUALIFY rank <= 3
)"""


@query(_TOP3 + " SELECT party, predicted_emotions, count, rank FROM top")
def party_top3(spark: SparkSession, sf: str) -> DataFrame:
    return top_counts(party_emotions(posts(spark, sf)), "party", n=3)


@query(_TOP3 + """ SELECT party, party || ': ' ||
  string_agg(predicted_emotions || '=' || count, ', ' ORDER BY rank) AS line FROM top GROUP BY party""")
def party_top3_line(spark: SparkSession, sf: str) -> DataFrame:
    return top_line(top_counts(party_emotions(posts(spark, sf)), "party", n=3), "party")


@query(f"""WITH {POSTS}
SELECT party, predicted_emotions, count(*) AS count,
       round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY party), 6) AS percentage
FROM posts WHERE topic <> 'O' GROUP BY party, predicted_emotions""")
def party_share_excluding(spark: SparkSession, sf: str) -> DataFrame:
    # Status F stands for a missing topic, which no exclusion list may remove.
    known = posts(spark, sf).withColumn("topic", F.nullif("topic", F.lit("F")))
    kept = drop_values(known, "topic", ["O"])
    return _rounded(with_percentage(party_emotions(kept), "party"), "percentage")


@query("""WITH debtors AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
SELECT 'member' AS kind, o_orderstatus AS topic, count(*) AS count FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM debtors) GROUP BY ALL
UNION ALL
SELECT 'other', o_orderstatus, count(*) FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM debtors) GROUP BY ALL
UNION ALL
SELECT 'listed', o_orderstatus, count(*) FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY ALL""")
def semi_anti_membership(spark: SparkSession, sf: str) -> DataFrame:
    facts = bare_posts(spark, sf)
    debtors = table(spark, sf, "customer").filter(F.col("c_acctbal") < 0).select(
        F.col("c_custkey").alias("Author")
    )
    parts = {
        "member": keep_matching(facts, debtors, "Author"),
        "other": drop_matching(facts, debtors, "Author"),
        "listed": keep_values(facts, "topic", ["O", "P"]),
    }
    counted = [
        count_by(part, ["topic"]).select(F.lit(kind).alias("kind"), "topic", "count")
        for kind, part in parts.items()
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query(r"""SELECT d.doc_id, quality, regexp_extract(text, '[0-9]+') AS number
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE quality IS NOT NULL AND regexp_extract(text, '[0-9]+') <> ''""")
def null_blank_drop(spark: SparkSession, sf: str) -> DataFrame:
    # Unlabelled documents have no quality; texts without digits leave only white space.
    number = F.regexp_extract("text", "[0-9]+", 0)
    padded = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("  "), number, F.lit(" ")).alias("number")
    )
    labelled = padded.join(table(spark, sf, "labels"), "doc_id", "left")
    kept = drop_blank(drop_missing(labelled, ["quality"]), "number")
    return kept.select("doc_id", "quality", F.regexp_replace("number", r"\D", "").alias("number"))


@query(f"""WITH {POSTS}
SELECT topic, party, predicted_emotions, count(*) AS count FROM posts GROUP BY ALL""")
def topic_party_emotion_counts(spark: SparkSession, sf: str) -> DataFrame:
    return topic_party_emotions(posts(spark, sf))


@query(f"""WITH {POSTS}, counts AS (
  SELECT topic, party, predicted_emotions, count(*) AS count FROM posts GROUP BY ALL)
SELECT topic, party, predicted_emotions, count,
       (CASE topic WHEN 'P' THEN 1 ELSE 2 END) AS position
FROM counts WHERE topic IN ('P', 'O')
QUALIFY row_number() OVER (PARTITION BY topic, party ORDER BY count DESC, predicted_emotions) = 1""")
def topic_party_top1(spark: SparkSession, sf: str) -> DataFrame:
    counts = topic_party_emotions(posts(spark, sf))
    return topic_tops(counts, focus_topics(counts, ["P", "none", "O"])).select(
        "topic", "party", "predicted_emotions", "count",
        F.when(F.col("position") == 1, 1).otherwise(2).alias("position"),
    )


@query(f"""WITH {POSTS}, totals AS (
  SELECT topic, count(*) AS count FROM posts GROUP BY topic)
SELECT 'some occur' AS run, topic, count, CASE topic WHEN 'P' THEN 2 WHEN 'F' THEN 3 END AS position
FROM totals WHERE topic IN ('P', 'F')
UNION ALL
SELECT 'none occurs', topic, count, row_number() OVER (ORDER BY count DESC, topic)::INT AS position
FROM totals QUALIFY position <= 2""")
def focus_topics_fallback(spark: SparkSession, sf: str) -> DataFrame:
    counts = topic_party_emotions(posts(spark, sf))
    some = focus_topics(counts, ["none", "P", "F"], 2).withColumn("run", F.lit("some occur"))
    none = focus_topics(counts, ["none", "neither"], 2).withColumn("run", F.lit("none occurs"))
    return some.unionByName(none)


@query("""SELECT event_type AS topic, count(CASE WHEN value >= 5 THEN 'high' END) AS count
FROM events GROUP BY event_type ORDER BY 2 DESC, 1 LIMIT 4""")
def topic_totals_top4(spark: SparkSession, sf: str) -> DataFrame:
    long = table(spark, sf, "events").select(
        F.col("event_type").alias("topic"),
        F.when(F.col("value") >= 5, "high").alias("predicted_emotions"),
    )
    return busiest_topics(long, 4)


@query(f"""WITH {POSTS}, counts AS (
  SELECT topic, predicted_emotions AS label, count(*) AS n FROM posts GROUP BY ALL
), marked AS (
  SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY topic) < 0.2 AS small FROM counts
), folding AS (
  SELECT *, small AND count(*) FILTER (small) OVER (PARTITION BY topic) > 1 AS folds FROM marked
), folded AS (
  SELECT topic, CASE WHEN folds THEN 'Other' ELSE label END AS label, folds, sum(n)::BIGINT AS count
  FROM folding GROUP BY ALL
), totals AS (SELECT *, sum(count) OVER (PARTITION BY topic)::BIGINT AS total FROM folded
), tenths AS (SELECT *, (count * 2000 + total) // (total * 2) AS t FROM totals)
SELECT topic, label AS predicted_emotions, count, round(count::DOUBLE / total, 6) AS share,
  CASE WHEN count * 100 >= total * 5
       THEN (t // 10) || '.' || (t % 10) || '%' || chr(10) || '(' || count || ')' ELSE '' END AS text,
  row_number() OVER (PARTITION BY topic ORDER BY folds, count DESC, label)::INT AS position
FROM tenths""")
def topic_emotion_folded(spark: SparkSession, sf: str) -> DataFrame:
    counts = count_by(posts(spark, sf), ["topic", "predicted_emotions"])
    return _rounded(fold_small_shares(counts, "topic", cutoff=0.2), "share")


@query(f"""WITH {POSTS}, counts AS (
  SELECT political_side, predicted_emotions, count(*) AS count FROM posts GROUP BY ALL)
SELECT political_side, predicted_emotions, count,
  row_number() OVER (PARTITION BY political_side ORDER BY count DESC, predicted_emotions)::INT AS rank
FROM counts QUALIFY rank <= 2""")
def side_emotion_top(spark: SparkSession, sf: str) -> DataFrame:
    return top_counts(side_emotions(posts(spark, sf)), "political_side", n=2)


@query("""SELECT o_custkey AS "Author", o_orderpriority AS predicted_emotions, count(*) AS count,
  round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY o_custkey), 6) AS percentage
FROM orders GROUP BY 1, 2""")
def author_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(profile(bare_posts(spark, sf)), "percentage")


@query("""WITH dim AS (
  SELECT nullif(c_custkey, 5) AS k, c_mktsegment AS party FROM customer
  WHERE c_acctbal >= 0 OR c_custkey = 5)
SELECT o_orderkey AS "ID", nullif(o_custkey, 7) AS "Author", party
FROM orders LEFT JOIN dim ON nullif(o_custkey, 7) IS NOT DISTINCT FROM k""")
def author_dimension_join(spark: SparkSession, sf: str) -> DataFrame:
    # Some authors are unknown, and a missing author is an author like any other.
    dimension = table(spark, sf, "customer").filter(
        (F.col("c_acctbal") >= 0) | (F.col("c_custkey") == 5)
    ).select(F.nullif("c_custkey", F.lit(5)).alias("Author"), F.col("c_mktsegment").alias("party"))
    facts = bare_posts(spark, sf).select("ID", F.nullif("Author", F.lit(7)).alias("Author"))
    return dimension_join(facts, dimension, "Author", null_keys_match=True)


@query(f"""WITH {POSTS}, debtors AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
SELECT 'all' AS kind, party, count(*) AS count FROM posts GROUP BY party
UNION ALL SELECT 'member', party, count(*) FROM posts WHERE "Author" IN (FROM debtors) GROUP BY party
UNION ALL SELECT 'other', party, count(*) FROM posts WHERE "Author" NOT IN (FROM debtors) GROUP BY party""")
def joins_without_broadcast(spark: SparkSession, sf: str) -> DataFrame:
    """The joins for tables too long to broadcast, forced by a limit of zero.

    With so few authors in the tables every key is hot at the usual limit; this one
    leaves some on either side.
    """
    people = authors(spark, sf)
    limits = {"max_bytes": 0, "hot_parts": people.count()}
    joined = dimension_join(bare_posts(spark, sf), people, "Author", **limits)
    debtors = table(spark, sf, "customer").filter(F.col("c_acctbal") < 0).select(
        F.col("c_custkey").alias("Author")
    )
    parts = {
        "all": joined,
        "member": keep_matching(joined, debtors, "Author", **limits),
        "other": drop_matching(joined, debtors, "Author", **limits),
    }
    counted = [
        part.groupBy("party").count().withColumn("kind", F.lit(kind)) for kind, part in parts.items()
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query(f"""WITH {POSTS}, parts AS (
  SELECT "ID", predicted_emotions || ', ' || lower(topic) || ',' AS list FROM posts
), long AS (SELECT "ID", trim(unnest(string_split(list, ','))) AS e FROM parts)
SELECT "ID", upper(e[1]) || lower(e[2:]) AS predicted_emotions FROM long WHERE e <> ''""")
def list_explode_capitalize(spark: SparkSession, sf: str) -> DataFrame:
    lists = F.concat("predicted_emotions", F.lit(", "), F.lower("topic"), F.lit(","))
    listed = bare_posts(spark, sf).withColumn("predicted_emotions", lists)
    return explode_labels(listed).select("ID", "predicted_emotions")


@query("""SELECT o_orderpriority AS predicted_emotions, count(*) AS count
FROM orders GROUP BY 1 ORDER BY 2 DESC, 1""")
def value_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return distribution_of(bare_posts(spark, sf), "predicted_emotions")


@query("""WITH lists AS (
  SELECT CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority || ',' || o_orderstatus END AS l FROM orders
), long AS (SELECT unnest(string_split(l, ',')) AS predicted_emotions FROM lists)
SELECT predicted_emotions, count(*) AS count FROM long GROUP BY 1""")
def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    lists = F.when(F.col("topic") == "P", F.array().cast("array<string>")).otherwise(
        F.array("predicted_emotions", "topic")
    )
    return distribution_of_labels(bare_posts(spark, sf).withColumn("predicted_emotions", lists))


@query("""WITH busy AS (SELECT o_custkey FROM orders GROUP BY 1),
known AS (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
SELECT 'common' AS kind, o_custkey AS "Author" FROM busy WHERE o_custkey IN (SELECT c_custkey FROM known)
UNION ALL
SELECT 'missing', o_custkey FROM busy WHERE o_custkey NOT IN (SELECT c_custkey FROM known)""")
def value_sets(spark: SparkSession, sf: str) -> DataFrame:
    busy = distinct_values(bare_posts(spark, sf), "Author")
    known = table(spark, sf, "customer").filter(F.col("c_acctbal") >= 0).select(
        F.col("c_custkey").alias("Author")
    )
    common = common_values(busy, known).withColumn("kind", F.lit("common"))
    return common.unionByName(missing_values(busy, known).withColumn("kind", F.lit("missing")))


@query("""SELECT user_id AS "Author", event_id AS "ID" FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10""")
def cap_per_author(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("Author"), F.col("event_id").alias("ID"), "ts"
    )
    return cap(events, 10).select("Author", "ID")


@query(r"""WITH flags AS (
  SELECT contains(lower(text), 'tion the') OR contains(lower(text), 'elle') AS announced,
    len(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda x: x <> '')) >= 100 AS long
  FROM documents)
SELECT 1 AS stage, 'announcements' AS name, count(*) FILTER (announced) AS removed,
       count(*) FILTER (NOT announced) AS kept FROM flags
UNION ALL
SELECT 2, 'short texts', count(*) FILTER (NOT announced AND NOT long),
       count(*) FILTER (NOT announced AND long) FROM flags""")
def stage_counts(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return count_stages(documents(spark, sf, "doc_id", "text"), {
        "announcements": ~mentions_any(text, ["tion the", "elle", "une elle"]),
        "short texts": has_words(text, 100),
    })


@query("""SELECT DISTINCT upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS name FROM customer""")
def capitalized_names(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "customer").select(capitalize(F.col("c_mktsegment")).alias("name"))
    return distinct_values(names, "name")
