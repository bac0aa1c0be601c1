"""Topics by word list and by prototype, and the parsing of topic lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affectframe.constants import TOPICS
from affectframe.functions.scores import best, label_or_uncertain, lookup
from affectframe.operators.nearest import nearest_prototypes
from affectframe.operators.topics import label_topics, parse_topics
from affectframe.queries.models import _VECTORS, _vector_scores
from affectframe.queries.registry import documents, query, table

# Words of the invented prose, grouped as if they were topics.
LEXICON = {
    "ekonomi": {"the": 1.0, "of": 2.0, "and": 1.0, "there": 3.0},
    "dış politika": {"le": 1.0, "une": 1.0, "elle": 2.0},
    "spor": {"der": 1.0, "die": 1.0, "und": 1.0},
    "afet": {"el": 1.0, "los": 1.0, "por": 1.0, "que": 1.5},
}


def _matched_sql(words: dict) -> str:
    hits = " + ".join(f"{w} * list_contains(words, '{word}')::INT" for word, w in words.items())
    return f"({hits})::DOUBLE / {sum(words.values())}"


_TOPIC_SCORES = r"""scores AS (SELECT doc_id, """ + ", ".join(
    f"{_matched_sql(words)} AS s{i}" for i, words in enumerate(LEXICON.values())
) + r""" FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+') AS words FROM documents)),
best AS (SELECT *, greatest(s0, s1, s2, s3) AS top FROM scores)"""


@query(f"""WITH {_TOPIC_SCORES} SELECT doc_id, CASE WHEN top < 0.5 THEN 'uncertain'
  WHEN s0 = top THEN 'economy' WHEN s1 = top THEN 'foreign_policy' WHEN s2 = top THEN 'sports' ELSE 'disaster' END AS topic
FROM best""")
def topic_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    return label_topics(documents(spark, sf, "doc_id", "text"), "text", lexicon=LEXICON).select("doc_id", "topic")


@query(f"""WITH {_VECTORS} SELECT vec_id, CASE WHEN score < 0.35 THEN 'uncertain' ELSE 'topic ' || label END AS topic,
  round(score, 6) AS score FROM probabilities WHERE place = 1""")
def topic_prototype(spark: SparkSession, sf: str) -> DataFrame:
    names = {str(i): f"topic {i}" for i in range(10)}
    return _vector_scores(spark, sf).select(
        "vec_id",
        label_or_uncertain(F.col("scores"), names, 0.35).alias("topic"),
        F.round(best(F.col("scores"))["score"], 6).alias("score"),
    )


@query("""SELECT name, code, count(o_orderkey) AS posts FROM
  (VALUES ('göç', 'migration', 'F'), ('dış politika', 'foreign_policy', 'O'), ('sağlık', 'health', 'P')) t(name, code, status)
  LEFT JOIN orders ON o_orderstatus = status GROUP BY ALL""")
def topic_list_parse(spark: SparkSession, sf: str) -> DataFrame:
    """A user's list of topics, with the posts of each: statuses stand for topics."""
    accepted, _rejected = parse_topics(["GÖÇ,", "foreign_policy ,weather,", "health"])
    status = {"F": "göç", "O": "dış politika", "P": "sağlık"}
    named = table(spark, sf, "orders").select(lookup(F.col("o_orderstatus"), status).alias("name"))
    wanted = named.filter(F.col("name").isin(accepted))
    counts = wanted.groupBy("name").agg(F.count("*").alias("posts"))
    return counts.select("name", lookup(F.col("name"), TOPICS, "uncertain").alias("code"), "posts")


@query("""SELECT o_orderstatus AS status, CASE o_orderstatus WHEN 'F' THEN 'migration' ELSE 'uncertain' END AS topic,
  count(*) AS count FROM orders GROUP BY ALL""")
def topic_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    native = F.when(F.col("o_orderstatus") == "F", "göç").when(F.col("o_orderstatus") == "O", "unheard of")
    coded = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("status"), lookup(native, TOPICS, "uncertain").alias("topic")
    )
    return coded.groupBy("status", "topic").count()


_PAIRS = 8


@query(f"""WITH means AS (
  SELECT a.vec_id * {_PAIRS} + b.vec_id - a.vec_id - 1 AS label,
         list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE + p[2]::DOUBLE) / 2) AS v
  FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + {_PAIRS}),
cosines AS (SELECT vec_id, m.label, list_cosine_similarity(embedding::DOUBLE[], v) AS score FROM embeddings e, means m)
SELECT vec_id, label, round(score, 6) AS score FROM cosines
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) = 1""")
def topic_prototype_many(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest of several prototypes for each vector: the means of vectors with neighbouring ids."""
    vectors = table(spark, sf, "embeddings")
    steps = F.explode(F.sequence(F.lit(1), F.lit(_PAIRS))).alias("step")
    first = vectors.select("vec_id", "embedding", steps).withColumn("other", F.col("vec_id") + F.col("step"))
    second = vectors.select(F.col("vec_id").alias("other"), F.col("embedding").alias("beside"))
    mean = F.zip_with("embedding", "beside", lambda x, y: (x.cast("double") + y.cast("double")) / 2)
    means = first.join(second, "other").select(
        (F.col("vec_id") * _PAIRS + F.col("step") - 1).alias("label"), mean.alias("prototype")
    )
    found = nearest_prototypes(vectors, "vec_id", "embedding", means)
    return found.withColumn("score", F.round("score", 6))
