"""Topic scores without training: by a word list, or by the nearest label prototype."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affectframe.constants import MAX_CLASSES, TOPIC_THRESHOLD, TOPICS
from affectframe.functions.once import bind
from affectframe.functions.scores import label_or_uncertain
from affectframe.functions.text import tokens
from affectframe.operators.dedupe import drop_repeated
from affectframe.operators.joins import join_on_key
from affectframe.session import new_dir

# Up to so many entries a lexicon is a part of the expression; beyond, it is a table.
MAX_LITERALS = 10_000
# Weights are whole numbers of these parts. As doubles their sums are exact, in any order.
UNIT = 1_000_000_000


def _parts(weight: float) -> float:
    return float(round(weight * UNIT))


def _whole(words: Mapping[str, float]) -> float:
    return sum(map(_parts, words.values()), 0.0)


def parse_topics(
    arguments: Iterable[str] | None, names: Mapping[str, str] = TOPICS
) -> tuple[list[str], list[str]]:
    """Topics (native names) and rejected entries of a user's comma-separated list.

    An entry is a topic's native name or its code, in any case. Without a valid entry
    all topics are meant.
    """
    alias = {spelling: name for name, code in names.items() for spelling in (code, name)}
    given = list(arguments or ())
    entries = [entry.strip().lower() for entry in " ".join(given).split(",")] if given else []
    topics = [alias[entry] for entry in entries if entry in alias]
    return topics or list(names), [entry for entry in entries if entry not in alias]


def label_lexicon(labels: Iterable[str]) -> dict[str, dict[str, float]]:
    """The lexicon in which every label is described by the words of its own name."""
    return {label: {word: 1.0 for word in label.lower().split()} for label in labels}


def lexicon_scores(text: Column, lexicon: Mapping[str, Mapping[str, float]]) -> Column:
    """Score vector over the lexicon's topics: the weight of the topic's words that
    occur in the text, as a part of the topic's whole weight.

    Row by row: the text's words are looked up in the set of all words of the lexicon,
    which is hashed once, and only the hits are looked at per topic. No word is exploded
    or shuffled.
    """
    vocabulary = sorted({word for words in lexicon.values() for word in words})
    hits = F.array_distinct(F.filter(tokens(text), lambda word: word.isin(vocabulary)))
    topics = F.array(*[
        F.struct(
            F.lit(i).alias("idx"),
            F.lit(topic).alias("label"),
            F.lit(_whole(words)).alias("whole"),
            F.array(*[
                F.struct(F.lit(word).alias("word"), F.lit(_parts(weight)).alias("weight"))
                for word, weight in words.items()
            ]).alias("words"),
        )
        for i, (topic, words) in enumerate(lexicon.items())
    ])

    def scored(found: Column) -> Column:
        def one(topic: Column) -> Column:
            matched = F.aggregate(
                topic["words"],
                F.lit(0.0),
                lambda acc, w: acc + F.when(F.array_contains(found, w["word"]), w["weight"]).otherwise(F.lit(0.0)),
            )
            return F.struct(
                topic["idx"].alias("idx"),
                topic["label"].alias("label"),
                (matched / topic["whole"]).alias("score"),
            )

        return F.transform(topics, one)

    return bind(hits, scored)


def lexicon_table(spark: SparkSession, lexicon: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """``token, idx, weight`` of a lexicon of any size, weights in whole parts; ``idx`` is the topic's place."""
    rows = [(word, i, _parts(w)) for i, words in enumerate(lexicon.values()) for word, w in words.items()]
    return spark.createDataFrame(rows, "token string, idx int, weight double")


def lexicon_scores_by_join(
    posts: DataFrame, text: str, lexicon: Mapping[str, Mapping[str, float]]
) -> DataFrame:
    """The posts with ``scores`` as :func:`lexicon_scores` has them, for lexicons of any size.

    Each different text is looked at once: its different words meet the table of the
    lexicon, and the weights are added up per text and topic.
    """
    spark = posts.sparkSession
    keyed = posts.withColumn("_text", F.md5(F.coalesce(F.col(text), F.lit(""))))
    words = drop_repeated(keyed.select("_text", F.col(text).alias("_body")), "_text").select(
        "_text", F.explode(F.array_distinct(tokens(F.col("_body")))).alias("token")
    )
    listed = lexicon_table(spark, lexicon)
    found = join_on_key(words, listed, "token", "inner")
    matched = found.groupBy("_text", "idx").agg(F.sum("weight").alias("weight"))
    by_text = matched.groupBy("_text").agg(F.map_from_entries(F.collect_list(F.struct("idx", "weight"))).alias("_found"))
    path = new_dir(spark, "topics")
    by_text.write.parquet(path)
    rows = join_on_key(keyed, spark.read.parquet(path), "_text", "left")
    scores = F.array(*[
        F.struct(
            F.lit(i).alias("idx"), F.lit(topic).alias("label"),
            (F.coalesce(F.col("_found")[i], F.lit(0.0)) / F.lit(_whole(words))).alias("score"),
        )
        for i, (topic, words) in enumerate(lexicon.items())
    ])
    return rows.withColumn("scores", scores).drop("_text", "_found")


def label_topics(
    posts: DataFrame,
    text: str = "Text",
    *,
    lexicon: Mapping[str, Mapping[str, float]] | None = None,
    topics: Sequence[str] | None = None,
    names: Mapping[str, str] | None = TOPICS,
    threshold: float = TOPIC_THRESHOLD,
    column: str = "topic",
) -> DataFrame:
    """Add the topic of each post, ``uncertain`` where no score reaches the threshold."""
    lexicon = dict(lexicon or label_lexicon(topics or TOPICS))
    if topics is not None:
        lexicon = {topic: lexicon[topic] for topic in topics if topic in lexicon}
    if sum(map(len, lexicon.values())) > MAX_LITERALS:
        scored = lexicon_scores_by_join(posts, text, lexicon)
        return scored.withColumn(column, label_or_uncertain(F.col("scores"), names, threshold)).drop("scores")
    scores = lexicon_scores(F.col(text), lexicon)
    return posts.withColumn(column, label_or_uncertain(scores, names, threshold))


def prototypes(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector of each label, as ``label, prototype array<double>``.

    The vectors' length is looked up first; vectors of different lengths are refused. One
    average per coordinate: partial sums are built in the map tasks, and one row per task
    and label is shuffled.
    """
    rows = vectors.na.drop(subset=[label, vector])
    least, size = rows.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if least != size:
        raise ValueError(f"vectors of {least} to {size} numbers in column {vector!r}")
    means = [F.avg(F.col(vector)[i].cast("double")) for i in range(size or 0)]
    return rows.groupBy(F.col(label).alias("label")).agg(F.array(*means).alias("prototype"))


def _dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def prototype_scores(vectors: DataFrame, vector: str, means: DataFrame) -> DataFrame:
    """Add ``scores``: the cosine of each vector with every label's prototype.

    ``means`` has one row per label. They are counted, then gathered into one value of
    the plan, so each vector is compared where it is and emits one row.
    """
    if means.count() > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} prototypes")
    listed = F.sort_array(F.collect_list(F.struct("label", "prototype")))
    unit = F.transform(listed, lambda m: F.struct(
        m["label"].cast("string").alias("label"),
        m["prototype"].alias("v"),
        F.sqrt(_dot(m["prototype"], m["prototype"])).alias("norm"),
    ))
    listing = vectors.withColumn("_means", means.agg(unit.alias("means")).scalar())

    def compare(norm: Column) -> Column:
        return F.transform("_means", lambda m, i: F.struct(
            i.alias("idx"),
            m["label"].alias("label"),
            (_dot(F.col(vector), m["v"]) / (norm * m["norm"])).alias("score"),
        ))

    norm = F.sqrt(_dot(F.col(vector), F.col(vector)))
    return listing.withColumn("scores", bind(norm, compare)).drop("_means")


