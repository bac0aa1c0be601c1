"""Text classifier: multinomial naive Bayes over words.

Training is a word count per label. Weights are logarithms held as whole numbers
(billionths), so that sums do not depend on the order in which tasks add them up:
scores are the same for any partitioning, and after any retry.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affectframe.constants import BROADCAST_BYTES
from affectframe.functions.scores import best, score_vector, softmax
from affectframe.functions.text import is_blank, tokens
from affectframe.operators.ranking import top_n_per_group
from affectframe.operators.split import class_counts
from affectframe.operators.wordcounts import posts_of_words, words_of_posts
from affectframe.session import new_dir
from affectframe.tables import is_bounded, row_bytes

UNIT = 1_000_000_000
# If a model is too large to be broadcast, its words with at least 1/HEAD of all
# occurrences in the training posts still are: there are at most HEAD of them, together no
# longer than HEAD words of average length. So are the next ones, as long as there is room.
HEAD = 100_000
# Words that are not broadcast move as a row of each post if they are no more than 1/RARE
# of all occurrences in the training posts.
RARE = 20
# Stands for the post itself among the counted words; no word contains a space.
_POST = " "


@dataclass(frozen=True)
class BayesModel:
    """Labels with their numbers of training posts, and one row of weights per word.

    ``weights``: ``token string, n bigint, w array<bigint>``; ``n`` counts the word in
    the training posts, ``w[i]`` is the log-probability of the word under label i.
    """

    labels: tuple
    docs: tuple[int, ...]
    weights: DataFrame

    @property
    def priors(self) -> tuple[int, ...]:
        total = sum(self.docs)
        return tuple(round(math.log(n / total) * UNIT) for n in self.docs)


def load(spark: SparkSession, path: str) -> BayesModel:
    """A trained model from its folder."""
    counts = spark.read.parquet(f"{path}/counts")
    docs = class_counts(counts.filter(F.col("token") == _POST), "label", weight=F.col("count"))
    return BayesModel(tuple(docs), tuple(docs.values()), spark.read.parquet(f"{path}/weights"))


def words(posts: DataFrame, text: str, *carried: Column | str) -> DataFrame:
    """One row per word of each post, with the carried columns."""
    return posts.select(*carried, F.explode(tokens(F.col(text))).alias("token")).filter(
        F.col("token") != ""
    )


def train(
    posts: DataFrame, text: str, label: str, alpha: float = 1.0, path: str | None = None
) -> BayesModel:
    """Train with additive smoothing and store the model below ``path`` (or in a new
    folder of the shared one).

    The texts are read once, to count words per label. Counts are added up in the map
    tasks, so a frequent word sends one row per task and label, not one per occurrence.
    Everything else is worked out from the table of counts.
    """
    spark = posts.sparkSession
    path = path or new_dir(spark, "model")
    # One more word at the end of every post counts the posts in the same pass.
    listed = F.array_append(tokens(F.col(text)), F.lit(_POST))
    counted = posts.na.drop(subset=[text, label]).select(
        F.col(label).alias("label"), F.explode(listed).alias("token")
    ).filter(F.col("token") != "")
    counted.groupBy("label", "token").count().write.mode("overwrite").parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    docs = class_counts(counts.filter(F.col("token") == _POST), "label", weight=F.col("count"))
    labels = list(docs)

    per_word = counts.filter(F.col("token") != _POST).groupBy("token").agg(*[
        F.sum(F.when(F.col("label") == name, F.col("count")).otherwise(0)).alias(f"n{i}")
        for i, name in enumerate(labels)
    ])
    columns = [F.col(f"n{i}") for i in range(len(labels))]
    totals = per_word.agg(F.struct(
        F.count("*").alias("vocabulary"), *[F.sum(c).alias(f"t{i}") for i, c in enumerate(columns)]
    ).alias("totals")).scalar()

    def weight(i: int) -> Column:
        whole = F.col(f"_totals.t{i}") + F.col("_totals.vocabulary") * alpha
        return F.round(F.ln((columns[i] + alpha) / whole) * UNIT).cast("bigint")

    weights = per_word.withColumn("_totals", totals).select(
        "token",
        sum(columns[1:], columns[0]).alias("n"),
        F.array(*[weight(i) for i in range(len(labels))]).alias("w"),
    )
    weights.write.mode("overwrite").parquet(f"{path}/weights")
    return BayesModel(tuple(docs), tuple(docs.values()), spark.read.parquet(f"{path}/weights"))


def _least_hot(table: DataFrame, max_bytes: int, head: int) -> int:
    """How often a word has to occur to be broadcast, if not all words can be."""
    place = F.floor(F.log2("n") * 4).alias("place")
    # Of the logarithm of a long there are few places.
    bins = table.groupBy(place).agg(
        F.min("n").alias("least"), F.sum("n").alias("uses"), F.sum(row_bytes(table)).alias("bytes")
    ).orderBy(F.desc("place")).collect()
    least, used = -(-sum(row.uses for row in bins) // head), 0
    for row in bins:
        used += row.bytes
        if used > max_bytes:
            break
        least = min(least, row.least)
    return least


def _parted(table: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """A table of words that cannot be broadcast as a whole: frequent words, to be broadcast, and the others."""
    is_hot = F.col("n") >= least
    return F.broadcast(table.filter(is_hot)), table.filter(~is_hot).hint("merge")


def _with_words(rows: DataFrame, table: DataFrame, *, max_bytes: int, head: int) -> DataFrame:
    """Inner join of rows that have a token with a table of words.

    If the table cannot be broadcast, its frequent words are, and the rows with them stay
    where they are. Rows with other words are joined by a shuffle.
    """
    if is_bounded(table, max_bytes):
        return rows.join(F.broadcast(table), "token")
    hot, cold = _parted(table, _least_hot(table, max_bytes, head))
    return rows.join(hot, "token").unionByName(rows.join(hot, "token", "left_anti").join(cold, "token"))


def _word_sums(
    posts: DataFrame, text: str, model: BayesModel, keys: Sequence[str], *, max_bytes: int, head: int
) -> DataFrame:
    """Sum of the weights of each post's words, per label in ``s0..``; the last key is ``_blank``.

    Words the model does not know add nothing.
    """
    k = len(model.labels)

    def sums(value) -> list[Column]:
        return [F.coalesce(F.sum(value(i)), F.lit(0)).alias(f"s{i}") for i in range(k)]

    weights = model.weights.select("token", "n", "w")
    # One row per word, and at least one per post; empty strings become null tokens.
    rows = posts.select(*keys, F.explode_outer(tokens(F.col(text))).alias("token")).withColumn(
        "token", F.nullif("token", F.lit(""))
    )
    if is_bounded(weights, max_bytes):
        # With a broadcast model a post's words are still in one task here: its partial sum
        # is one row in the shuffle.
        weighted = rows.join(F.broadcast(weights.drop("n")), "token", "left")
        return weighted.groupBy(*keys).agg(*sums(lambda i: F.col("w")[i]))
    least = _least_hot(weights, max_bytes, head)
    uses = weights.agg(F.sum("n"), F.sum(F.when(F.col("n") < least, F.col("n")))).first()
    if (uses[1] or 0) * RARE <= (uses[0] or 0):
        hot, cold = _parted(weights, least)
        # Frequent words are added up where they are, to one row per post without a token; other
        # words are counted by post. So texts are split once, and each word moves as one row.
        near = rows.join(hot, "token", "left").withColumn("token", F.when(F.col("n").isNull(), F.col("token")))
        near = near.groupBy(*keys, "token").agg(*sums(lambda i: F.col("w")[i]), F.count("*").alias("_tf"))
        # Rows without a token have no partner: they get keys that are no words, dealt out evenly.
        spare = F.concat(F.lit(" "), F.xxhash64(*keys).cast("string"))
        near = near.withColumn("token", F.coalesce("token", spare))
        known = near.join(cold.withColumnRenamed("n", "_n"), "token", "left")
        return known.groupBy(*keys).agg(*sums(
            lambda i: F.col(f"s{i}") + F.coalesce(F.col("w")[i] * F.col("_tf"), F.lit(0))
        ))
    # Many words move. They come once with all posts of a slice that hold them, and are stored
    # so: texts are split once, and a word moves as one row of its slice, not as one of each post.
    path, named = new_dir(posts.sparkSession, "posts-of-words"), list(keys[:-1])
    held = posts_of_words(posts, text, named)
    held.write.parquet(path)
    held = posts.sparkSession.read.schema(held.schema).parquet(path)
    known = _with_words(held, weights, max_bytes=0, head=head)
    each = known.select("w", F.explode(F.arrays_zip(*[F.col(f"`{x}`") for x in [*named, "tf"]])).alias("_post"))
    added = each.select(
        *[F.col("_post")[x].alias(x) for x in named], F.lit(False).alias("_blank"),
        *[(F.col("w")[i] * F.col("_post")["tf"]).alias(f"s{i}") for i in range(k)],
    )
    # Posts without a known word have a row as well. A post with a word is not blank.
    nothing = posts.select(*keys, *[F.lit(0).cast("bigint").alias(f"s{i}") for i in range(k)])
    return nothing.unionByName(added).groupBy(*keys).agg(*sums(lambda i: F.col(f"s{i}")))


def score(
    model: BayesModel,
    posts: DataFrame,
    text: str,
    id: str,
    carry: Sequence[str] = (),
    *,
    max_bytes: int = BROADCAST_BYTES,
    head: int = HEAD,
) -> DataFrame:
    """Each post's ID, carried columns and ``scores``: log scores in label order.

    Posts need an ID each. ``carry`` names narrow columns that depend on the ID. A missing or blank text has
    an empty score vector. The model is measured to choose the join.
    """
    keys = [id, *carry, "_blank"]
    marked = posts.withColumn("_blank", is_blank(F.col(text)))
    sums = _word_sums(marked, text, model, keys, max_bytes=max_bytes, head=head)
    values = [
        (F.col(f"s{i}") + F.lit(prior)) / UNIT for i, prior in enumerate(model.priors)
    ]
    vector = score_vector([str(name) for name in model.labels], values)
    empty = F.array().cast("array<struct<idx:int,label:string,score:double>>")
    return sums.select(
        id, *carry, F.when(F.col("_blank"), empty).otherwise(vector).alias("scores")
    )


def predict(
    model: BayesModel, posts: DataFrame, text: str, id: str, carry: Sequence[str] = (), **options
) -> DataFrame:
    """Scores, probabilities and the best label of each post (null for a blank text)."""
    scored = score(model, posts, text, id, carry, **options)
    return scored.withColumns({
        "probabilities": softmax(F.col("scores")), "pred": best(F.col("scores"))["label"]
    })


def _centred(model: BayesModel) -> DataFrame:
    """Per word: ``c``, the weights minus their mean over the labels, and its mean count."""
    k = len(model.labels)
    total = sum((F.col("w")[i] for i in range(1, k)), F.col("w")[0])
    centred = F.array(*[(F.col("w")[i] * k - total) / (k * UNIT) for i in range(k)])
    mean_count = F.col("n") / F.lit(sum(model.docs))
    return model.weights.select("token", "n", centred.alias("c"), mean_count.alias("expected"))


def _counts(posts: DataFrame, text: str, keys: Sequence[str], max_bytes: int) -> DataFrame:
    """``token, tf`` by the posts' keys. Only posts that share their keys with others have to meet to be counted."""
    spark, path = posts.sparkSession, new_dir(posts.sparkSession, "shared-keys")
    shared = posts.select(*keys).groupBy(*keys).agg(F.count("*").alias("_posts")).filter(F.col("_posts") > 1)
    shared.write.parquet(path)
    shared = spark.read.schema(shared.schema).parquet(path)

    def counted(part: DataFrame) -> DataFrame:
        return words_of_posts(part, text, keys)

    def merged(part: DataFrame) -> DataFrame:
        return counted(part).groupBy(*keys, "token").agg(F.sum("tf").alias("tf"))

    if shared.isEmpty():
        return counted(posts)
    if not is_bounded(shared, max_bytes):
        return merged(posts)
    named = F.broadcast(shared.select(*[F.col(k).alias(f"_shared_{i}") for i, k in enumerate(keys)]))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_shared_{i}")) for i, k in enumerate(keys)])
    return counted(posts.join(named, same, "left_anti")).unionByName(merged(posts.join(named, same, "left_semi")))


def explain(
    model: BayesModel,
    posts: DataFrame,
    text: str,
    id: str,
    carry: Sequence[str] = (),
    *,
    max_bytes: int = BROADCAST_BYTES,
    head: int = HEAD,
) -> DataFrame:
    """What each word of a post adds to the score of every label.

    The score is linear in the word counts, so the contribution of a word is exactly
    its weight times the excess of its count over the mean count of the training
    posts (the additive attribution of a linear model). Weights and scores are taken
    relative to their mean over the labels: what counts is how a word tells them apart.

    Rows: ``token, tf, phi`` with ``phi array<double>`` in label order, and one row
    per post with a null token for all the words that it lacks. A post's ``phi`` and
    the :func:`base_values` add up to its centred scores.
    """
    k, keys = len(model.labels), [id, *carry]
    spark, path = posts.sparkSession, new_dir(posts.sparkSession, "post-words")
    counts = _counts(posts, text, keys, max_bytes)
    # Stored, as they are joined with several parts of the model, for two results.
    counts.write.parquet(path)
    counts = spark.read.schema(counts.schema).parquet(path)
    known = _with_words(counts, _centred(model), max_bytes=max_bytes, head=head)
    present = known.select(
        *keys, "token", "tf",
        F.transform("c", lambda c: c * (F.col("tf") - F.col("expected"))).alias("phi"),
    )
    # A post lacks all but its own words: the sum over the vocabulary less its part.
    expected = [F.col("c")[i] * F.col("expected") for i in range(k)]
    own = known.select(*keys, *[e.alias(f"e{i}") for i, e in enumerate(expected)])
    nothing = posts.select(*keys, *[F.lit(0.0).alias(f"e{i}") for i in range(k)])
    whole = _vocabulary_sums(model)
    absent = (
        nothing.unionByName(own)
        .groupBy(*keys)
        .agg(*[F.sum(f"e{i}").alias(f"e{i}") for i in range(k)])
        .withColumn("_whole", whole)
        .select(
            *keys,
            F.lit(None).cast("string").alias("token"),
            F.lit(0).cast("bigint").alias("tf"),
            F.array(*[F.col(f"e{i}") - F.col("_whole")[i] for i in range(k)]).alias("phi"),
        )
    )
    return present.unionByName(absent)


def _vocabulary_sums(model: BayesModel) -> Column:
    """Expected contribution of all words per label, as a scalar of the plan."""
    k = len(model.labels)
    sums = F.array(*[F.sum(F.col("c")[i] * F.col("expected")) for i in range(k)])
    return _centred(model).agg(sums.alias("sums")).scalar()


def base_values(model: BayesModel) -> DataFrame:
    """Mean centred score of each label over the training posts: ``idx, label, base``."""
    k = len(model.labels)
    mean = sum(model.priors) / k
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("idx"), F.lit(str(name)).alias("label"),
            (F.sum(F.col("c")[i] * F.col("expected")) + F.lit((prior - mean) / UNIT)).alias("base"),
        )
        for i, (name, prior) in enumerate(zip(model.labels, model.priors))
    ])
    return _centred(model).agg(rows.alias("rows")).select(F.inline("rows"))


def trigger_words(
    model: BayesModel,
    posts: DataFrame,
    text: str,
    label: str,
    n: int = 10,
    *,
    counts: DataFrame | None = None,
    max_bytes: int = BROADCAST_BYTES,
    head: int = HEAD,
) -> DataFrame:
    """The n words of each label that add most to its score, on average over its posts.

    The mean contribution depends on how often the label's posts use the word, and
    on nothing else of single posts: words are counted per label first, and only
    those counts meet the model. For the training posts and their labels, pass the
    ``counts`` that :func:`train` has stored, and no post is read.
    """
    if counts is None:
        posts = posts.na.drop(subset=[text, label])
        sizes = class_counts(posts, label)
        counts = (
            words(posts, text, F.col(label).alias("label"))
            .groupBy("label", "token").agg(F.count("*").alias("uses"))
        )
    else:
        sizes = class_counts(counts.filter(F.col("token") == _POST), "label", weight=F.col("count"))
        counts = counts.filter(F.col("token") != _POST).withColumnRenamed("count", "uses")
    place = {name: i for i, name in enumerate(model.labels)}
    known = _with_words(counts, _centred(model), max_bytes=max_bytes, head=head)
    phi = F.coalesce(*[
        F.when(
            F.col("label") == name,
            F.col("c")[place[name]] * (F.col("uses") / F.lit(size) - F.col("expected")),
        )
        for name, size in sizes.items()
        if name in place
    ])
    scored = known.select("label", "token", "uses", F.round(phi, 9).alias("mean_phi"))
    order = [F.desc("mean_phi"), F.asc("token")]
    return top_n_per_group(
        scored.na.drop(subset=["mean_phi"]), "label", order, n, spread="token"
    )
