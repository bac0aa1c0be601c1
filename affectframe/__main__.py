"""The jobs from a shell: ``python -m affectframe <job> …`` or through spark-submit.

Each job reads and writes tables at the given paths. Nothing is assumed about where
they are, other than that the whole cluster reaches them.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from affectframe import constants
from affectframe.operators.bayes import load
from affectframe.operators.counts import label_distribution, value_distribution
from affectframe.operators.topics import parse_topics
from affectframe.plans.analyse import analyse
from affectframe.plans.clean import clean_posts, removed_rows
from affectframe.plans.collect import collect_into, stored_posts
from affectframe.plans.explain import explain_examples
from affectframe.plans.label import add_emotions, add_topics, topic_samples
from affectframe.plans.train import train_and_evaluate
from affectframe.schemas import RAW_POSTS
from affectframe.session import get_spark
from affectframe.sources.readers import (
    read_authors,
    read_labelled,
    read_posts,
    read_training_set,
)
from affectframe.sources.writers import write_csv, write_label_map, write_table
from affectframe.streaming.ingest import ingest


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="affectframe", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name: str, text: str, *paths: str) -> argparse.ArgumentParser:
        sub = jobs.add_parser(name, help=text)
        for path in paths:
            sub.add_argument(path)
        return sub

    collect = job("collect", "keep eligible posts of landed files", "landing", "table")
    stream = job(
        "ingest", "the same as a stream, from where the last run stopped", "landing", "table", "checkpoint"
    )
    for sub in (collect, stream):
        sub.add_argument("--limit", type=int, help="newest posts of each author and run; all, if not given")
        sub.add_argument("--since", default=constants.COLLECT_FROM)
        sub.add_argument("--zone", default="UTC")
    clean = job("clean", "clean, filter and join posts with their authors", "posts", "authors", "out")
    clean.add_argument("--strict-emoji", action="store_true")
    clean.add_argument("--csv", action="store_true", help="posts are CSV files")
    clean.add_argument(
        "--report", action="store_true", help="tell how many posts the filters remove"
    )
    topics = job("topics", "add the topic of each post", "posts", "out")
    topics.add_argument("--topics", nargs="*", help="native names or codes, comma-separated")
    topics.add_argument("--lexicon", help="JSON file: topic -> word -> weight")
    train = job("train", "train and evaluate the emotion classifier", "training", "model")
    train.add_argument("--fraction", type=float, default=0.15)
    train.add_argument("--seed", type=int, default=42)
    emotions = job("emotions", "add the emotions of each post", "posts", "model", "out")
    emotions.add_argument("--threshold", type=float, default=constants.LABEL_THRESHOLD)
    emotions.add_argument("--max-labels", type=int, default=constants.MAX_LABELS)
    emotions.add_argument("--csv", help="write the posts as CSV to this folder, too")
    analysis = job("analyse", "all result tables of labelled posts", "posts", "out")
    analysis.add_argument("--event-date", default=constants.EVENT_DATE)
    analysis.add_argument("--event-months", type=int, default=2)
    analysis.add_argument("--event-parties", nargs="*", default=list(constants.EVENT_PARTIES))
    analysis.add_argument("--focus", nargs="*", default=list(constants.FOCUS_TOPICS))
    explain = job("explain", "word contributions for some posts of each emotion", "posts", "model", "out")
    explain.add_argument("--posts-per-label", type=int, default=5)
    return parser.parse_args(argv)


def _lexicon(spark: SparkSession, path: str | None) -> dict | None:
    return None if path is None else json.loads(spark.read.text(path, wholetext=True).first().value)


def _posts(spark: SparkSession, path: str) -> DataFrame:
    """Raw posts with their declared types, whatever their folders are called."""
    return stored_posts(spark, path).select(*RAW_POSTS.fieldNames())


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.job == "collect":
        collect_into(
            read_posts(spark, args.landing), args.table, since=args.since, zone=args.zone, per_author=args.limit
        )
    elif args.job == "ingest":
        ingest(
            spark, args.landing, args.table, args.checkpoint,
            since=args.since, zone=args.zone, per_author=args.limit,
        ).awaitTermination()
    elif args.job == "clean":
        posts = read_posts(spark, args.posts) if args.csv else _posts(spark, args.posts)
        authors = read_authors(spark, args.authors)
        seen = Observation() if args.report else None
        write_table(clean_posts(posts, authors, args.strict_emoji, seen=seen), args.out)
        for name, removed, kept in removed_rows(seen) if seen else ():
            print(f"{name}: {removed} removed, {kept} kept")
    elif args.job == "topics":
        accepted, rejected = parse_topics(args.topics)
        for entry in rejected:
            print(f"unknown topic skipped: {entry!r}")
        posts = add_topics(spark.read.parquet(args.posts), _lexicon(spark, args.lexicon), accepted)
        write_table(posts, args.out)
        labelled = spark.read.parquet(args.out)
        value_distribution(labelled, "topic").show(truncate=False)
        topic_samples(labelled).orderBy("heading", "ordinal").show(100, truncate=False)
    elif args.job == "train":
        # The training file has no IDs. Rows are told apart by their contents, so a seed
        # gives the same split however the file is read; equal rows share an ID.
        training = read_training_set(spark, args.training)
        result = train_and_evaluate(
            training.withColumn("id", F.md5(F.concat_ws("\u0000", "emotion", "text"))),
            fraction=args.fraction, seed=args.seed, path=args.model,
        )
        write_label_map(spark, f"{args.model}/label_map", [str(x) for x in result.model.labels])
        for table in (result.accuracy, result.report.orderBy("section", "class"), result.confusion):
            table.show(1000, truncate=False)
    elif args.job == "emotions":
        posts = spark.read.parquet(args.posts)
        labelled = add_emotions(
            posts, load(spark, args.model), threshold=args.threshold, max_labels=args.max_labels
        )
        write_table(labelled, args.out)
        stored = spark.read.parquet(args.out)
        if args.csv:
            write_csv(stored, args.csv)
        label_distribution(stored).show(truncate=False)
    elif args.job == "analyse":
        tables = analyse(
            read_labelled(spark, args.posts), focus=args.focus, event_date=args.event_date,
            event_months=args.event_months, event_parties=args.event_parties,
            path=f"{args.out}/cells",
        )
        for name, table in tables.items():
            write_table(table, f"{args.out}/{name}")
        for name in ("party_top3_lines", "topic_party_tops", "side_top3"):
            if name in tables:
                spark.read.parquet(f"{args.out}/{name}").show(1000, truncate=False)
    elif args.job == "explain":
        posts = spark.read.parquet(args.posts).withColumn(
            "predicted_emotions", F.array_join("predicted_emotions", ",")
        )
        rows = explain_examples(posts, load(spark, args.model), n=args.posts_per_label)
        write_table(rows, args.out)


def main(argv: list[str] | None = None) -> None:
    args = _arguments(argv)
    run(get_spark(f"affectframe {args.job}"), args)


if __name__ == "__main__":
    main()
