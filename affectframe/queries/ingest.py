"""Sources, sinks, unions, removal of copies, and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affectframe.constants import DATETIME_COLUMNS
from affectframe.functions.text import missing_to_null
from affectframe.functions.times import utc_instant
from affectframe.operators.dedupe import drop_repeated
from affectframe.operators.split import class_counts
from affectframe.plans.collect import collect_into, compact_table, rejected_posts, stored_posts
from affectframe.queries.registry import authors, query, table
from affectframe.schemas import RAW_POSTS, first_present, require_columns
from affectframe.session import new_dir
from affectframe.sources.readers import (
    read_authors,
    read_label_map,
    read_posts,
    read_training_set,
    text_column,
    union_sources as union,
)
from affectframe.sources.versions import published
from affectframe.sources.writers import append_posts, write_csv, write_label_map
from affectframe.streaming import ingest as streaming


@query("""SELECT 'document' AS kind, count(*) AS rows, count(lang) AS with_language, sum(length(text))::BIGINT AS characters FROM documents
UNION ALL SELECT 'benchmark', count(*), 0, sum(length(text))::BIGINT FROM benchmark
UNION ALL SELECT 'conversation', count(*), 0, sum(length(text))::BIGINT FROM conversations""")
def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    frames = [
        table(spark, sf, "documents").select(F.lit("document").alias("kind"), "text", "lang"),
        table(spark, sf, "benchmark").select("text", F.lit("benchmark").alias("kind")),
        table(spark, sf, "conversations").select(F.lit("conversation").alias("kind"), "text"),
    ]
    return union(frames).groupBy("kind").agg(
        F.count("*").alias("rows"),
        F.count("lang").alias("with_language"),
        F.sum(F.length("text")).alias("characters"),
    )


@query("SELECT event_id, event_type, value FROM events")
def dedupe_by_id(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    return drop_repeated(union([events, events]), "event_id")


@query("SELECT event_id, event_type, value FROM events")
def dedupe_many_copies(spark: SparkSession, sf: str) -> DataFrame:
    """The same where the repeated keys are too many to be broadcast."""
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    return drop_repeated(union([events, events, events]), "event_id", max_bytes=0)


@query("""SELECT doc_id AS "ID", 'author ' || source AS "Author", '"' || text || '", they' || chr(10) || 'said' AS "Text",
  CASE lang WHEN 'en' THEN 'NA' ELSE lang END AS "Date", c_mktsegment AS party
FROM documents LEFT JOIN customer ON 'author src' || c_custkey = 'author ' || source""")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Posts as CSV with quotes, commas and line breaks, and a dimension beside them."""
    folder = new_dir(spark, "landing")
    posts = table(spark, sf, "documents").select(
        F.col("doc_id").alias("ID"),
        F.concat(F.lit("author "), F.col("source")).alias("Author"),
        F.concat(F.lit('"'), F.col("text"), F.lit('", they\nsaid')).alias("Text"),
        F.when(F.col("lang") == "en", "NA").otherwise(F.col("lang")).alias("Date"),
    )
    people = authors(spark, sf).withColumn(
        "Author", F.concat(F.lit("@author src"), F.col("Author").cast("string"))
    )
    write_csv(posts, folder)
    write_csv(people, folder, mode="append", extension="dim")
    landed = read_posts(spark, folder, files="*.csv", schema=RAW_POSTS)
    dimension = read_authors(spark, folder + "/*.dim")
    return landed.join(dimension.select("Author", "party"), "Author", "left")


@query("""SELECT source AS "Author", count(*) AS posts, sum(length(text))::BIGINT AS characters
FROM documents GROUP BY source""")
def append_by_author(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs append to the table partitioned by author."""
    path = new_dir(spark, "posts")
    posts = table(spark, sf, "documents").select(
        F.col("source").alias("Author"), F.col("text").alias("Text"), "lang"
    )
    append_posts(posts.filter(F.col("lang") == "en"), path)
    append_posts(posts.filter(F.col("lang") != "en"), path)
    stored = spark.read.schema(posts.schema).parquet(path)
    return stored.groupBy("Author").agg(
        F.count("*").alias("posts"), F.sum(F.length("Text")).alias("characters")
    )


@query("""SELECT c_custkey AS "Author", nullif(c_mktsegment, 'HOUSEHOLD') AS party FROM customer""")
def missing_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Spellings of "missing" in a key column become null."""
    spelled = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.element_at(
        F.array(*[F.lit(t) for t in ("", "NA", "nan", "None", "<NA>")]), F.length("c_name") % 5 + 1
    )).otherwise(F.col("c_mktsegment"))
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("Author"), missing_to_null(spelled).alias("party")
    )


@query("""SELECT (row_number() OVER (ORDER BY lang) - 1)::INT AS idx, lang AS label, count(*) AS count
FROM documents GROUP BY lang""")
def label_map_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    path = new_dir(spark, "label-map")
    write_label_map(spark, path, list(class_counts(documents, "lang")))
    counts = documents.groupBy(F.col("lang").alias("label")).count()
    return read_label_map(spark, path).join(counts, "label")


@query("""SELECT 'documents' AS source, 'doc_id' AS text_column, 'none' AS date_column, true AS complete, count(*) AS rows FROM documents
UNION ALL SELECT 'events', 'Text', 'timestamp', false, count(*) FROM events""")
def schema_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Text column, date column and required columns of a frame, found without a job."""
    frames = {
        "documents": table(spark, sf, "documents"),
        "events": table(spark, sf, "events").select(
            F.col("props").alias("Text"), F.col("ts").alias("timestamp")
        ),
    }
    parts = []
    for source, frame in frames.items():
        try:
            complete = require_columns(frame, ["doc_id", "text"]) is frame
        except ValueError:
            complete = False
        parts.append(frame.agg(F.count("*").alias("rows")).select(
            F.lit(source).alias("source"),
            F.lit(text_column(frame)).alias("text_column"),
            F.lit(first_present(frame, DATETIME_COLUMNS) or "none").alias("date_column"),
            F.lit(complete).alias("complete"),
            "rows",
        ))
    return union(parts)


# --- Streaming: files of a folder, read until used up ------------------------------------

_EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("event_type", T.StringType()),
])


def _event_stream(spark: SparkSession, folder: str, files: str) -> DataFrame:
    stream = streaming.stream_files(spark, folder, format="parquet", schema=_EVENTS, files=files)
    return stream.withColumn("ts", utc_instant(F.col("ts")))


_WEEKLY = "week date, event_type string, count bigint"


@query("""SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type, count(*) AS count
FROM events GROUP BY ALL""")
def stream_weekly(spark: SparkSession, sf: str) -> DataFrame:
    """Events arriving twice: copies dropped, then weekly counts kept complete."""
    work = new_dir(spark, "stream")
    doubled = union([_event_stream(spark, sf, "events.parquet") for _ in range(2)])
    single = streaming.drop_repeated(doubled, ["event_id"])
    streaming.append_to(single, f"{work}/events", f"{work}/checkpoint-events").awaitTermination()

    stored = _event_stream(spark, f"{work}/events", "*.parquet")
    weekly = streaming.weekly_counts(stored, "ts", ["event_type"])
    streaming.maintain_table(weekly, f"{work}/weekly", f"{work}/checkpoint-weekly").awaitTermination()
    return published(spark, f"{work}/weekly", _WEEKLY).withColumn("week", F.date_format("week", "yyyy-MM-dd"))


@query("""SELECT doc_id AS "ID", source AS "Author", length(text) AS characters FROM documents
WHERE lang <> 'es' AND lang <> 'fr'""")
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Landed CSV files to the table of eligible posts: reposts and old posts stay out."""
    work = new_dir(spark, "ingest")
    landed = table(spark, sf, "documents").select(
        F.col("doc_id").alias("ID"),
        F.col("source").alias("Author"),
        F.concat(F.when(F.col("lang") == "fr", "RT @").otherwise(""), F.col("text")).alias("Text"),
        F.when(F.col("lang") == "es", "Thu Dec 31 23:59:59 +0000 2020")
        .otherwise("Fri Jan 01 00:00:00 +0000 2021").alias("Date"),
    )
    write_csv(landed, f"{work}/landing")
    streaming.ingest(
        spark, f"{work}/landing", f"{work}/posts", f"{work}/checkpoint", files="*.csv"
    ).awaitTermination()
    return _stored(spark, f"{work}/posts")


# --- Landed files in any order and at any time -----------------------------------------------


def _dated(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as landed posts whose dates are years apart."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("ID"), F.col("source").alias("Author"), F.col("text").alias("Text"),
        F.concat(F.lit("Fri Jan 01 00:00:00 +0000 "), (F.lit(2021) + F.col("doc_id") % 4).cast("string")).alias("Date"),
    )


_POSTS = """SELECT doc_id AS "ID", source AS "Author", length(text) AS characters FROM documents"""


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return stored_posts(spark, path).select("ID", "Author", F.length("Text").cast("bigint").alias("characters"))


@query(_POSTS)
def stream_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs of the stream: the second brings older posts, and copies of the first run's."""
    work = new_dir(spark, "ingest")
    posts = _dated(spark, sf)

    def arrive(rows: DataFrame) -> None:
        write_csv(rows, f"{work}/landing", mode="append")
        streaming.ingest(
            spark, f"{work}/landing", f"{work}/posts", f"{work}/checkpoint", files="*.csv"
        ).awaitTermination()

    arrive(posts.filter("ID % 4 >= 2"))
    arrive(posts.filter("ID % 4 <= 2"))
    return _stored(spark, f"{work}/posts")


@query(_POSTS)
def collect_twice(spark: SparkSession, sf: str) -> DataFrame:
    """Collecting the same folder again adds nothing; authors' names keep their type."""
    work = new_dir(spark, "collect")
    write_csv(_dated(spark, sf), f"{work}/landing")
    for _ in range(2):
        collect_into(read_posts(spark, f"{work}/landing", files="*.csv"), f"{work}/posts")
    return _stored(spark, f"{work}/posts")


@query(_POSTS + " WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0")
def collect_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Replies stay out, and so do posts with an unreadable date."""
    work = new_dir(spark, "collect")
    posts = _dated(spark, sf).withColumns({
        "in_reply_to_status_id": F.when(F.col("ID") % 3 == 0, F.col("ID") + 1),
        "Date": F.when(F.col("ID") % 5 == 0, "soon").otherwise(F.col("Date")),
    })
    write_csv(posts, f"{work}/landing")
    collect_into(read_posts(spark, f"{work}/landing", files="*.csv"), f"{work}/posts")
    return _stored(spark, f"{work}/posts")


_CAP = 40


@query(f"""SELECT doc_id AS "ID", source AS "Author", length(text) AS characters FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id % 4 DESC, doc_id DESC) <= {_CAP}""")
def collect_cap_over_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The newest posts of each author over three runs that bring them in any order, one of them twice."""
    work = new_dir(spark, "collect")
    posts = _dated(spark, sf)
    runs = {"b": posts.filter("ID % 3 = 1"), "a": posts.filter("ID % 3 = 0"), "c": posts.filter("ID % 3 = 2")}
    for run, rows in [*runs.items(), ("a", runs["a"])]:
        collect_into(rows, f"{work}/posts", run=run, per_author=_CAP)
    return _stored(spark, f"{work}/posts")


@query(_POSTS + " WHERE doc_id % 5 <> 1")
def collect_replaced_run(spark: SparkSession, sf: str) -> DataFrame:
    """A run that is stored again with other rows replaces its own, also after compaction."""
    work = new_dir(spark, "collect")
    posts = _dated(spark, sf)
    collect_into(posts.filter("ID % 5 IN (0, 1, 2)"), f"{work}/posts", run="a")
    collect_into(posts.filter("ID % 5 IN (2, 3)"), f"{work}/posts", run="b")
    compact_table(spark, f"{work}/posts")
    collect_into(posts.filter("ID % 5 IN (0, 2, 4)"), f"{work}/posts", run="a")
    return _stored(spark, f"{work}/posts")


@query("""SELECT source AS "Author", count(*) AS posts FROM documents WHERE doc_id % 5 = 0 GROUP BY source""")
def collect_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Posts whose date is unreadable are stored beside the table."""
    work = new_dir(spark, "collect")
    posts = _dated(spark, sf).withColumn("Date", F.when(F.col("ID") % 5 == 0, "soon").otherwise(F.col("Date")))
    write_csv(posts, f"{work}/landing")
    collect_into(read_posts(spark, f"{work}/landing", files="*.csv"), f"{work}/posts")
    return rejected_posts(spark, f"{work}/posts").groupBy("Author").agg(F.count("*").alias("posts"))


@query("""SELECT doc_id AS "ID", source AS "Author", length(text) AS characters, lang AS "Date" FROM documents""")
def csv_column_order(spark: SparkSession, sf: str) -> DataFrame:
    """Files of two column orders, one with a further column, in one folder."""
    folder = new_dir(spark, "landing")
    posts = table(spark, sf, "documents").select(
        F.col("doc_id").alias("ID"), F.col("source").alias("Author"), F.col("text").alias("Text"), F.col("lang").alias("Date")
    )
    write_csv(posts.filter("ID % 2 = 0"), folder)
    write_csv(posts.filter("ID % 2 = 1").select("Date", "Text", F.lit("web").alias("client"), "ID", "Author"), folder, mode="append")
    landed = read_posts(spark, folder, files="*.csv")
    return landed.select("ID", "Author", F.length("Text").cast("bigint").alias("characters"), "Date")


@query("""SELECT nullif(lang, 'en') AS emotion, count(*) AS rows, sum(length(text))::BIGINT AS characters FROM documents GROUP BY 1""")
def training_set_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The training file, its columns the other way round and with a further one."""
    folder = new_dir(spark, "training")
    rows = table(spark, sf, "documents").select(
        F.when(F.col("lang") == "en", "NA").otherwise(F.col("lang")).alias("emotion"), "doc_id", "text"
    )
    write_csv(rows, folder)
    training = read_training_set(spark, f"{folder}/*.csv")
    return training.groupBy("emotion").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("characters"))


@query("""SELECT CASE WHEN doc_id % 10 <> 0 THEN doc_id END AS id, lang FROM documents
UNION ALL SELECT NULL, lang FROM documents WHERE doc_id % 10 = 0""")
def dedupe_null_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Copies go, but rows without an ID are no copies of each other."""
    rows = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 10 != 0, F.col("doc_id")).alias("id"), "lang")
    return drop_repeated(union([rows, rows]), "id")
