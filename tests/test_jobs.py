"""Sources, sinks, streams and whole jobs on small files."""

import csv

import pytest
from pyspark.sql import functions as F

from affectframe.__main__ import _arguments, run
from affectframe.functions.times import utc_instant
from affectframe.plans.analyse import analyse, topic_shares
from affectframe.plans.clean import clean_posts, clean_report
from affectframe.plans.collect import collect_into, rejected_posts, stored_posts
from affectframe.session import new_dir, shared_dir
from affectframe.sources import readers, writers
from affectframe.sources.versions import published
from affectframe.streaming import ingest as streaming

DAY = "Wed Mar {:02d} 20:19:24 +0000 2023"


def _write(path, header, rows, bom=False):
    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as file:
        writer = csv.writer(file)
        writer.writerow(header)
        writer.writerows(rows)


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    header = ["ID", "Author", "Text", "Date"]
    _write(folder / "ann_tweets_1.csv", header, [
        [1840000000000000001, "ann", 'He said "no, never"\nand left us', DAY.format(1)],
        [2, "ann", "RT @bob: copied words of others", DAY.format(2)],
        [3, "ann", "Şehitlerimizi saygı ile anıyoruz bugün", DAY.format(3)],
        [4, "ann", "too short", DAY.format(4)],
        [5, "ann", "an old post of former days", "Thu Dec 31 23:59:59 +0000 2020"],
        [6, "ann", "a post without any good date", "soon"],
    ], bom=True)
    _write(folder / "bob_tweets_1.csv", header, [
        [7, "bob", "Yarın büyük miting alanında olacağız", DAY.format(5)],
        [8, "bob", "ekonomi için yeni adımlar https://t.co/x", DAY.format(6)],
        [8, "bob", "ekonomi için yeni adımlar https://t.co/x", DAY.format(6)],
        [9, "NA", "nobody knows who wrote this", DAY.format(7)],
    ])
    _write(folder / "authors.csv", ["Author", "party", "political_side"], [
        ["@ann", "P", "left"], ["bob", "Q", "right"], ["eve", "R", "right"],
    ])
    return folder


def test_reading_posts_and_dimension_from_one_folder(spark, landing):
    posts = {r.ID: r for r in readers.read_posts(spark, str(landing)).collect()}
    assert len(posts) == 9
    assert posts[1840000000000000001].Text == 'He said "no, never"\nand left us'
    assert posts[9].Author is None
    authors = readers.read_authors(spark, str(landing / "authors.csv"))
    assert {r.Author for r in authors.collect()} == {"ann", "bob", "eve"}


def test_columns_are_bound_by_name(spark, tmp_path):
    _write(tmp_path / "a_tweets_1.csv", ["Text", "client", "ID", "Date", "Author"], [["hello", "web", 5, "d", "ann"]], bom=True)
    _write(tmp_path / "a_tweets_2.csv", ["Author", "ID", "Date", "Text", "in_reply_to_status_id"], [["007", 6, "e", "you", 5]])
    (tmp_path / "a_tweets_3.csv").write_text("")
    rows = sorted(tuple(r) for r in readers.read_posts(spark, str(tmp_path)).collect())
    assert rows == [(5, "ann", "hello", "d", None), (6, "007", "you", "e", 5)]
    _write(tmp_path / "a_tweets_4.csv", ["ID", "Author", "Text"], [[1, "ann", "x"]])
    with pytest.raises(ValueError, match="Date"):
        readers.read_posts(spark, str(tmp_path))
    _write(tmp_path / "labelled.csv", ["foo", "bar"], [[1, "zz"]])
    with pytest.raises(ValueError, match="party"):
        readers.read_labelled(spark, str(tmp_path / "labelled.csv"), "csv")


def test_collecting_again_adds_nothing(spark, landing, tmp_path):
    table = str(tmp_path / "table")

    def collect(**options):
        collect_into(readers.read_posts(spark, str(landing)), table, **options)
        return sorted(((r.ID, r.Author) for r in stored_posts(spark, table).collect()), key=repr)

    first = collect()
    assert len(first) == 5 and collect() == first
    _write(landing / "old_tweets_9.csv", ["ID", "Author", "Text", "Date"], [
        [11, "007", "an older post that comes late", "Sat May 15 12:00:00 +0000 2021"],
        ["x", "ann", "nobody could read its number", DAY.format(2)],
    ])
    second = collect()
    assert len(second) == 7 and (11, "007") in second and (None, "ann") in second
    assert collect() == second
    assert collect(run="again") == second and collect(run="again") == second
    assert {r.ID for r in rejected_posts(spark, table).collect()} == {6}


def test_emotion_catalogue(spark, tmp_path):
    _write(tmp_path / "emotions.csv", ["emotion_id", "emotion_name"], [[1, "admiration"], [28, "neutral"]])
    rows = readers.read_emotion_catalogue(spark, str(tmp_path / "emotions.csv")).collect()
    assert [tuple(r) for r in rows] == [(1, "admiration"), (28, "neutral")]


def test_cleaning_job(spark, landing):
    posts = readers.read_posts(spark, str(landing))
    authors = readers.read_authors(spark, str(landing / "authors.csv"))
    cleaned = clean_posts(posts, authors)
    got = {r.ID: r for r in cleaned.collect()}
    assert cleaned.columns == ["ID", "Author", "party", "political_side", "Text", "Date"]
    assert set(got) == {1840000000000000001, 2, 3, 5, 6, 8, 9}
    assert got[1840000000000000001].Text == "said no, never and left"
    assert (got[8].party, got[8].Text, got[9].party) == ("Q", "ekonomi için yeni adımlar", None)
    report = [tuple(r) for r in clean_report(posts).orderBy("stage").collect()]
    assert report == [(1, "event announcements", 1, 9), (2, "short texts", 1, 8)]


def test_cleaning_is_planned_once(spark, landing):
    """The filters on the cleaned text do not repeat the cleaning."""
    posts = readers.read_posts(spark, str(landing))
    plan = clean_posts(posts, readers.read_authors(spark, str(landing / "authors.csv")))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("https?://") == 1


def test_csv_is_read_back_as_written(spark, tmp_path):
    rows = [(1, 'a "b", c\nd', ["x", "y"]), (2, "  spaced  ", []), (3, "back\\slash", None)]
    frame = spark.createDataFrame(rows, "ID long, Text string, labels array<string>").coalesce(1)
    writers.write_csv(frame, str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("part-*.csv")
    with open(file, encoding="utf-8", newline="") as lines:
        got = list(csv.reader(lines))
    assert got[1:] == [["1", 'a "b", c\nd', "x,y"], ["2", "  spaced  ", ""], ["3", "back\\slash", ""]]


def test_label_map(spark, tmp_path):
    writers.write_label_map(spark, str(tmp_path / "map"), ["Anger", "Öfke"])
    rows = readers.read_label_map(spark, str(tmp_path / "map")).collect()
    assert sorted(tuple(r) for r in rows) == [(0, "Anger"), (1, "Öfke")]


def test_full_text_is_preferred(spark):
    frame = spark.createDataFrame([("long", "short"), (None, "short")], "full_text string, words string")
    assert [r.Text for r in readers.full_text(frame, short="words").collect()] == ["long", "short"]
    assert readers.text_column(spark.createDataFrame([("a", 1)], "body string, n int")) == "body"


def test_chart_names(spark):
    assert spark.range(1).select(writers.chart_name(3, "Topic Shares")).first()[0] == "3_topic_shares"


def test_labelled_tables_need_their_columns(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="party"):
        readers.read_labelled(spark, str(tmp_path / "t"))


def test_shared_folder(spark):
    assert new_dir(spark, "a") != new_dir(spark, "a")
    assert new_dir(spark, "a").startswith(shared_dir(spark))


# --- streams ----------------------------------------------------------------------


def test_stream_goes_on_where_it_stopped(spark, landing, tmp_path):
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")

    def arrive():
        streaming.ingest(spark, str(landing), table, checkpoint, files_per_batch=1).awaitTermination()
        return sorted(r.ID for r in stored_posts(spark, table).collect())

    first = [4, 7, 8, 9, 1840000000000000001]
    assert arrive() == first
    _write(landing / "bob_tweets_2.csv", ["ID", "Author", "Text", "Date"], [
        [8, "bob", "ekonomi için yeni adımlar https://t.co/x", DAY.format(6)],
        [10, "bob", "one more post of the week", DAY.format(8)],
    ])
    _write(landing / "bob_tweets_3.csv", ["Author", "Date", "Text", "ID"], [
        ["bob", "Mon Mar 01 10:00:00 +0000 2021", "a post of two years before", 12],
    ])
    # A copy that arrives in a later run is still known, and old posts may come late.
    assert arrive() == sorted([*first, 10, 12])


def test_weekly_table_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "event_type")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = streaming.stream_files(
        spark, str(tmp_path / "in"), format="parquet", schema=events.schema, files=None, files_per_batch=1
    ).withColumn("ts", utc_instant(F.col("ts")))
    weekly = streaming.weekly_counts(stream, "ts", ["event_type"])
    streaming.maintain_table(weekly, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = events.groupBy(F.trunc("ts", "week").alias("week"), "event_type").count()
    stored = published(spark, str(tmp_path / "out"), "week date, event_type string, count bigint")
    assert stored.exceptAll(batch).count() == 0 and stored.count() == batch.count()


# --- analysis and command line -------------------------------------------------------


def test_analysis(spark):
    rows = [
        (1, "a", "P", "left", "2023-04-03", "economy", "Anger,Fear"),
        (2, "a", "P", "left", "2023-04-04", "condolence", "Sadness"),
        (3, "b", "Q", "right", "2023-05-14", "economy", "Anger"),
        (4, "b", "Q", "right", "bad date", None, "Happy"),
        (5, "c", None, None, "2023-07-14", "economy", "Anger"),
    ]
    posts = spark.createDataFrame(
        rows, "ID int, Author string, party string, political_side string, Date string, topic string, predicted_emotions string"
    )
    tables = analyse(posts, event_parties=["P", "Q"])
    assert tables["party_counts"].agg(F.sum("count")).first()[0] == 5
    # The exclusion drops the condolence but keeps the post without a topic.
    assert {tuple(r) for r in tables["party_shares_without_excluded"].collect()} == {
        ("P", "Anger", 1, 50.0), ("P", "Fear", 1, 50.0), ("Q", "Anger", 1, 50.0), ("Q", "Happy", 1, 50.0),
    }
    assert [r.topic for r in tables["focus_topics"].collect()] == ["economy"]
    assert {(r.party, r.predicted_emotions) for r in tables["topic_party_tops"].collect()} == {("P", "Anger"), ("Q", "Anger")}
    assert tables["topic_shares"].filter("predicted_emotions = 'Anger'").first()["count"] == 3
    assert {(str(r.ts_period), r.Anger, r.Happy) for r in tables["series"].collect()} == {
        ("2023-04-01", 1, 0), ("2023-05-01", 1, 0), ("2023-07-01", 1, 0),
    }
    assert {(r.party, str(r.ts_period), r.Anger) for r in tables["event_series"].collect()} == {
        ("P", "2023-04-03", 1), ("Q", "2023-05-08", 1),
    }
    assert tables["side_shares"].count() == 5
    cells = spark.createDataFrame(
        [("a", "Anger", 5), ("b", "Anger", 3), ("b", "Fear", 3), (None, "Fear", 99), ("c", None, 99)],
        "topic string, predicted_emotions string, count long",
    )
    busiest = topic_shares(cells, max_topics=1).collect()
    assert {(r.topic, r.predicted_emotions, r.share) for r in busiest} == {("b", "Anger", 0.5), ("b", "Fear", 0.5)}
    few = analyse(posts.drop("topic", "political_side", "Date"))
    assert sorted(few) == ["party_counts", "party_shares", "party_top3", "party_top3_lines"]


def test_jobs_from_landing_to_analysis(spark, landing, tmp_path, capsys):
    def job(*argv):
        run(spark, _arguments([str(a) for a in argv]))

    emotions = ["Anger", "Fear", "Happy"]
    _write(tmp_path / "training.csv", ["text", "emotion"], [
        [f"{['never left', 'nobody knows', 'yeni ekonomi'][i % 3]} word{i % 5}", emotions[i % 3]] for i in range(60)
    ] + [["", "Fear"], ["text", "NA"]])
    out = tmp_path / "out"
    job("collect", landing, out / "raw", "--limit", 5)
    job("clean", out / "raw", landing / "authors.csv", out / "cleaned", "--report")
    job("topics", out / "cleaned", out / "topics", "--topics", "ekonomi, weather")
    job("train", tmp_path / "training.csv", out / "model")
    job("emotions", out / "topics", out / "model", out / "labelled", "--csv", out / "csv")
    job("analyse", out / "labelled", out / "tables", "--event-date", "2023-03-05")
    job("explain", out / "labelled", out / "model", out / "explained")
    assert "unknown topic skipped: 'weather'" in capsys.readouterr().out
    labelled = {r.ID: r for r in spark.read.parquet(str(out / "labelled")).collect()}
    assert set(labelled) == {1840000000000000001, 8, 9}
    assert (labelled[8].topic, labelled[8].predicted_emotions, labelled[8].party) == ("economy", ["Happy"], "Q")
    assert labelled[1840000000000000001].predicted_emotions == ["Anger"]
    lines = spark.read.parquet(str(out / "tables" / "party_top3_lines")).collect()
    assert {r.line for r in lines} == {"P: Anger=1", "Q: Happy=1"}
    again = readers.read_labelled(spark, str(out / "csv"), "csv")
    assert {r.ID: r.predicted_emotions for r in again.collect()} == {
        1840000000000000001: "Anger", 8: "Happy", 9: "Fear",
    }
    assert spark.read.parquet(str(out / "explained")).filter("token IS NULL").count() == 3
