from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from affectframe.operators import counts as C, filters as L, joins as J, ranking as R, series as S
from affectframe.operators.dedupe import drop_repeated
from affectframe.operators.split import class_counts, split_quotas, stratified_split
from affectframe.operators.joins import join_on_key
from affectframe.operators.topics import (
    label_lexicon,
    label_topics,
    lexicon_scores,
    lexicon_scores_by_join,
    parse_topics,
    prototypes,
)
from affectframe.operators.scorer import score_externally
from affectframe.schemas import first_present, require_columns


def _rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


# --- joins ---------------------------------------------------------------------


@pytest.fixture
def facts(spark):
    rows = [(i, "hot") for i in range(60)] + [(100, "a"), (101, "b"), (102, None), (103, "z"), (104, "a")]
    return spark.createDataFrame(rows, "ID int, Author string")


@pytest.fixture
def people(spark):
    rows = [("hot", "H"), ("a", "A1"), ("a", "A2"), (None, "N"), ("q", "Q")]
    return spark.createDataFrame(rows, "Author string, party string")


@pytest.mark.parametrize("nulls", [True, False])
@pytest.mark.parametrize("hot_parts", [1, 2, 1000])
def test_joins_are_the_same_without_broadcast(facts, people, nulls, hot_parts):
    options = {"null_keys_match": nulls}
    small = J.dimension_join(facts, people, "Author", **options)
    large = J.dimension_join(facts, people, "Author", max_bytes=0, hot_parts=hot_parts, **options)
    assert _rows(small) == _rows(large)
    inner = J.join_on_key(facts, people, "Author", "inner", max_bytes=0, hot_parts=hot_parts, **options)
    assert _rows(inner) == _rows(small.filter("party IS NOT NULL"))
    # Doubled by the two rows of "a"; the missing author matches only if asked for.
    assert small.count() == 67
    assert small.filter("ID = 102").first().party == ("N" if nulls else None)
    assert small.filter("ID = 103").first().party is None


@pytest.mark.parametrize("options", [{}, {"max_bytes": 0, "hot_parts": 2}])
def test_membership(facts, people, options):
    inside = J.keep_matching(facts, people, "Author", **options)
    outside = J.drop_matching(facts, people, "Author", **options)
    assert inside.count() == 62
    assert _rows(outside, "ID") == [(101,), (102,), (103,)]


def test_authors_are_matched_without_at_sign(spark):
    posts = spark.createDataFrame([(1, "@Ann"), (2, "bob"), (3, "Bob")], "ID int, Author string")
    authors = spark.createDataFrame([("Ann", "X", "left"), ("@Bob", "Y", "right")], "Author string, party string, political_side string")
    joined = J.join_authors(posts, authors)
    assert _rows(joined, "ID", "Author", "party") == [(1, "@Ann", "X"), (2, "bob", None), (3, "Bob", "Y")]
    folded = J.join_authors(posts, authors, ignore_case=True)
    assert _rows(folded, "ID", "party") == [(1, "X"), (2, "Y"), (3, "Y")]


# --- filters --------------------------------------------------------------------


def test_null_is_not_excluded(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "topic string")
    assert _rows(L.drop_values(df, "topic", ["a"])) == [("b",), (None,)]
    assert L.keep_values(df, "topic", []).count() == 3
    assert L.keep_values(df, "topic", ["a", "x"]).count() == 1


def test_replies_go_only_where_the_column_exists(spark):
    df = spark.createDataFrame([(1, None), (2, 7)], "ID int, in_reply_to_status_id long")
    assert _rows(L.drop_replies(df), "ID") == [(1,)]
    assert L.drop_replies(df.select("ID")).count() == 2


def test_cutoff_is_midnight_of_the_zone(spark):
    rows = [(1, datetime(2020, 12, 31, 20, 59, 59)), (2, datetime(2020, 12, 31, 21)), (3, None)]
    df = spark.createDataFrame(rows, "ID int, ts timestamp")
    assert _rows(L.since(df, F.col("ts"), zone="Europe/Istanbul"), "ID") == [(2,)]


def test_closed_interval_ends_at_midnight(spark):
    rows = [(1, datetime(2023, 7, 14)), (2, datetime(2023, 7, 14, 0, 0, 1)), (3, datetime(2023, 3, 14))]
    df = spark.createDataFrame(rows, "ID int, at timestamp_ntz")
    start, end = F.lit(datetime(2023, 3, 14)), F.lit(datetime(2023, 7, 14))
    assert _rows(L.within(df, F.col("at"), start, end), "ID") == [(1,), (3,)]


def test_missing_and_blank(spark):
    df = spark.createDataFrame([("a", "x"), (None, "x"), ("b", "  "), ("c", None)], "k string, t string")
    assert _rows(L.drop_blank(L.drop_missing(df, ["k", "t"]), "t"), "k") == [("a",)]


# --- counts ---------------------------------------------------------------------


def test_label_lists_to_long_form(spark):
    rows = [(1, "ANGER, fear"), (2, ""), (3, None), (4, " joy ,,"), (5, "very sad")]
    df = spark.createDataFrame(rows, "ID int, predicted_emotions string")
    expected = [(1, "Anger"), (1, "Fear"), (4, "Joy"), (5, "Very sad")]
    assert _rows(C.explode_labels(df)) == expected
    assert (3, "Nan") in _rows(C.explode_labels(df, missing_label="nan"))
    lists = df.withColumn("predicted_emotions", F.split("predicted_emotions", ","))
    assert _rows(C.explode_labels(lists)) == expected
    empty = lists.withColumn("predicted_emotions", F.array().cast("array<string>"))
    assert C.explode_labels(empty).count() == 0
    assert C.explode_labels(empty, missing_label="nan").count() == 5


def test_null_keys_form_no_group(spark):
    df = spark.createDataFrame([("p", "A"), (None, "A"), ("p", None), ("p", "A")], "party string, predicted_emotions string")
    assert _rows(C.party_emotions(df)) == [("p", "A", 2)]


def test_shares_add_up(spark):
    df = spark.createDataFrame([("p", "A", 1), ("p", "B", 2), ("q", "A", 7)], "party string, predicted_emotions string, count long")
    shares = C.with_percentage(df, "party")
    sums = {r.party: r.s for r in shares.groupBy("party").agg(F.sum("percentage").alias("s")).collect()}
    assert sums == {"p": pytest.approx(100), "q": pytest.approx(100)}


def test_folding(spark):
    rows = [
        ("two", "A", 980), ("two", "B", 15), ("two", "C", 5),
        ("one", "A", 990), ("one", "B", 10),
        ("edge", "A", 98), ("edge", "B", 2),
    ]
    counts = spark.createDataFrame(rows, "topic string, predicted_emotions string, count long")
    folded = C.fold_small_shares(counts, "topic")
    got = {(r.topic, r.predicted_emotions): (r["count"], r.position, r.text) for r in folded.collect()}
    assert got == {
        ("two", "A"): (980, 1, "98.0%\n(980)"), ("two", "Other"): (20, 2, ""),
        ("one", "A"): (990, 1, "99.0%\n(990)"), ("one", "B"): (10, 2, ""),
        ("edge", "A"): (98, 1, "98.0%\n(98)"), ("edge", "B"): (2, 2, ""),
    }


def test_focus_topics(spark):
    rows = [("a", 5), ("b", 9), ("c", 9), ("d", 1)]
    counts = spark.createDataFrame(rows, "topic string, count long")
    some = C.focus_topics(counts, ["x", "d", "a"])
    assert [r.topic for r in some.orderBy("position").collect()] == ["d", "a"]
    none = C.focus_topics(counts, ["x"])
    assert [r.topic for r in none.orderBy("position").collect()] == ["b", "c", "a"]
    assert C.focus_topics(counts, []).count() == 3


def test_busiest_topics_skip_missing_labels(spark):
    rows = [("a", "x"), ("a", None), ("b", "x"), ("b", "y"), (None, "x")]
    long = spark.createDataFrame(rows, "topic string, predicted_emotions string")
    assert _rows(C.busiest_topics(long, 1)) == [("b", 2)]


def test_stage_counts(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "i int")
    table = C.stage_counts(df, {"even": F.col("i") % 2 == 0, "small": F.col("i") < 5})
    assert _rows(table) == [(1, "even", 5, 5), (2, "small", 2, 3)]


# --- ranking --------------------------------------------------------------------


def test_equal_counts_are_ranked_by_label(spark):
    rows = [("p", "b", 2), ("p", "a", 2), ("p", "c", 3), ("p", "d", 1)]
    counts = spark.createDataFrame(rows, "party string, predicted_emotions string, count long")
    top = R.top_counts(counts, "party")
    assert [(r.predicted_emotions, r["rank"]) for r in top.orderBy("rank").collect()] == [("c", 1), ("a", 2), ("b", 3)]
    assert R.top_line(top, "party").first().line == "p: c=3, a=2, b=2"


def test_cap_with_a_hot_author(spark):
    rows = [(i, "hot" if i % 3 else f"a{i % 7}", datetime(2024, 1, 1, i // 60 % 24, i % 60)) for i in range(3000)]
    posts = spark.createDataFrame(rows, "ID int, Author string, ts timestamp_ntz")
    capped = R.cap_per_author(posts, 10)
    expected = set()
    for author in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == author), key=lambda r: (r[2], r[0]), reverse=True)
        expected |= {(r[0], author) for r in mine[:10]}
    assert {(r.ID, r.Author) for r in capped.collect()} == expected


def test_examples_need_exactly_one_label(spark):
    rows = [(3, "Fear"), (1, "Fear"), (2, "Fear,Anger"), (4, "Anger"), (5, "Joy")]
    posts = spark.createDataFrame(rows, "ID int, predicted_emotions string")
    first = R.first_per_label(posts, ["Anger", "Fear"], 1)
    assert _rows(first, "label_position", "ordinal", "ID") == [(1, 1, 4), (2, 1, 1)]


def test_samples_repeat(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 2)
    one, two, other = (R.sample_per_group(df, "g", 5, id="id", seed=s) for s in (1, 1, 2))
    assert _rows(one) == _rows(two) != _rows(other)
    assert one.count() == 10


# --- series ---------------------------------------------------------------------


def _long(spark, days, date_column="Date"):
    rows = [(d, "p" if i % 2 else None, "Anger" if i % 3 else "Fear") for i, d in enumerate(days)]
    return spark.createDataFrame(rows, f"{date_column} timestamp_ntz, party string, predicted_emotions string")


def test_days_up_to_the_limit_then_months(spark):
    start = datetime(2024, 1, 1)
    short = _long(spark, [start, datetime(2024, 3, 31, 23)])
    long = _long(spark, [start, datetime(2024, 4, 1, 0)])
    assert _rows(S.adaptive_series(short, ["Anger", "Fear"]), "ts_period") == [(date(2024, 1, 1),), (date(2024, 3, 31),)]
    assert _rows(S.adaptive_series(long, ["Anger", "Fear"]), "ts_period") == [(date(2024, 1, 1),), (date(2024, 4, 1),)]
    longer = _long(spark, [start, datetime(2024, 4, 2, 5)])
    assert _rows(S.adaptive_series(longer, ["Anger", "Fear"]), "ts_period") == [(date(2024, 1, 1),), (date(2024, 4, 1),)]


def test_no_date_column(spark):
    df = spark.createDataFrame([(1, "Anger")], "DATE_ int, predicted_emotions string")
    assert S.adaptive_series(df, ["Anger"]) is None
    assert S.event_series(df) is None


def test_date_names_are_sought_in_order_and_exactly(spark):
    df = spark.createDataFrame([(1, 2)], "Date int, created_at int")
    assert S.datetime_column(df) == "created_at"
    assert first_present(df, ["date"]) is None


def test_event_labels(spark):
    days = [datetime(2023, 5, d) for d in range(1, 13)]
    long = _long(spark, days)

    def labels(**options):
        return {r.predicted_emotions for r in S.event_series(long, months=1, **options).collect()}

    assert labels() == {"Anger", "Fear"}
    assert labels(emotions=[" anger "]) == {"Anger"}
    assert labels(emotions=["joy"], selected=["Fear"]) == set()
    assert labels(selected=["Fear", "Joy"]) == {"Fear"}
    assert labels(selected=["Joy"]) == {"Anger", "Fear"}
    assert labels(parties=["q"]) == set()


def test_selected_label_may_occur_with_a_missing_party_only(spark):
    rows = [(datetime(2023, 5, 2), None, "Fear"), (datetime(2023, 5, 2), "p", "Anger")]
    long = spark.createDataFrame(rows, "Date timestamp_ntz, party string, predicted_emotions string")
    assert S.event_series(long, selected=["Fear"]).count() == 0


def test_pivot_keeps_totals_and_order(spark):
    rows = [(date(2024, 1, 1), "A", 2), (date(2024, 3, 1), "B", 5)]
    series = spark.createDataFrame(rows, "ts_period date, predicted_emotions string, count long")
    wide = S.pivot_series(series, ["B", "A", "C"])
    assert wide.columns == ["ts_period", "B", "A", "C"]
    assert _rows(wide) == [(date(2024, 1, 1), 0, 2, 0), (date(2024, 3, 1), 5, 0, 0)]


# --- split ----------------------------------------------------------------------


def test_quotas():
    # The recorded run: 25,989 rows were split into 22,090 and 3,899.
    supports = {"Anger": 709, "Disgust": 543, "Fear": 659, "Happy": 784, "Sadness": 753, "Surprise": 451}
    assert sum(supports.values()) == 3899
    sizes = {"a": 20_000, "b": 5_000, "c": 989}
    quotas = split_quotas(sizes)
    assert sum(quotas.values()) == 3899
    assert all(abs(quotas[k] - n * 3899 / 25_989) < 1 for k, n in sizes.items())
    assert split_quotas({"a": 1, "b": 1}, 0.5) == {"a": 1, "b": 0}


@pytest.mark.parametrize("fraction", [0.0, 0.15, 0.5, 1.0])
def test_split_is_exact(spark, fraction):
    df = spark.range(5000).withColumn("l", F.when(F.col("id") % 3 == 0, "x").when(F.col("id") < 40, "rare").otherwise("y"))
    flagged = stratified_split(df, "l", "id", fraction=fraction)
    got = {r.l: r.n for r in flagged.groupBy("l").agg(F.count_if("held_out").alias("n")).collect()}
    assert got == split_quotas(class_counts(df, "l"), fraction)
    assert flagged.count() == 5000
    held = flagged.filter("held_out").select("id", "l")
    order = R.seeded_order("id")
    for label, quota in got.items():
        lowest = df.filter(F.col("l") == label).orderBy(order, "id").limit(quota)
        assert _rows(held.filter(F.col("l") == label)) == _rows(lowest)


def test_too_many_classes_are_refused(spark):
    with pytest.raises(ValueError, match="more than 10 classes"):
        class_counts(spark.range(100), "id", max_classes=10)


# --- topics, scorer, schemas ------------------------------------------------------


def test_topic_lists():
    assert parse_topics(["göç,", "economy", ", SPOR"]) == (["göç", "ekonomi", "spor"], [])
    accepted, rejected = parse_topics(["weather"])
    assert len(accepted) == 14 and rejected == ["weather"]
    assert parse_topics(None) == (accepted, [])
    assert parse_topics(["dış", "politika"])[0] == ["dış politika"]


def test_topics_by_name(spark):
    texts = ["Yeni göç haberi", "dış işler", "dış, politika!", "nothing", None]
    df = spark.createDataFrame(list(enumerate(texts)), "ID int, Text string")
    topics = {r.ID: r.topic for r in label_topics(df).collect()}
    assert topics == {0: "migration", 1: "foreign_policy", 2: "foreign_policy", 3: "uncertain", 4: "uncertain"}
    strict = {r.ID: r.topic for r in label_topics(df, threshold=0.6).collect()}
    assert strict[1] == "uncertain"
    assert label_lexicon(["dış politika"]) == {"dış politika": {"dış": 1.0, "politika": 1.0}}


def test_lexicons_of_any_size_give_the_same_scores(spark):
    texts = ["w1 w2 w2", "w5 x", "w19999 w3", "", None, "w1 w2 w2", "W1"]
    df = spark.createDataFrame(list(enumerate(texts)), "ID int, Text string")
    lexicon = {"a": {f"w{i}": 1.0 + i % 3 for i in range(20_000)}, "b": {"w1": 2.0, "x": 1.0}}
    joined = lexicon_scores_by_join(df, "Text", lexicon).select("ID", "scores")
    inline = df.select("ID", lexicon_scores(F.col("Text"), lexicon).alias("scores"))
    got, expected = ({r.ID: [s.score for s in r.scores or []] for r in x.collect()} for x in (joined, inline))
    assert {i: s for i, s in got.items() if texts[i]} == {i: s for i, s in expected.items() if texts[i]}
    assert label_topics(df, lexicon=lexicon, threshold=0.5).count() == len(texts)


def test_vectors_of_different_lengths_are_refused(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "label string, v array<double>")
    with pytest.raises(ValueError, match="1 to 2"):
        prototypes(df, "label", "v")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_keys_with_many_partners_are_dealt_over_slices(spark, how):
    facts = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("k"))
    other = spark.range(60).select(F.when(F.col("id") < 50, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    sliced = join_on_key(facts, other, "k", how, max_bytes=0, hot_parts=10)
    plain = facts.join(other, "k", how).select(*sliced.columns)
    assert _rows(sliced) == _rows(plain)


def test_split_of_shared_and_missing_ids(spark):
    rows = [(1, "x", n) for n in range(10)] + [(None, "y", n) for n in range(6)] + [(n, "z", 0) for n in range(20)]
    df = spark.createDataFrame(rows + [(1, "x", 0)], "id int, l string, n int")
    flagged = stratified_split(df, "l", "id", fraction=0.3)
    got = {r.l: r.n for r in flagged.groupBy("l").agg(F.count_if("held_out").alias("n")).collect()}
    assert got == split_quotas(class_counts(df, "l"), 0.3)
    assert _rows(flagged.drop("held_out")) == _rows(df)


def test_failing_texts_do_not_fail_the_job(spark):
    texts = ["fine", "bad", None, " ", "also fine"]
    df = spark.createDataFrame(list(enumerate(texts)), "ID int, Text string").coalesce(1)

    def scorer(batch):
        if "bad" in batch:
            raise RuntimeError("no")
        return [[len(t), 1.0] for t in batch]

    got = {r.ID: r for r in score_externally(df, "Text", "ID", ["n", "one"], scorer).collect()}
    assert [s.score for s in got[0].scores] == [4.0, 1.0] and got[0].error is None
    assert got[1].scores == [] and got[1].error == "RuntimeError: no"
    assert got[2].scores == [] and got[2].error is None and got[3].scores == []
    assert [s.label for s in got[4].scores] == ["n", "one"]


def test_required_columns(spark):
    df = spark.createDataFrame([(1,)], "Author int")
    assert require_columns(df, ["Author"]) is df
    with pytest.raises(ValueError, match="party"):
        require_columns(df, ["Author", "party"])


def test_copies_go(spark):
    rows = [(1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "c"), (1, "a")]
    df = spark.createDataFrame(rows, "ID int, Text string")
    for limit in (0, 10_000):
        assert _rows(drop_repeated(df, max_bytes=limit)) == [(1, "a"), (2, "b"), (None, "c"), (None, "c")]


def test_both_ways_of_scoring_by_a_lexicon_give_equal_bits(spark):
    lexicon = {"one": {"z": 0.1, "b": 0.2, "a": 0.3}, "two": {"a": 0.7, "q": 1 / 3}}
    posts = spark.createDataFrame([(1, "z b a"), (2, "a b"), (3, "q a z"), (4, None), (5, "")], "ID int, text string")
    direct = posts.select("ID", lexicon_scores(F.col("text"), lexicon).alias("scores")).collect()
    joined = {r.ID: r.scores for r in lexicon_scores_by_join(posts, "text", lexicon).collect()}
    for row in direct:
        if row.ID != 4:
            assert row.scores == joined[row.ID]
    assert [s.score for s in joined[1]][0] == 1.0
