from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from affectframe.functions import scores as S, times as TM


def test_post_dates(evaluate):
    values = [
        "Wed Oct 10 20:19:24 +0000 2018", "Wed Oct 10 20:19:24 +0300 2018",
        "Xyz Oct 10 20:19:24 +0000 2018", "Wed Oct 99 20:19:24 +0000 2018", "", None, "2018-10-10",
    ]
    first, second = datetime(2018, 10, 10, 20, 19, 24), datetime(2018, 10, 10, 17, 19, 24)
    assert evaluate(values, lambda c: TM.utc_naive(TM.parse_post_date(c))) == [first, second] + [None] * 5
    assert evaluate(values, TM.parse_datetime) == [first, second, None, None, None, None, datetime(2018, 10, 10)]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_naive_times_do_not_depend_on_the_session_zone(spark, evaluate, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    texts = [
        "Wed Oct 10 20:19:24 +0000 2018", "2018-10-10", "2018-10-10 20:19:24", "2018-10-10T20:19:24Z",
        "2018-10-10 20:19:24+03:00", "2018-10-10T20:19:24.5-0100", "10/10/2018",
    ]
    try:
        values = evaluate(texts, TM.parse_datetime)
        start = spark.range(1).select(TM.utc_naive(TM.midnight("2021-01-01", "Europe/Istanbul"))).first()[0]
        back = evaluate([datetime(2024, 1, 1)], lambda c: TM.utc_naive(TM.utc_instant(c)), "timestamp_ntz")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    evening = datetime(2018, 10, 10, 20, 19, 24)
    assert values == [
        evening, datetime(2018, 10, 10), evening, evening,
        datetime(2018, 10, 10, 17, 19, 24), datetime(2018, 10, 10, 21, 19, 24, 500000), None,
    ]
    assert start == datetime(2020, 12, 31, 21)
    assert back == [datetime(2024, 1, 1)]


def test_windows_and_buckets(spark, evaluate):
    bounds = spark.range(1).select(*TM.event_bounds("2023-05-31", 3)).first()
    assert tuple(bounds) == (datetime(2023, 2, 28), datetime(2023, 8, 31))
    edges = [datetime(2024, 1, 7, 23, 59, 59), datetime(2024, 1, 8)]
    assert evaluate(edges, TM.week_start, "timestamp_ntz") == [date(2024, 1, 1), date(2024, 1, 8)]
    assert evaluate(edges, TM.month_start, "timestamp_ntz") == [date(2024, 1, 1)] * 2
    first, last = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-01 12:00:00", "2024-03-31 11:59:59"))
    assert tuple(spark.range(1).select(TM.whole_days(first, last), TM.whole_days(first, first)).first()) == (89, 0)


def _vector(*values):
    return S.score_vector([f"l{i}" for i in range(len(values))], [F.lit(float(v)) for v in values])


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_softmax_does_not_overflow(spark):
    probabilities = _one(spark, S.softmax(_vector(-1e6, 1e6, 1e6)))
    assert [p.score for p in probabilities] == [0.0, 0.5, 0.5]
    assert [p.label for p in probabilities] == ["l0", "l1", "l2"]


def test_ties_go_to_the_lower_index(spark):
    assert _one(spark, S.top_labels(_vector(1, 3, 3, 2))) == ["l1", "l2", "l3"]
    assert _one(spark, S.best(_vector(2, 2))).idx == 0


def test_decoding(spark):
    assert _one(spark, S.decode_labels(_vector(0.1, 0.5, 0.4))) == ["l1"]
    assert _one(spark, S.decode_labels(_vector(0.1, 0.5, 0.4), threshold=0.05)) == ["l1", "l2"]
    assert _one(spark, S.decode_labels(_vector(0.7, 0.3))) == ["l0"]
    empty = F.array().cast("array<struct<idx:int,label:string,score:double>>")
    assert _one(spark, S.decode_labels(empty)) == []
    assert _one(spark, S.softmax(empty)) == []


def test_fallback_label(spark):
    names = {"l0": "zero", "l1": "one"}
    assert _one(spark, S.label_or_uncertain(_vector(0.2, 0.5), names)) == "one"
    assert _one(spark, S.label_or_uncertain(_vector(0.2, 0.49), names)) == "uncertain"
    assert _one(spark, S.label_or_uncertain(_vector(0.0, 0.0, 0.9), names)) == "uncertain"
    missing = F.lit(None).cast("array<struct<idx:int,label:string,score:double>>")
    assert _one(spark, S.label_or_uncertain(missing, names)) == "uncertain"
