"""Each table of the analysis is returned by a query that has its SQL."""

import __spark_entry__ as entry
from affectframe.plans.analyse import analyse
from affectframe.queries.registry import posts

SF = "/root/testdata/sf0.001"
IN_ANALYSIS_JOB = {"party_shares_without_excluded", "side_shares", "party_shares"}


def test_each_table_has_a_query(spark):
    tables = analyse(posts(spark, SF), series_emotions=["1-urgent"])
    found, sql = entry.queries(), entry.oracle_sql()
    missing = {t for t in tables if f"analysis_{t}" not in found or f"analysis_{t}" not in sql}
    assert missing == IN_ANALYSIS_JOB and len(tables) == 14


def test_small_shares_are_folded(spark):
    rows = entry.queries()["analysis_topic_shares"](spark, SF).collect()
    assert [r.predicted_emotions for r in rows].count("Other") == 2
