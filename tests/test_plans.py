"""What the plans have to look like to hold at scale."""

import pytest

import __spark_entry__ as entry
from affectframe.operators import bayes, counts, ranking, series
from affectframe.queries import REGISTRY
from affectframe.queries.registry import bare_posts, posts, table

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_no_query_multiplies_tables(spark, name):
    plan = _plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan
    assert ("MapInPandas" in plan) == (name == "external_scorer")


def test_only_used_columns_are_read(spark):
    plan = _plan(counts.party_emotions(posts(spark, SF)))
    assert "ReadSchema: struct<o_custkey:bigint,o_orderpriority:string>" in plan
    assert "o_totalprice" not in plan and "c_acctbal" not in plan and "c_name" not in plan


def test_counts_are_added_up_before_the_shuffle(spark):
    plan = _plan(counts.author_profile(bare_posts(spark, SF)))
    assert "partial_count" in plan


def test_event_window_reaches_the_scan(spark):
    plan = _plan(series.event_series(bare_posts(spark, SF).withColumnRenamed("topic", "party"), "1998-05-14", 2))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate,1998-03-14" in plan


def test_posts_are_counted_once_for_series_and_span(spark):
    facts = bare_posts(spark, SF).withColumnRenamed("topic", "party")
    for frame in (
        series.adaptive_series(facts, ["5-LOW"]),
        series.adaptive_series(facts, ["5-low"], explode=counts.explode_labels),
        series.event_series(facts, "1998-05-14", 2, selected=["5-low"], explode=counts.explode_labels),
    ):
        frame.collect()
        assert "ReusedExchange" in _plan(frame)


def test_groups_are_limited_before_the_shuffle(spark):
    events = table(spark, SF, "events").withColumnRenamed("user_id", "Author").withColumnRenamed("event_id", "ID")
    for plan in (
        _plan(ranking.cap_per_author(events, 10)),
        _plan(ranking.sample_per_group(events, "event_type", 5, id="ID")),
        _plan(ranking.top_counts(counts.count_by(events, ["Author", "event_type"]), "Author", "event_type")),
    ):
        limits = [line for line in plan.splitlines() if "WindowGroupLimit" in line]
        assert sum("Partial" in line for line in limits) == len(limits) / 2 > 0


def test_words_meet_a_small_model_where_they_are(spark, tmp_path):
    documents = table(spark, SF, "documents").select("doc_id", "text", "lang")
    model = bayes.train(documents, "text", "lang", path=str(tmp_path / "model"))
    plan = _plan(bayes.score(model, documents, "text", "doc_id"))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_sum" in plan
    large = _plan(bayes.score(model, documents, "text", "doc_id", max_bytes=0, head=10))
    assert "hashpartitioning(token" in large


def test_training_reads_the_texts_once(spark, tmp_path):
    """Weights are worked out from the stored counts, not from the texts."""
    documents = table(spark, SF, "documents").select("text", "lang")
    model = bayes.train(documents, "text", "lang", path=str(tmp_path / "model"))
    assert "documents.parquet" not in _plan(model.weights)
