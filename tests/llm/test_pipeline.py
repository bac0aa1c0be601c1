import pytest
from compare import connect, differences
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from affectframe.llm import exact, lines, mixing, queries, rules, simhash

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name]) == []


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_returns_every_document(spark, name):
    rows = queries.QUERIES[name](spark, SF).select("doc_id").collect()
    assert sorted(r.doc_id for r in rows) == list(range(200))


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        given.append(docs)
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        if n < 4:
            assert docs.dtypes == given[0].dtypes
    raw, judged, edited, single, mixed = given
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in given]
    verdicts = rules.quality_rules(raw, spark.read.parquet(f"{SF}/labels.parquet"), learn=lambda i: ~entry.corpus.discriminant.held_out(i))
    assert ids[1] == {r.id for r in verdicts.filter("kept").collect()}
    texts = {r.id: r.kept_text for r in lines.deduplicated(judged).collect()}
    assert {r.doc_id: r.text for r in edited.collect()} == texts
    assert all(r.n_chars == len(r.text) for r in edited.collect())
    near = simhash.near_duplicates(edited).collect()
    assert ids[3] == {r.component_id for r in near}
    times = {r.id: r.taken for r in mixing.mixed_words(single).collect()}
    words = mixed.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n"))
    assert {r.doc_id: r.n for r in words.collect() if r.n} == {i: n for i, n in times.items() if n}
    assert docs.count() == mixed.count() and docs.filter("NOT lossless").isEmpty()


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.filter("NOT lossless").isEmpty()


def test_native_operators_run_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from affectframe.llm import secret_rules

    for frame in (exact.exact_groups(docs), secret_rules.scan(docs)):
        plan = frame._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Cartesian" not in plan
