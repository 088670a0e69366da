"""What the plans must and must not hold."""

import re

import pytest

from quillstone.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", ["lines_explode", "clean_text", "bigram_model", "fragment_scores", "span_to_doc", "source_lookup", "page_segments", "singleton_windows"])
def test_no_products_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not re.search("Cartesian|NestedLoop|Python|Pandas|Arrow", text)


@pytest.mark.parametrize("name, columns", [
    ("lines_explode", "doc_id:bigint,text:string"), ("bigram_model", "text:string,lang:string"), ("range_sections", "doc_id:bigint,n_chars:bigint"), ("toc_links", "page_id:bigint,html:string"),
])
def test_only_needed_columns_are_read(spark, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan(QUERIES[name](spark, SF))


def test_windows_are_partitioned(spark):
    for name in ("singleton_windows", "page_segments", "asof_boundary", "inversion_swaps", "adjacent_boundaries", "book_bigram_model"):
        assert "SinglePartition" not in plan(QUERIES[name](spark, SF))


def test_pairs_meet_the_model_where_they_are(spark):
    """Only a row a fragment is shuffled: neither pairs nor characters are, while the model fits a broadcast."""
    for name in ("fragment_scores", "top_suspicious", "singleton_windows"):
        assert not re.search("hashpartitioning\\([^)]*(bigram|ch)#", plan(QUERIES[name](spark, SF)))


def test_rows_that_need_no_shuffle(spark):
    assert "Exchange hash" not in plan(QUERIES["hopping_windows"](spark, SF)) and "Exchange hash" not in plan(QUERIES["paragraph_reflow"](spark, SF))


def test_large_models_are_shuffled_but_for_hot_pairs(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quillstone.operators import ngrams

    rows = spark.createDataFrame([("a", k) for k in ["xy"] * 50 + ["yz"] * 3 + ["q"]], "lang string, bigram string")
    model = ngrams.stored(rows.filter("bigram <> 'q'").groupBy("lang", "bigram").agg(F.count("*").alias("n")), "model")
    want = sorted(map(tuple, ngrams.with_counts(rows, model, ["lang", "bigram"]).collect()), key=str)
    monkeypatch.setattr(ngrams, "MAX_BROADCAST_MODEL", 0)
    monkeypatch.setattr(ngrams, "HOT_PAIRS", 4)
    assert sorted(map(tuple, ngrams.with_counts(rows, model, ["lang", "bigram"]).collect()), key=str) == want and len(want) == 54


def test_needles_that_fit_no_broadcast(spark, monkeypatch):
    from quillstone.operators import mapping

    want = sorted(map(tuple, QUERIES["span_to_doc"](spark, SF).collect()))
    monkeypatch.setattr(mapping, "MAX_BROADCAST_NEEDLES", 0)
    assert sorted(map(tuple, QUERIES["span_to_doc"](spark, SF).collect())) == want
