from collections import Counter

import pytest

import corpus_pipeline
from evenkeel.llm import queries


@pytest.mark.parametrize("name", ["quality", "language", "mixing"])
def test_rows_without_an_id_are_judged_by_their_text(spark, sf_dir, name):
    docs = queries.table(spark, sf_dir, "documents").where("n_chars between 900 and 1500")
    stage = dict(corpus_pipeline.STAGES)[name]
    with_ids = Counter(r.text for r in stage(spark, docs, sf_dir).select("text").collect())
    labelled = queries.table(spark, sf_dir, "labels").select("doc_id")
    bare = docs.join(labelled, "doc_id", "left_anti").selectExpr("CAST(NULL AS BIGINT) AS doc_id", *docs.columns[1:])
    out = stage(spark, docs.join(labelled, "doc_id", "left_semi").union(bare), sf_dir)
    assert out.columns == docs.columns
    assert {r.text for r in out.select("text").collect()} == set(with_ids)


def test_one_row_of_each_group_of_copies_stays(spark, sf_dir):
    one, two = "one two three four five six seven eight nine", "red green blue black white grey pink brown gold"
    rows = [(None, one), (7, one), (5, one), (5, one), (None, two), (None, two), (3, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = Counter(map(tuple, corpus_pipeline.duplicates(spark, docs, sf_dir).collect()))
    assert out == Counter([(5, one), (None, two), (3, None), (None, "")])


@pytest.mark.parametrize("name", ["quality", "language", "duplicates", "mixing"])
def test_any_names_of_columns(spark, sf_dir, name):
    docs = queries.table(spark, sf_dir, "documents").where("n_chars between 900 and 1500")
    stage = dict(corpus_pipeline.STAGES)[name]
    odd = ["row", "ROW_kept", "__row", "__kept", "__times", "__id", "__nth", "__found", "_row_id", "component_id", "rate", "a.b"]
    more = docs.selectExpr("*", *(f"doc_id + {i} AS `{c}`" for i, c in enumerate(odd)))
    out = stage(spark, more, sf_dir)
    assert out.columns == more.columns
    rows = out.collect()
    assert all(r[len(docs.columns) + i] == r.doc_id + i for r in rows for i in range(len(odd)))
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in stage(spark, docs, sf_dir).collect())
