import hashlib

import pytest
from pyspark.sql import functions as F

from evenkeel.llm import queries
from evenkeel.llm.exact_dedup import exact_groups


def brute(rows, keep="largest"):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        best = (max if keep == "largest" else min)(ids) if ids else None
        out.append((i, best, len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(i, t) for i, t in enumerate(["a", "b", "a", "", None, "a ", "A", "é", "é", "x" * 300_000, "x" * 300_000, "x" * 299_999 + "y", "a"])]
ROWS += [(None, "lonely"), (None, "a"), (None, "nobody"), (None, "nobody"), (7, "é"), (-3, "b"), (100, "again"), (100, "again")] + [(1000 + i, "hot") for i in range(400)]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("parts", [1, 40])
def test_groups(spark, keep, parts):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("n", F.lit(0)).withColumn("sha", F.lit("x")).withColumn("kept", F.lit(None).cast("boolean"))
    got = exact_groups(df.repartition(parts), keep=keep).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(ROWS, keep)
    # exactly one row of each text stays, and it has the best id
    stays = [r for r in got if r.kept]
    assert len({r.text_sha256 for r in stays}) == len(stays) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in stays)


def test_runs_longer_than_a_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = exact_groups(spark.createDataFrame(ROWS, "doc_id long, text string").repartition(20)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(ROWS)


def test_empty_table_and_bad_option(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_groups(df).count() == 0
    with pytest.raises(ValueError):
        exact_groups(df, keep="first")


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_exact_runs(spark, sf_dir).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
