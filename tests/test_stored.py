import os

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import compare, hash_tree
from evenkeel.plans.reconciliation import lines
from evenkeel.sources import files
from evenkeel.sources.store import KeyedStore, TextCache, text_key
from evenkeel.sources.tables import materialise

SCHEMA = "validation_id string, validation_ts int, run_by string"


def bucket_files(path):
    return {b: sorted(f for f in os.listdir(f"{path}/{b}") if f.endswith(".parquet")) for b in os.listdir(path) if b.startswith("bucket=")}


def rows(spark, *values):
    return spark.createDataFrame(values, SCHEMA)


def test_upsert_leaves_other_buckets_alone(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", SCHEMA, "validation_id", buckets=8)
    assert store.read().count() == 0
    store.upsert(rows(spark, *((f"v{i}", 1, f"u{i}") for i in range(60)), (None, 1, "nobody")))
    before = bucket_files(f"{tmp_path}/s")
    touched = store.upsert(rows(spark, ("v3", 2, None), ("new", 1, None), ("v4", 0, "late")))
    after = bucket_files(f"{tmp_path}/s")
    assert 0 < len(touched) <= 3 and {b for b in after if after[b] != before.get(b)} == {f"bucket={b}" for b in touched}
    got = {r.validation_id: (r.validation_ts, r.run_by) for r in store.read().collect()}
    assert len(got) == 62 and got["v3"] == (2, "u3") and got["new"] == (1, None) and got["v4"] == (1, "u4") and got[None] == (1, "nobody")
    assert store.get("v3").first().validation_ts == 2 and store.get("none").count() == 0 and store.get(None).count() == 1
    assert store.upsert(rows(spark).limit(0)) == []


def test_killed_runs(spark, tmp_path):
    path = f"{tmp_path}/s"
    store = KeyedStore(spark, path, SCHEMA, "validation_id", buckets=4)
    store.upsert(rows(spark, *((f"v{i}", 1, "a") for i in range(20))))
    old = sorted(map(tuple, store.read().collect()))

    def failing(before, new):
        return before.unionByName(new).withColumn("run_by", F.when(F.col("validation_id") == "v7", F.raise_error(F.lit("stop"))).otherwise(F.col("run_by")))

    with pytest.raises(Exception, match="stop"):
        store.merge(rows(spark, *((f"v{i}", 2, "b") for i in range(20))), failing)
    assert sorted(map(tuple, store.read().collect())) == old
    again = KeyedStore(spark, path, SCHEMA, "validation_id", buckets=4)  # deletes what wasn't finished
    assert not [n for n in os.listdir(path) if n.startswith("_staged")] and sorted(map(tuple, again.read().collect())) == old
    # killed while finished folders change places: the next one that opens the table goes on
    moved = []
    real = files.move

    def dying(spark, a, b):
        if moved:
            raise OSError("killed")
        moved.append(b)
        real(spark, a, b)

    files.move = dying
    try:
        with pytest.raises(OSError, match="killed"):
            again.upsert(rows(spark, *((f"v{i}", 3, "c") for i in range(20))))
    finally:
        files.move = real
    last = KeyedStore(spark, path, SCHEMA, "validation_id", buckets=4)
    assert {r.validation_ts for r in last.read().collect()} == {3} and last.read().count() == 20


def test_cache(spark, tmp_path):
    cache = TextCache(spark, f"{tmp_path}/c", buckets=4)
    at = lambda d: F.to_timestamp_ntz(F.lit(f"2024-01-{d:02d} 00:00:00"))
    key = lambda t, *c: text_key(F.lit(t), *map(F.lit, c)).alias("text_key")
    put = lambda t, r, d: cache.put(spark.range(1).select(key(t, "trino"), F.lit(t).alias("text"), F.lit(r).alias("result")), at(d), days=10)
    put("SELECT  1", "one", 1)
    put("SELECT 2", "two", 5)
    put(" SELECT 1\n", "uno", 2)
    asked = spark.range(3).select(key("SELECT 1", "trino")).union(spark.range(1).select(key("SELECT 1", "snowflake"))).union(spark.range(1).select(key("SELECT 2", "trino")))
    assert sorted(str(r.result) for r in cache.lookup(asked, at(6)).collect()) == ["None", "two", "uno", "uno", "uno"]
    assert sorted(str(r.result) for r in cache.lookup(asked, at(13)).collect()) == ["None", "None", "None", "None", "two"]
    assert cache.stats(at(13)).first().asDict() == {"entries": 2, "accesses": 5, "expired": 1, "average_accesses": 2.5}
    cache.expire(at(13))
    assert [r.result for r in cache.store.read().collect()] == ["two"]


def test_tables_are_replaced_whole(spark, tmp_path):
    place, name = str(tmp_path), f"made_{tmp_path.name.replace('-', '_')}.t"
    assert materialise(spark.range(3), name, location=place).count() == 3
    with pytest.raises(Exception, match="stop"):
        materialise(spark.range(9).select(F.raise_error(F.lit("stop")).alias("x")), name, location=place)
    assert spark.table(name).count() == 3 and spark.sql(f"SHOW TABLES IN {name.split('.')[0]}").count() == 1
    assert materialise(spark.range(5).selectExpr("id", "id AS more"), name, location=place).columns == ["id", "more"] and spark.table(name).count() == 5


def test_columns_without_keys(spark, sf_dir):
    found = {r.column: r.rows for r in compare.mismatched_without_keys(*lines(spark, sf_dir)).collect()}
    assert list(found) == ["l_quantity"] and found["l_quantity"] > 100
    s = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (2, "b", 2.0)], "k int, t string, x double")
    assert compare.mismatched_without_keys(s, s.orderBy("x")).count() == 0
    two = s.withColumns({"t": F.lit("z"), "x": F.lit(9.0)})
    assert sorted((r.column, r.rows) for r in compare.mismatched_without_keys(s, two).collect()) == [("t", 0), ("x", 0)]
    assert compare.mismatched_without_keys(s.limit(0), s.limit(0)).count() == 0


@pytest.mark.parametrize(("changed", "sent"), [(0, 10**5), (1, 10**5), (5000, 10**5), (5000, 40)])
def test_tree(spark, monkeypatch, changed, sent):
    monkeypatch.setattr(hash_tree, "MOST_SENT", sent)
    s = spark.range(6000).selectExpr("id % 5500 AS id", "concat('t', id) AS t", "CASE WHEN id % 7 = 0 THEN NULL ELSE id * 0.5D END AS x")
    t = s.withColumn("t", F.when(F.col("id") < changed, F.concat("t", F.lit("?"))).otherwise(F.col("t"))).where(f"NOT (id = 5400 AND {changed} > 0)")
    t = t.unionByName(s.where(f"id = 3 AND {changed} = 1"))
    columns = compare.row_hashes(s, t).columns
    assert hash_tree.row_hashes(s, t).select(*columns).collect() == compare.row_hashes(s, t).collect()
    examples = hash_tree.unmatched_rows(s, t, most=20).collect()
    for side, df in (("source", s), ("target", t)):
        want = compare.rows_only(s, t, side).orderBy("row_hash").limit(20).collect()
        mine = [r for r in examples if r.side == side]
        assert [(r.row_hash, r.surplus) for r in sorted(mine, key=lambda r: r.row_hash)] == [tuple(r) for r in want]
        whole = {r.row_hash: (r.id, r.t, r.x) for r in compare.rows_with_hashes(df, compare.rows_only(s, t, side)).collect()}
        assert all((r.id, r.t, r.x) == whole[r.row_hash] for r in mine)


def test_tree_of_empty_tables(spark):
    s = spark.range(0).selectExpr("id", "'x' AS t")
    assert hash_tree.row_hashes(s, s).first().status == "PASS" and hash_tree.unmatched_rows(s, s).count() == 0
    assert hash_tree.row_hashes(s, spark.range(1).selectExpr("id", "'x' AS t")).first().target_not_in_source_count == 1
