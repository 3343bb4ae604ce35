"""Hashes and figures that differ wherever values do, and runs that no bad row ends."""

import json
import math
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions import canonical, warehouse
from evenkeel.functions.canonical import encode, row_hash
from evenkeel.operators import compare, reconcile
from evenkeel.sources import jobs


def ordered(texts, trim=False):
    return [canonical._json_text(t, trim) for t in texts]


def test_json_that_isnt_equal_has_another_text():
    pairs = [
        ("[12345678901234567890123456789012]", "[12345678901234567890123456789013]"),
        ("[0.1234567890123456789012345678901]", "[0.1234567890123456789012345678902]"),
        ('{" a":1}', '{"a":1}'), ('{"a":1,"a":2}', '{"a":2}'), ('["\\ud800"]', '["\\ud801"]'), ('["\\ud800"]', '["\\\\ud800"]'), ("[1e500]", "[1e501]"), ("[1]", '["1"]'), ('[" a"]', '["a"]'), ("[null]", '["null"]'), ("[true]", '["true"]'), ("[-1e-700]", "[1e-700]"),
    ]
    for a, b in pairs:
        one, two = ordered([a, b])
        assert one != two and None not in (one, two), (a, b)
        one.encode()
    assert ordered(["[1.50, 1e2, 0.0, -0]", "[100, 1.5, 0, 0e9]"])[0] == ordered(["[100, 1.5, 0, 0e9]"])[0] == "[0,0,1.5,100]"
    assert ordered(["[1e400000000]"]) == ["[1E400000000]"] and ordered(["[NaN]", "[1e9999999999999999999999]"])[0] is None
    assert ordered([' {"b ": 1}', '{"b":1}'], trim=True) == ['{"b":1}'] * 2


VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.decimals(allow_nan=False, allow_infinity=False, places=12) | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8)


def plain(v):
    """What two JSON values have in common if they are equal: members in no order, numbers by value."""
    if isinstance(v, dict):
        return ("o", frozenset((k, plain(x)) for k, x in v.items()))
    if isinstance(v, list):
        return ("l", tuple(sorted((plain(x) for x in v), key=repr)))
    if isinstance(v, (int, Decimal)) and not isinstance(v, bool):
        return ("n", Decimal(v))
    return (type(v).__name__, v)


def dumped(v):
    if isinstance(v, Decimal):
        return format(v, "f")
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k)}: {dumped(x)}" for k, x in reversed(list(v.items()))) + "}"
    return "[" + ", ".join(map(dumped, v)) + "]" if isinstance(v, list) else json.dumps(v)


@settings(max_examples=400, deadline=None)
@given(VALUES, VALUES)
def test_json_texts_are_equal_as_their_values_are(a, b):
    one, two = ordered([f"[{dumped(a)}]", f"[{dumped(b)}]"])
    assert (one == two) == (plain(a) == plain(b))


def test_texts_keep_their_padding_where_asked(spark):
    df = spark.createDataFrame([("a",), (" a",), ("a ",), ("",), (" ",), (None,), ('{"a":1}',), ('{" a":1}',), ('["\\ud800"]',)], "c string")
    assert df.select(row_hash(df, trim=False, sort_json=True)).distinct().count() == 9
    assert df.select(row_hash(df)).distinct().count() == 6
    s, t = spark.createDataFrame([(1, "a")], "k int, t string"), spark.createDataFrame([(1, " a")], "k int, t string")
    record = lambda trim: reconcile.validate(reconcile.TablePair(s, t, options=reconcile.Options(trim=trim).with_metrics("hash")))[0].first().hash_validation
    assert (record(True), record(False)) == ("PASS", "FAIL")
    assert [r.source_value for r in compare.column_differences(s, t, ["k"], trim=False).collect()] == ["a"] and compare.column_differences(s, t, ["k"]).count() == 0


def test_nested_values(spark):
    form = lambda sql: spark.sql(f"SELECT {sql} AS c").select(F.col("c")).schema[0].dataType
    text = lambda sql: spark.sql(f"SELECT {sql} AS c").select(encode("c", form(sql))).first()[0]
    same = [("array(0.0D)", "array(-0.0D)"), ("named_struct('x', array(-0.0D), 'y', CAST(NULL AS FLOAT))", "named_struct('x', array(0.0D), 'y', CAST(NULL AS FLOAT))"), ("map('b', map('x', 1, 'y', 2), 'a', map())", "map('a', map(), 'b', map('y', 2, 'x', 1))"), ("map(1, -0.0D)", "map(1, 0.0D)")]
    for a, b in same:
        assert text(a) == text(b)
    others = [("array(timestamp_ntz '2024-01-01 00:00:00.000001')", "array(timestamp_ntz '2024-01-01 00:00:00.000002')"), ("array(timestamp '2024-01-01 00:00:00.000001')", "array(timestamp '2024-01-01 00:00:00.000002')"), ("array(CAST(NULL AS DOUBLE))", "array(0.0D)"), ("named_struct('x', CAST(NULL AS STRUCT<y: DOUBLE>))", "named_struct('x', named_struct('y', CAST(NULL AS DOUBLE)))")]
    for a, b in others:
        assert text(a) != text(b), (a, b)


@pytest.mark.parametrize(("kind", "a", "b"), [("bigint", 9007199254740993, 9007199254740992), ("decimal(30,2)", Decimal("1234567890123456789012345678.01"), Decimal("1234567890123456789012345678.02")), ("decimal(38,0)", Decimal(10**37 + 1), Decimal(10**37))])
def test_extremes_are_compared_as_they_are(spark, kind, a, b):
    s, t = (spark.createDataFrame([(v,)], f"x {kind}") for v in (a, b))
    assert compare.numeric_stats_compare(s, t).first().status == "FAIL" and compare.numeric_stats_compare(s, s).first().status == "PASS"
    assert compare.numeric_stats_compare(s, t, threshold=0.9).first().status == "PASS"
    status = lambda x, y, **o: reconcile.validate(reconcile.TablePair(x, y, options=reconcile.Options(**o).with_metrics("numeric")))[0].first().numeric_check
    assert (status(s, t), status(s, s), status(s, t, threshold=0.9)) == ("FAIL", "PASS", "PASS")


def test_statistics_of_other_types(spark):
    s = spark.createDataFrame([(1, 1.00001, Decimal("1.5")), (None, None, None)], "a int, b double, c decimal(5,1)")
    t = s.select(F.col("a").cast("long"), F.col("b") + 1e-9, F.col("c").cast("double"))
    t = t.toDF("a", "b", "c")
    rows = {r.column: r for r in compare.numeric_stats_compare(s, t).collect()}
    assert {r.status for r in rows.values()} == {"PASS"} and rows["a"].source_null_count == rows["a"].target_null_count == 1
    empty = {r.column: r.status for r in compare.numeric_stats_compare(s.limit(0), t.limit(0)).collect()}
    assert set(empty.values()) == {"PASS"} and compare.numeric_stats_compare(s.limit(0), t).where("status = 'PASS'").count() == 0
    nan = spark.createDataFrame([(math.nan,)], "x double")
    assert reconcile.validate(reconcile.TablePair(nan, nan, options=reconcile.Options().with_metrics("numeric")))[0].first().numeric_check == "PASS"
    assert compare.numeric_stats_compare(spark.createDataFrame([("x",)], "t string"), nan).count() == 0


def test_bad_rows_end_nothing_but_themselves(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string").createOrReplaceTempView("runner_s")
    spark.createDataFrame([(1, "a"), (3, "b")], "k int, t string").createOrReplaceTempView("runner_t")
    good = {"source": "runner_s", "target": "runner_s", "metrics": "row_count,hash"}
    bad = [good | {"metrics": "speed"}, good | {"row_threshold": "abc"}, {"source": "runner_s", "metrics": "hash"}, good | {"validation_type": "shalow"}, good | {"target": "nowhere"}, "text"]
    out, details = reconcile.run_config_detailed(spark, {"tables": [good, *bad, good | {"target": "runner_t"}]})
    rows = out.collect()
    assert [bool(r.errors) for r in rows] == [False, *[True] * 6, False]
    for r, message in zip(rows[1:7], ("unknown metrics: speed", "abc", "no target table", "shalow", "nowhere", "no target table")):
        assert message in r.errors[0].message and "ERROR" in (r.row_count, r.hash_validation)
    assert (rows[0].row_count, rows[0].hash_validation, rows[7].hash_validation) == ("PASS", "PASS", "FAIL")
    assert {(r.side, r.k, r.t) for r in details[7]["row_examples"].collect()} == {("source", 2, "b"), ("target", 3, "b")}
    assert details[1] == {} and rows[3].src_table_name == "runner_s"
    # a check that fails inside a pair keeps its message in the record
    odd = reconcile.run_config(spark, {"tables": [good | {"categorical_columns": "none"}]}).first()
    assert odd.row_count == "PASS" and odd.hash_validation == "ERROR" and odd.errors[0].check == "hash"
    (tmp_path / "a.csv").write_text("source_table,target_table,validation_type,metrics,case_sensitive,include_timestamp\nrunner_s,runner_s,deep,hash,no,0\nrunner_s,runner_s,shalow,hash,no,0\nrunner_s,runner_s,deep,speed,no,0\nrunner_s,,deep,hash,no,0\nrunner_s,runner_s,shallow,,no,0\n")
    found = reconcile.run_jobs(spark, jobs.table_jobs(spark, str(tmp_path / "a.csv"), strict=False)).collect()
    assert [len(r.errors) for r in found] == [0, 1, 1, 1, 0] and found[4].row_count == "PASS"
    (tmp_path / "b.csv").write_text("source_catalog,source_schema,source_table,target_catalog,target_schema,target_table,validation_type,row_threshold\nc,s,t,c,s,t,deep,abc\nc,s,t,c,s,t,deep,\n")
    found = reconcile.run_jobs(spark, jobs.coordinate_jobs(spark, str(tmp_path / "b.csv"))).collect()
    assert "row_threshold is no number: abc" in found[0].errors[0].message and "abc" not in found[1].errors[0].message


def test_mismatched_columns_without_keys_are_in_the_details(spark):
    s = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string")
    t = spark.createDataFrame([(1, "a"), (2, "c")], "k int, t string")
    _, details = reconcile.validate(reconcile.TablePair(s, t, options=reconcile.Options(column_differences=True).with_metrics("hash")))
    assert [tuple(r) for r in details["mismatched_columns"].collect()] == [("t", 1)]


def test_time_slices_after_2038(spark):
    df = spark.sql("SELECT timestamp_ntz '2100-03-04 05:06:07.5' AS t UNION ALL SELECT timestamp_ntz '1890-03-04 05:06:07.5' UNION ALL SELECT NULL")
    cut = lambda n, unit: [str(r[0]) for r in df.select(warehouse.time_slice("t", n, unit)).collect()]
    assert cut(15, "minute") == ["2100-03-04 05:00:00", "1890-03-04 05:00:00", "None"]
    assert cut(1, "week") == ["2100-03-01 00:00:00", "1890-03-03 00:00:00", "None"]
    assert cut(7, "second")[0] == "2100-03-04 05:06:01" and cut(2, "day")[0] == "2100-03-04 00:00:00"
