import math
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions import canonical, types, warehouse
from evenkeel.functions.canonical import NULL, encode, plain_scalar, signature
from evenkeel.operators import compare, history, reconcile, sql_text
from evenkeel.sources import jobs, tables


@pytest.mark.parametrize(
    ("spelling", "name", "family"),
    [
        ("NUMBER(38,0)", "INT", "NUMERIC"), ("decimal(10,2)", "DECIMAL", "NUMERIC"), ("numeric", "DECIMAL", "NUMERIC"), ("INT64", "INT", "NUMERIC"), ("double  precision", "DOUBLE", "NUMERIC"),
        ("VARCHAR(20)", "STRING", "STRING"), ("struct<a int>", "STRUCT", "COMPLEX"), ("ARRAY<INT64>", "ARRAY", "COMPLEX"), ("map<string,int>", "MAP", "COMPLEX"), ("TIMESTAMP_NTZ(9)", "TIMESTAMP", "TIMESTAMP"),
        ("timestamp(3) with time zone", "TIMESTAMP", "TIMESTAMP"), ("DateTime", "TIMESTAMP", "TIMESTAMP"), ("date", "DATE", "DATE"), ("bool", "BOOLEAN", "BOOLEAN"), ("BYTES", "BINARY", "BINARY"),
        ("interval", "INTERVAL", "STRING"), ("geography", "GEOGRAPHY", "STRING"), (None, "UNKNOWN", "STRING"), (T.LongType(), "INT", "NUMERIC"), (T.DecimalType(9, 0), "INT", "NUMERIC"), (T.ArrayType(T.IntegerType()), "ARRAY", "COMPLEX"), (T.TimestampNTZType(), "TIMESTAMP", "TIMESTAMP"),
    ],
)
def test_type_names(spelling, name, family):
    assert types.canonical(spelling) == name and types.family(spelling) == family


def test_compatibility():
    assert types.compatible("number(9,2)", T.DoubleType()) and not types.compatible("date", "timestamp")
    assert types.common_name("int", "float64") == "NUMBER" and types.common_name("int", "text") == "STRING" and types.common_name("map<a,b>", "array<int>") == "COMPLEX"


def one(spark, value, kind, **options):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("c", kind)]))
    return df.select(encode("c", kind, **options)).first()[0]


def test_text_forms(spark):
    from datetime import date, datetime

    assert one(spark, None, T.StringType()) == NULL and one(spark, "null", T.StringType()) == "null" and one(spark, "", T.StringType()) == ""
    assert one(spark, " a|b\\ ", T.StringType()) == "a\\|b\\\\" and one(spark, "007", T.StringType()) == "007"
    assert [one(spark, x, T.DoubleType()) for x in (100.0, 10.5, -0.0, 1e20, float("nan"), 1e300)] == ["100", "10.5", "0", "100000000000000000000", "NaN", "1.0E300"]
    assert one(spark, Decimal("123.0000"), T.DecimalType(10, 4)) == "123" and one(spark, 100, T.LongType()) == "100"
    assert one(spark, True, T.BooleanType()) == "true" and one(spark, bytearray(b"\xab"), T.BinaryType()) == "AB"
    assert one(spark, date(2024, 1, 13), T.DateType()) == "2024-01-13"
    at = datetime(2024, 1, 13, 5, 6, 7, 891000)
    assert one(spark, at, T.TimestampNTZType()) == "2024-01-13 05:06:07.891" and one(spark, at, T.TimestampNTZType(), dates_only=True) == "2024-01-13"
    assert one(spark, {"b": 1, "a": 2}, T.MapType(T.StringType(), T.IntegerType())) == '{"a":2,"b":1}'
    assert one(spark, [1, None], T.ArrayType(T.IntegerType())) == "[1,null]"
    assert one(spark, '{"b":"2","a":"1"}', T.StringType(), sort_json=True, escape=False) == '{"a":"1","b":"2"}'
    a = spark.createDataFrame([("a|b", "c"), ("a", "b|c")], "x string, y string")
    assert len({r[0] for r in a.select(signature(a)).collect()}) == 2


def doubles():
    import random

    rng = random.Random(2)
    values = [0.0, 1e-3, 9.999e-4, 1e7, 9999999.5, 1.00000001, 1.000000001, 1.0000000011, 123456.12345678, 1e-9, -2.5, -100.0, 1e22, 1e-21, 9e-22, 5e-324, 1.7e308, float("nan"), float("inf"), -float("inf")]
    values += [round(rng.uniform(-1, 1) * 10 ** rng.randrange(-6, 12), rng.randrange(0, 12)) for _ in range(3000)] + [rng.uniform(-2, 2) * 10 ** rng.randrange(-25, 22) for _ in range(3000)]
    return values + [math.nextafter(v, 4.0) for v in values[20:]]


def test_texts_of_doubles_are_equal_only_for_equal_doubles(spark):
    values = {struct.pack(">d", v + 0.0): v for v in doubles()}
    rows = spark.createDataFrame([(v,) for v in values.values()], "c double").select("c", encode("c", T.DoubleType()).alias("t")).collect()
    assert len({r.t for r in rows}) == len(values)
    assert all(float(r.t) == r.c for r in rows if r.c == r.c)


def test_numbers_of_other_types_have_the_same_text(spark):
    for v in ("0", "5", "-2.5", "100", "12345678", "0.000125", "99999999.5"):
        forms = [one(spark, float(v), T.DoubleType()), one(spark, Decimal(v), T.DecimalType(30, 10)), one(spark, float(v), T.DoubleType(), coarse=True)]
        assert set(forms) == {v}
    assert one(spark, -0.0, T.DoubleType()) == "0" and one(spark, 0.1, T.FloatType()) == "0.1"


def test_no_two_values_share_a_text(spark):
    df = spark.createDataFrame([(None,), (NULL,), ("\\" + NULL,), ("a|b",), ("a\\|b",), ("",)], "c string")
    assert len({r[0] for r in df.select(encode("c", T.StringType())).collect()}) == 6
    nested = spark.createDataFrame([((["a|", "b"],), "x"), ((["a"],), '","b"],"x')], "n struct<l: array<string>>, t string")
    assert len({r[0] for r in nested.select(signature(nested)).collect()}) == 2
    times = spark.sql("SELECT timestamp_ntz '2024-01-01 00:00:00.000001' AS c UNION ALL SELECT timestamp_ntz '2024-01-01 00:00:00.000999'")
    assert times.select(encode("c", T.TimestampNTZType())).distinct().count() == 2 and times.select(encode("c", T.TimestampNTZType(), coarse=True)).distinct().count() == 1


def test_nested_json_in_order(spark):
    texts = ['{"Skill":["Data Science","Analytics"],"a":{"z":1.50,"b":[3, 10, 2e2]}}', ' {"a": {"b":[10,200,3.0],"z":1.5}, "Skill ": ["Analytics", "Data Science"]}', "[1]", "{bad", "[" * 3000, None]
    out = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "c string").select(canonical.json_in_order(F.col("c"))).collect()]
    assert out[0] == out[1] == '{"a":{"b":[10,200,3],"z":1.5},"Skill":["Analytics","Data Science"]}' and out[2] == "[1]" and out[3:] == [None] * 3


def test_folded_values_and_hashes(spark):
    assert one(spark, "  AbC ", T.StringType(), fold=True) == "abc"
    df = spark.createDataFrame([(" AB12CD ", "ab12cd")], "a string, b string")
    assert df.select(canonical.hash_value(F.col("a")) == canonical.hash_value(F.col("b"))).first()[0]


def test_plain_scalars(spark):
    cases = {"excel,python": "excel,python", "python, Excel": "Excel,python", "a,,b": "a,b", " AB ": "AB", "13-01-2024": "2024-01-13", "31-02-2024": "31-02-2024", "2024-01-13": "2024-01-13", "x,": "x,", '{"b":"2","a":"1"}': '{"a":"1","b":"2"}'}
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    assert [r[0] for r in df.select(plain_scalar(F.col("c"))).collect()] == list(cases.values())


def pair(spark):
    s = spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0), (2, "b", None), (3, "c", 3.0)], "k long, T string, x double")
    t = spark.createDataFrame([(1, "a", 1.0), (2, "b", 5.0), (3, "c", 3.0), (4, "d", 4.0)], "K long, t string, X double")
    return s, t


def test_multiset_semantics(spark):
    s, t = pair(spark)
    r = compare.row_hashes(s, t).first()
    assert (r.source_hash_count, r.target_hash_count, r.matched_hash_count, r.source_not_in_target_count, r.target_not_in_source_count, r.status) == (4, 4, 2, 2, 2, "FAIL")
    assert compare.row_hashes(s, s).first().status == "PASS" and compare.row_hashes(s.limit(0), s.limit(0)).first().similarity == 1.0
    assert compare.row_hashes(s, t, threshold=0.3).first().status == "PASS"
    assert {(d.k, d.column, d.source_value, d.target_value) for d in compare.column_differences(s, t, ["k"]).collect()} == {(2, "x", NULL, "5")}


def test_group_hashes_see_every_change(spark):
    s = spark.createDataFrame([("g", i, float(i)) for i in range(50)] + [(None, 1, 1.0)], "g string, a int, x double")
    same = compare.group_compare(s, s.orderBy(F.rand(3)), ["g"]).collect()
    assert {r.status for r in same} == {"MATCH"} and len(same) == 2
    moved = s.withColumn("x", F.when(F.col("a") == 7, 8.0).when(F.col("a") == 8, 7.0).otherwise(F.col("x")))
    assert {r.status for r in compare.group_compare(s, moved, ["g"]).collect()} == {"MATCH", "MISMATCH"}
    double = s.where("a <> 9").unionByName(s.where("a = 8"))
    assert "MISMATCH" in {r.status for r in compare.group_compare(s, double, ["g"]).collect()}


def test_whole_validation(spark):
    s, t = pair(spark)
    options = reconcile.Options(primary_keys=("k",), column_differences=True).with_metrics("all")
    record, details = reconcile.validate(reconcile.TablePair(s, t, options=options), run_by="me")
    r = record.first()
    assert (r.row_count, r.schema_check, r.numeric_check, r.hash_validation, r.run_by) == ("PASS", "PASS", "FAIL", "FAIL", "me")
    assert set(details) == {"row_count", "schema", "numeric", "null_counts", "row_hash", "mismatched_columns"}
    shallow, _ = reconcile.validate(reconcile.TablePair(s, t, options=options), validation_type="shallow")
    assert shallow.first().hash_validation is None
    grouped = reconcile.Options(categorical_columns=("T",)).with_metrics("hash")
    assert reconcile.validate(reconcile.TablePair(s, s, options=grouped))[0].first().hash_validation == "PASS"
    with pytest.raises(reconcile.GuardExceeded):
        reconcile.validate(reconcile.TablePair(s, t, options=reconcile.Options(row_guard=3).with_metrics("hash")))
    with pytest.raises(ValueError):
        reconcile.Options().with_metrics("speed")
    s.createOrReplaceTempView("pair_s")
    t.createOrReplaceTempView("pair_t")
    out = reconcile.run_config(spark, {"tables": [{"source": "pair_s", "target": "pair_t", "metrics": "row_count;hash", "row_threshold": 30}, {"source": "pair_s", "target": "pair_t", "validation_type": "shallow", "use_separate_where": True, "source_where": "k = 1", "target_where": "k = 3"}]}).collect()
    assert [(x.row_count, x.schema_check, x.hash_validation) for x in out] == [("PASS", None, "PASS"), ("FAIL", "PASS", None)]


def test_column_lists():
    for text in ('["BRANCH","ACCOUNT_TYPE"]', "BRANCH, ACCOUNT_TYPE", "['BRANCH', 'ACCOUNT_TYPE']", ["BRANCH", " ACCOUNT_TYPE"]):
        assert reconcile.column_list(text) == ["BRANCH", "ACCOUNT_TYPE"]
    assert reconcile.column_list(None) == [] and reconcile.threshold_of("95") == 0.95 and reconcile.threshold_of(0.9) == 0.9 and reconcile.threshold_of("") is None


def test_job_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿source_table,target_table,validation_type,metrics,case_sensitive,include_timestamp,categorical_columns\na.b.c,d.e.f,Deep,row_count;hash,yes,0,\"X, Y\"\na.b.c,d.e.f,shallow,all,,TRUE,\n")
    rows = jobs.table_jobs(spark, str(tmp_path / "a.csv")).collect()
    assert rows[0].metrics == ["row_count", "hash"] and rows[0].case_sensitive and not rows[0].include_timestamp and rows[0].categorical_columns == ["X", "Y"]
    assert rows[1].metrics == ["row_count", "schema", "numeric", "hash"] and rows[1].validation_type == "shallow" and rows[1].categorical_columns == []
    (tmp_path / "bad.csv").write_text("source_table,target_table,validation_type,metrics,case_sensitive,include_timestamp\na,b,odd,all,1,1\n")
    with pytest.raises(Exception, match="shallow or deep"):
        jobs.table_jobs(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "b.csv").write_text("# note\nsource_catalog,source_schema,source_table,target_catalog,target_schema,target_table,validation_type,where_clause,use_separate_where,source_where,row_threshold,primary_keys\nc,s,t,c2,s2,t2,deep,x > 1,true,y = 2,95,\"[a, b]\"\n")
    r = jobs.coordinate_jobs(spark, str(tmp_path / "b.csv")).first()
    assert (r.source_table, r.target_table, r.source_where, r.target_where, r.row_threshold, r.primary_keys) == ("c.s.t", "c2.s2.t2", "y = 2", "x > 1", 0.95, ["a", "b"])
    (tmp_path / "q.csv").write_text('id,sql\n1,"SELECT 1; SELECT \';\' AS a;"\n2,SELECT 2\n')
    assert [x.sql for x in jobs.query_file(spark, str(tmp_path / "q.csv")).collect()] == ["SELECT 1", "SELECT ';' AS a", "SELECT 2"]


def test_statements_end_at_semicolons_alone(spark):
    triple = "'" * 3
    text = f"SELECT 1 -- don't; stop\n; /* it's; */ SELECT `a;b`; SELECT {triple}x;'y{triple} || 'it\\'s;' ;; -- the end;\n; SELECT don't; SELECT 2"
    found = spark.createDataFrame([(text,)], "sql string").select(F.regexp_extract_all("sql", F.lit(jobs.STATEMENT), F.lit(1)).alias("x")).first().x
    assert [x.strip() for x in found if x.strip()] == ["SELECT 1 -- don't; stop", "/* it's; */ SELECT `a;b`", f"SELECT {triple}x;'y{triple} || 'it\\'s;'", "-- the end;", "SELECT don't", "SELECT 2"]


def test_texts_of_a_megabyte(spark, tmp_path):
    columns = ", ".join(f"a{i} AS 'b{i};'" for i in range(60_000))
    text = f"SELECT {columns} FROM t; SELECT '{'y' * 1_000_000}' ; -- last"
    (tmp_path / "q.csv").write_text('sql\n"' + text + '"\n')
    assert [len(x.sql) for x in jobs.query_file(spark, str(tmp_path / "q.csv")).collect()] == [len(x.strip()) for x in (text[: text.index("; SELECT '")], text[text.index("SELECT 'y") : -len("; -- last")])]
    row = sql_text.remains(sql_text.complexity(spark.createDataFrame([(text + "\n" + "WHERE a " * 50_000 + "IFF(1)",)], "sql string"))).first()
    assert row.residual == ["IFF"] and row.complexity_level


def test_upserts_and_status(spark):
    stored = spark.createDataFrame([("a", 1, "x"), ("b", 1, None)], "validation_id string, validation_ts int, run_by string")
    new = spark.createDataFrame([("a", 2, None), ("c", 1, "z"), ("b", 1, "w")], "validation_id string, validation_ts int, run_by string")
    assert {tuple(r) for r in history.upsert(stored, new).collect()} == {("a", 2, "x"), ("b", 1, "w"), ("c", 1, "z")}
    jobs_new = spark.createDataFrame([("a", "RUN", None, 1), ("a", "DONE", None, 2), ("b", None, "ok", 1), (None, "NEW", "x", 1)], "validation_id string, state string, note string, at int")
    jobs_old = spark.createDataFrame([("a", "OLD", "first", 0), ("b", "OLD", "first", 0)], jobs_new.schema)
    assert {tuple(r) for r in history.job_upsert(jobs_old, jobs_new, order="at").collect()} == {("a", "DONE", "first", 2), ("b", None, "ok", 1), (None, "NEW", "x", 1)}
    df = spark.createDataFrame([(None, None), ("pass", "None"), ("PASS", "error"), ("PASS", "FAIL")], "a string, b string")
    assert [r[0] for r in df.select(history.overall_status(["a", "b"])).collect()] == ["ERROR", "PASS", "ERROR", "FAIL"]


def test_sql_texts(spark):
    df = spark.createDataFrame([("select 1",), ("SELECT a FROM t WHERE x = 'QUALIFY' -- UNNEST(a)",), ("WITH RECURSIVE r AS (SELECT 1) SELECT * FROM r JOIN s ON 1=1",), ("SELECT SAFE_CAST(a AS INT64) FROM UNNEST(x)",)], "sql string")
    out = sql_text.remains(sql_text.complexity(df)).collect()
    assert [r.complexity_level for r in out] == ["SIMPLE", "SIMPLE", "COMPLEX", "SIMPLE"] and out[2].complexity_score == 30 + 14 + 14 + 3 + 5 + 4
    assert [r.is_clean for r in out] == [True, True, True, False] and out[3].residual == ["SAFE_CAST", "UNNEST", "INT64"]


def test_formats():
    assert warehouse.java_pattern("%d/%m/%Y at %H") == "dd/MM/yyyy 'a''t' HH"
    with pytest.raises(ValueError, match="%Q"):
        warehouse.java_pattern("%Q")


def test_signs_null_keys_and_odd_names(spark):
    df = spark.createDataFrame([(-100, 100), (0, 1), (95, 100), (-95, -100)], "a int, b int")
    assert [r[0] for r in df.select(compare.ratio_status(F.col("a"), F.col("b"), 0.95)).collect()] == ["FAIL", "FAIL", "PASS", "PASS"]
    s = spark.createDataFrame([(None, 1, "x"), (1, None, "y"), (2, 2, "z")], "`k.a` int, k2 int, `v.1` string")
    t = spark.createDataFrame([(None, 1, "X"), (1, None, "y"), (3, 3, "z")], "`k.a` int, k2 int, `v.1` string")
    assert {tuple(r) for r in compare.column_differences(s, t, ["k.a", "k2"]).collect()} == {(None, 1, "v.1", "x", "X")}
    assert [r[1] for r in compare.keys_missing(s, t, ["k.a", "k2"]).collect()] == [2]
    assert {r.status for r in compare.group_compare(s, s, ["k.a"]).collect()} == {"MATCH"}


def test_a_failing_check_is_an_error_and_the_others_go_on(spark, tmp_path):
    s, t = pair(spark)
    broken = reconcile.TablePair(s, t, options=reconcile.Options(categorical_columns=("none",)).with_metrics("row_count,hash"))
    record, details = reconcile.validate(broken)
    assert (record.first().row_count, record.first().hash_validation) == ("PASS", "ERROR") and details["errors"].first().check == "hash"
    s.createOrReplaceTempView("job_s")
    t.createOrReplaceTempView("job_t")
    (tmp_path / "a.csv").write_text("source_table,target_table,validation_type,metrics,case_sensitive,include_timestamp\njob_s,job_t,deep,row_count;hash,no,0\njob_s,missing,deep,all,no,0\njob_s,job_s,deep,hash,no,1\n")
    out = reconcile.run_jobs(spark, jobs.table_jobs(spark, str(tmp_path / "a.csv"))).collect()
    assert [(r.row_count, r.schema_check, r.hash_validation) for r in out] == [("PASS", None, "FAIL"), ("ERROR", "ERROR", "ERROR"), (None, None, "PASS")]
    assert reconcile.run_config(spark, {"tables": []}).count() == 0


def test_query_results_are_kept_and_deleted(spark, tmp_path):
    s, t = pair(spark)
    record, _ = reconcile.validate_queries(spark, "SELECT * FROM {a}", "SELECT * FROM {b}", reconcile.Options().with_metrics("row_count"), folder=str(tmp_path), a=s, b=t)
    assert record.first().row_count == "PASS" and list(tmp_path.iterdir()) == []


def test_catalog_and_database(spark, tmp_path):
    assert "spark_catalog" in {r.catalog for r in tables.catalogs(spark).collect()}
    assert "default" in {r.schema for r in tables.schemas(spark, "spark_catalog").collect()}
    assert tables.tables(spark, "spark_catalog", "default").columns == ["catalog", "schema", "table"]
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(100).selectExpr("id AS ID", "id % 7 AS G").write.format("jdbc").options(url=url, dbtable="T", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    got = tables.jdbc(spark, url, "T", split_on="ID", parts=4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert got.count() == 100 and got.rdd.getNumPartitions() == 4 and got.where("G = 3").count() == 14
