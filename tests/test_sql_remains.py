"""Each construct of SURVEY C.3 that Spark does not run is found where it stands alone."""

import pytest

from evenkeel.operators import sql_text

ALONE = [
    ("SELECT * FROM t WHERE a IN UNNEST(b)", {"UNNEST", "IN_UNNEST"}), ("SELECT a IN LATERAL VIEW explode(b)", {"IN_LATERAL_VIEW"}), ("SELECT a FROM t\nWHERE x\nLATERAL VIEW explode(b) c", {"WHERE_LATERAL_VIEW"}),
    ("SELECT array_length(a)", {"ARRAY_LENGTH"}), ("SELECT SAFE_MULTIPLY(a, b)", {"SAFE_MULTIPLY"}), ("SELECT SAFE_ADD(a, b)", {"SAFE_ADD"}), ("SELECT SAFE_SUBTRACT(a, b)", {"SAFE_SUBTRACT"}), ("SELECT SAFE_NEGATE(a)", {"SAFE_NEGATE"}),
    ("SELECT FARM_FINGERPRINT(a)", {"FARM_FINGERPRINT"}), ("SELECT GENERATE_TIMESTAMP_ARRAY(a, b, c)", {"GENERATE_TIMESTAMP_ARRAY"}), ("SELECT DATE_TRUNC(d, MONTH)", {"DATE_TRUNC"}),
    ("SELECT JSON_EXTRACT(p, '$.k')", {"JSON_EXTRACT"}), ("SELECT JSON_EXTRACT_SCALAR(p, '$.k')", {"JSON_EXTRACT_SCALAR"}), ("SELECT JSON_EXTRACT_ARRAY(p)", {"JSON_EXTRACT_ARRAY"}),
    ("SELECT TO_HEX(a)", {"TO_HEX"}), ("SELECT FROM_HEX(a)", {"FROM_HEX"}), ("SELECT TO_BASE64(a)", {"TO_BASE64"}), ("SELECT FROM_BASE64(a)", {"FROM_BASE64"}), ("SELECT NET.HOST(a)", {"NET"}),
    ("SELECT 1;\nDECLARE x DEFAULT 1", {"DECLARE"}), ("{% call set_sql_header(config) %}", {"SET_SQL_HEADER"}), ("SELECT o.get(f, 0)", {"GET_FIELD"}),
    ("SELECT a[OFFSET(0)]", {"OFFSET"}), ("SELECT a[SAFE_OFFSET(i)]", {"SAFE_OFFSET"}), ("SELECT a[ORDINAL(1)]", {"ORDINAL"}), ("SELECT CAST(a AS BOOL)", {"BOOL"}),
    # valid in Spark 4.1
    ("SELECT array_agg(a), count_if(b), struct(a AS x), date_trunc('MONTH', d), CAST(b AS BOOLEAN), 'TO_HEX(a)' FROM t -- NET.HOST(a)\nLIMIT 1 OFFSET 2", set()), ("SELECT a FROM t LATERAL VIEW explode(b) c WHERE a > 1", set()),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, sql) for i, (sql, _) in enumerate(ALONE)], "i int, sql string")
    return {r.i: r for r in sql_text.remains(df).collect()}


@pytest.mark.parametrize("i", range(len(ALONE)))
def test_alone(found, i):
    assert set(found[i].residual) == ALONE[i][1] and found[i].is_clean == (not ALONE[i][1])


def test_spark_runs_what_is_left_out(spark):
    spark.sql("SELECT array_agg(a), count_if(a > 1), any_value(struct(a AS x)) FROM VALUES (1), (2) AS t(a)").collect()
    with pytest.raises(Exception):
        spark.sql("SELECT CAST(1 AS BOOL)").collect()
