import pytest

from evenkeel.operators import sql_text

TRIPLE = '"' * 3


@pytest.mark.parametrize(
    ("sql", "residual"),
    [
        ('SELECT "a -- b", SAFE_DIVIDE(a,b)', ["SAFE_DIVIDE"]), ('SELECT "UNNEST(x)"', []), ("SELECT 1 # QUALIFY", []), ("SELECT '# x', IFF(1,2,3)", ["IFF"]), ("SELECT `IFF(`, 1 -- it's\n, TO_HEX(a)", ["TO_HEX"]),
        (f"SELECT {TRIPLE}a \" IFF(1) ' b{TRIPLE}, FROM_HEX(x)", ["FROM_HEX"]), ("SELECT don't, IFF(1,2,3)", ["IFF"]), ("SELECT 'a\\' IFF(' , \"it's\", IFF(1)", ["IFF"]), ("/* ' */ SELECT COUNTIF(x) /* open", ["COUNTIF"]), ("", []),
    ],
)
def test_what_stands_in_quotes_and_comments(spark, sql, residual):
    assert sql_text.remains(spark.createDataFrame([(sql,)], "sql string")).first().residual == residual


def test_every_construct_has_a_suggestion():
    assert list(sql_text.INSTEAD) == [name for name, _ in sql_text.REMAINS]


def test_kinds(spark):
    texts = ["SELECT 1", "SELECT IFF(1,2,3)", "SELECT {{ x }}, IFF(1,2,3)", "BEGIN TRANSACTION; SELECT 1", "FOR x IN (SELECT 1) DO SELECT 2; END FOR", "IF a > 1 THEN SELECT 1; END IF", None]
    out = {r.sql: r for r in sql_text.lint(spark.createDataFrame([(t,) for t in texts], "sql string")).collect()}
    assert [out[t].reviewed for t in texts] == [None, None, "TEMPLATE", "TRANSACTION", "SCRIPT", "SCRIPT", None]
    assert [out[t].error_type for t in texts] == [None, "RESIDUAL_SYNTAX", None, None, None, None, None] and out[texts[1]].suggestions == ["IFF: if(condition, a, b)"]


def test_sparks_parser(spark):
    assert sql_text.parse_error(spark, "SELECT a, b FROM t WHERE x > 1") is None
    found = sql_text.parse_error(spark, "SELECT a\nFROM t WHERE )")
    assert found["error_type"] == "PARSE_SYNTAX_ERROR" and found["line_number"] == 2
