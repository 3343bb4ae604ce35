"""Queries over a history of validation runs and of translated queries, derived from orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.operators import history, sql_text
from evenkeel.plans.registry import query, table

# A run for each order: its customer's table, statuses from its key and price.
_RUNS = """runs AS (SELECT 'v' || o_orderkey AS validation_id, o_orderdate AS validation_ts, 'src.t' || (o_custkey % 40) AS src_table_name, 'tgt.t' || (o_custkey % 40) AS tgt_table_name,
  CASE WHEN o_orderkey % 9 = 0 THEN 'FAIL' ELSE 'pass' END AS row_count, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'FAIL' ELSE 'PASS' END AS schema_check,
  CASE WHEN o_orderkey % 13 = 0 THEN 'ERROR' WHEN o_orderkey % 3 = 0 THEN 'None' ELSE 'PASS' END AS numeric_check, CASE WHEN o_totalprice > 400000 THEN 'FAIL' ELSE 'PASS' END AS hash_validation,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'user' || (o_custkey % 7) END AS run_by, CASE o_orderkey % 4 WHEN 0 THEN ' BigQuery' WHEN 1 THEN 'trino' WHEN 2 THEN '' END AS source_engine FROM orders)"""


def runs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('v', o_orderkey) AS validation_id",
        "o_orderdate AS validation_ts",
        "concat('src.t', o_custkey % 40) AS src_table_name",
        "concat('tgt.t', o_custkey % 40) AS tgt_table_name",
        "CASE WHEN o_orderkey % 9 = 0 THEN 'FAIL' ELSE 'pass' END AS row_count",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'FAIL' ELSE 'PASS' END AS schema_check",
        "CASE WHEN o_orderkey % 13 = 0 THEN 'ERROR' WHEN o_orderkey % 3 = 0 THEN 'None' ELSE 'PASS' END AS numeric_check",
        "CASE WHEN o_totalprice > 400000 THEN 'FAIL' ELSE 'PASS' END AS hash_validation",
        "CASE WHEN o_orderkey % 4 <> 0 THEN concat('user', o_custkey % 7) END AS run_by",
        "CASE o_orderkey % 4 WHEN 0 THEN ' BigQuery' WHEN 1 THEN 'trino' WHEN 2 THEN '' END AS source_engine",
    )


@query(f"""WITH {_RUNS} SELECT count(DISTINCT src_table_name || '|' || tgt_table_name) AS tables_validated, count(*) AS total_runs, """ + ", ".join(f"count(*) FILTER (upper({c}) = '{s.upper()}') AS {n}_{s}" for s in ("pass", "fail") for c, n in (("row_count", "row_count"), ("schema_check", "schema"), ("numeric_check", "numeric"), ("hash_validation", "row_hash"))) + " FROM runs")
def dashboard_stats(spark, sf_dir):
    return history.dashboard(runs(spark, sf_dir))


_OVERALL = """CASE WHEN 'ERROR' IN (coalesce(row_count, ''), coalesce(schema_check, ''), coalesce(numeric_check, ''), coalesce(hash_validation, '')) THEN 'ERROR'
  WHEN upper(row_count) = 'PASS' AND coalesce(schema_check, 'PASS') = 'PASS' AND numeric_check IN ('PASS', 'None') AND hash_validation = 'PASS' THEN 'PASS' ELSE 'FAIL' END"""


@query(f"WITH {_RUNS}, o AS (SELECT {_OVERALL} AS status FROM runs) SELECT count(*) AS total, count(*) FILTER (status = 'PASS') AS pass_count, count(*) FILTER (status = 'FAIL') AS fail_count, count(*) FILTER (status = 'ERROR') AS error_count FROM o")
def status_rollup(spark, sf_dir):
    return history.status_counts(runs(spark, sf_dir))


@query(f"WITH {_RUNS} SELECT validation_id, validation_ts FROM runs WHERE validation_ts >= DATE '1997-03-01' AND validation_ts < DATE '1997-04-01'")
def history_date_filter(spark, sf_dir):
    return history.between(runs(spark, sf_dir), "1997-03-01", "1997-03-31").select("validation_id", "validation_ts")


@query(f"WITH {_RUNS} SELECT validation_id, coalesce(nullif(lower(trim(source_engine)), ''), 'snowflake') AS engine FROM runs WHERE coalesce(nullif(lower(trim(source_engine)), ''), 'snowflake') = 'snowflake'")
def history_engine_filter(spark, sf_dir):
    return history.of_engine(runs(spark, sf_dir), "Snowflake").select("validation_id", F.lit("snowflake").alias("engine"))


@query(f"WITH {_RUNS} SELECT validation_id, src_table_name FROM runs WHERE contains(lower(validation_id), 't3') OR contains(lower(src_table_name), 't3') OR contains(lower(tgt_table_name), 't3') ORDER BY validation_ts DESC, validation_id LIMIT 25 OFFSET 50")
def history_search_page(spark, sf_dir):
    return history.search(runs(spark, sf_dir), " T3 ", 2, 25).select("validation_id", "src_table_name")


@query(f"WITH {_RUNS} SELECT validation_id, validation_ts FROM runs ORDER BY validation_ts DESC, validation_id LIMIT 500")
def history_latest(spark, sf_dir):
    return history.latest(runs(spark, sf_dir)).select("validation_id", "validation_ts")


@query(f"""WITH {_RUNS}, n AS (SELECT validation_id, validation_ts + INTERVAL 1 DAY AS validation_ts, 'PASS' AS row_count, CASE WHEN validation_id LIKE '%7' THEN 'late' END AS run_by FROM runs WHERE validation_id LIKE '%3' OR validation_id LIKE '%7')
SELECT runs.validation_id, coalesce(n.validation_ts, runs.validation_ts) AS validation_ts, coalesce(n.row_count, runs.row_count) AS row_count, coalesce(n.run_by, runs.run_by) AS run_by FROM runs LEFT JOIN n USING (validation_id)""")
def result_upsert(spark, sf_dir):
    stored = runs(spark, sf_dir).select("validation_id", "validation_ts", "row_count", "run_by")
    new = stored.where("validation_id LIKE '%3' OR validation_id LIKE '%7'").selectExpr("validation_id", "validation_ts + INTERVAL 1 DAY AS validation_ts", "'PASS' AS row_count", "CASE WHEN validation_id LIKE '%7' THEN 'late' END AS run_by")
    return history.upsert(stored, new)


@query("""WITH s AS (SELECT 'j' || o_orderkey AS validation_id, 'RUNNING' AS state, o_orderstatus AS overall_status, o_orderdate AS started_ts FROM orders WHERE o_orderkey % 3 <> 0),
n AS (SELECT 'j' || o_orderkey AS validation_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'SUCCEEDED' END AS state, NULL AS overall_status, CASE WHEN o_orderkey % 8 = 0 THEN o_orderdate + INTERVAL 1 HOUR END AS started_ts FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(n.validation_id, s.validation_id) AS validation_id, CASE WHEN n.validation_id IS NOT NULL THEN n.state ELSE s.state END AS state, coalesce(n.overall_status, s.overall_status) AS overall_status, coalesce(n.started_ts, s.started_ts) AS started_ts FROM s FULL JOIN n ON s.validation_id = n.validation_id""")
def job_state_upsert(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    stored = df.where("o_orderkey % 3 <> 0").selectExpr("concat('j', o_orderkey) AS validation_id", "'RUNNING' AS state", "o_orderstatus AS overall_status", "o_orderdate AS started_ts")
    new = df.where("o_orderkey % 2 = 0").selectExpr("concat('j', o_orderkey) AS validation_id", "CASE WHEN o_orderkey % 4 <> 0 THEN 'SUCCEEDED' END AS state", "CAST(NULL AS STRING) AS overall_status", "CASE WHEN o_orderkey % 8 = 0 THEN o_orderdate + INTERVAL 1 HOUR END AS started_ts")
    return history.job_upsert(stored, new)


# A query for each event: its text grows out of the event's type and user.
_LOG_PARTS = [
    ("error", "SELECT SAFE_DIVIDE(a, b) FROM t{u} WHERE x IN (SELECT y FROM u{e})"),
    ("click", "WITH w AS (SELECT a, count(*) AS n FROM t{u} GROUP BY a HAVING count(*) > {e}) SELECT DISTINCT * FROM w LEFT JOIN v ON w.a = v.a ORDER BY n LIMIT 5"),
    ("view", "SELECT CAST(a AS INT64), 'UNNEST(x)' FROM t{u} -- QUALIFY {e}"),
    ("signup", "SELECT * FROM t{u} WHERE EXISTS (SELECT 1 FROM s WHERE s.k = {e}) QUALIFY row_number() OVER (PARTITION BY a ORDER BY b) = 1"),
    ("purchase", "SELECT IFF(a > {e}, 1, 0), JSON_EXTRACT(p, '$.k') FROM t{u} JOIN x ON 1=1 LEFT JOIN y ON 1=1 INNER JOIN z ON 1=1 CROSS JOIN q UNION ALL SELECT 1, 2"),
]


def _log_case(spark_sql: bool) -> str:
    quote, text_type = ("\\'", "STRING") if spark_sql else ("''", "VARCHAR")
    cases = []
    for kind, text in _LOG_PARTS:
        text = text.replace("'", quote)
        for mark, name in (("{u}", "user_id"), ("{e}", "event_id")):
            text = text.replace(mark, f"' || CAST({name} AS {text_type}) || '")
        cases.append(f"WHEN '{kind}' THEN '{text}'")
    return "CASE event_type " + " ".join(cases) + " END"


_LOG = f"logged AS (SELECT event_id, user_id, CASE user_id % 3 WHEN 0 THEN 'bigquery' WHEN 1 THEN 'snowflake' ELSE 'trino' END AS source_engine, {_log_case(False)} AS sql FROM events)"


def query_log(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "CASE user_id % 3 WHEN 0 THEN 'bigquery' WHEN 1 THEN 'snowflake' ELSE 'trino' END AS source_engine", f"{_log_case(True)} AS sql")


def _score_sql() -> str:
    points = " + ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {w} ELSE 0 END" for _, p, w in sql_text.STRUCTURE)
    joins, nested = r"len(regexp_extract_all(text, '\bJOIN\b'))", r"len(regexp_extract_all(text, '\(\s*SELECT\b'))"
    chain = r"CASE WHEN regexp_matches(text, '\bWITH\b') THEN len(regexp_extract_all(text, '\bAS\s*\(\s*SELECT\b')) ELSE 0 END"
    return f"least(100, {points} + {joins} * 3 + {nested} * 5 + {chain} * 4)"


_SCORED = rf"""{_LOG}, texts AS (SELECT *, upper(trim(regexp_replace(sql, '\s+', ' ', 'g'))) AS text FROM logged),
scored AS (SELECT *, {_score_sql()} AS complexity_score FROM texts)"""
_LEVEL = "CASE WHEN complexity_score >= 55 THEN 'COMPLEX' WHEN complexity_score >= 25 THEN 'MEDIUM' ELSE 'SIMPLE' END"


@query(f"WITH {_SCORED} SELECT event_id, CAST(complexity_score AS INTEGER) AS complexity_score, {_LEVEL} AS complexity_level FROM scored")
def sql_complexity(spark, sf_dir):
    return sql_text.complexity(query_log(spark, sf_dir)).select("event_id", "complexity_score", "complexity_level")


# A statement for each document, by its number: together they hold every construct, and some in quotes or comments alone.
_LINT_PARTS = [
    "SELECT SAFE_DIVIDE(a, {d}), SAFE_CAST(b AS INT64) FROM UNNEST(x) -- QUALIFY IFF(1)",
    "SELECT a FROM t WHERE x IN UNNEST(y) QUALIFY row_number() OVER (ORDER BY {d}) = 1",
    "SELECT GENERATE_ARRAY(1, {d}), GENERATE_ARRAY(a, b), COUNTIF(c > 1), 'SAFE_CAST(x)'",
    "SELECT FORMAT_DATE('%Y', d), FORMAT_DATE('%m', s), TIMESTAMP_ADD(t, INTERVAL {d} DAY)",
    'SELECT IFF(a > {d}, 1, 0), "UNNEST(x) -- ", f.value FROM t, LATERAL FLATTEN(input => t.a) f',
    "SELECT STRING_AGG(a, ','), ARRAY_LENGTH(b), SAFE_MULTIPLY(a, {d}), SAFE_ADD(a, b) # TO_HEX(a)",
    "SELECT SAFE_SUBTRACT(a, {d}), SAFE_NEGATE(a), FARM_FINGERPRINT(b), GENERATE_TIMESTAMP_ARRAY(a, b, c)",
    "SELECT DATE_TRUNC(d, MONTH), JSON_EXTRACT(j, '$.a'), JSON_EXTRACT_SCALAR(j, '$.b'), JSON_EXTRACT_ARRAY(j) FROM t{d}",
    "SELECT TO_HEX(a), FROM_HEX(b), TO_BASE64(c), FROM_BASE64(d), NET.HOST(e), `DECLARE {d}`",
    "DECLARE x DEFAULT {d}; SELECT a[OFFSET(0)], a[SAFE_OFFSET(1)], a[ORDINAL(2)], CAST(b AS BOOL)",
    "{% call set_sql_header(config) %} SELECT o.get(f, 0), {d}",
    "SELECT a FROM t WHERE a > {d} LATERAL VIEW explode(b) c",
    "SELECT a IN LATERAL VIEW explode(b), {d} /* FROM UNNEST(x) */",
    "SELECT try_divide(a, {d}), count_if(b), 'it''s SAFE_CAST(', \"a # b\" FROM t LATERAL VIEW explode(c) e WHERE a > 1",
]


def _lint_case(spark_sql: bool) -> str:
    quoted = (lambda t: t.replace("'", "\\'")) if spark_sql else (lambda t: t.replace("'", "''"))
    kind = "STRING" if spark_sql else "VARCHAR"
    return f"CASE doc_id % {len(_LINT_PARTS)} " + " ".join(f"WHEN {i} THEN replace('{quoted(t)}', '{{d}}', CAST(doc_id AS {kind}))" for i, t in enumerate(_LINT_PARTS)) + " END"


# What each construct looks like in upper-cased text without literals, comments and white space, said apart from the operator's patterns.
_TRACES = [
    ("SAFE_DIVIDE", "SAFE_DIVIDE("), ("SAFE_CAST", "SAFE_CAST("), ("UNNEST", "UNNEST("), ("QUALIFY", "QUALIFY"), ("GENERATE_ARRAY", "GENERATE_ARRAY("), ("COUNTIF", "COUNTIF("), ("FORMAT_DATE", "FORMAT_DATE("), ("TIMESTAMP_DIFF", "TIMESTAMP_ADD("), ("IFF", "IFF("), ("FLATTEN", "LATERALFLATTEN("), ("STRING_AGG", "STRING_AGG("),
    ("INT64", "INT64"), ("IN_UNNEST", "INUNNEST("), ("IN_LATERAL_VIEW", "INLATERALVIEW"), ("WHERE_LATERAL_VIEW", "WHERE%LATERALVIEW"), ("ARRAY_LENGTH", "ARRAY_LENGTH("), ("SAFE_MULTIPLY", "SAFE_MULTIPLY("), ("SAFE_ADD", "SAFE_ADD("), ("SAFE_SUBTRACT", "SAFE_SUBTRACT("), ("SAFE_NEGATE", "SAFE_NEGATE("),
    ("FARM_FINGERPRINT", "FARM_FINGERPRINT("), ("GENERATE_TIMESTAMP_ARRAY", "GENERATE_TIMESTAMP_ARRAY("), ("DATE_TRUNC", ",MONTH)"), ("JSON_EXTRACT", "JSON_EXTRACT("), ("JSON_EXTRACT_SCALAR", "JSON_EXTRACT_SCALAR("), ("JSON_EXTRACT_ARRAY", "JSON_EXTRACT_ARRAY("), ("TO_HEX", "TO_HEX("), ("FROM_HEX", "FROM_HEX("),
    ("TO_BASE64", "TO_BASE64("), ("FROM_BASE64", "FROM_BASE64("), ("NET", "NET.HOST("), ("DECLARE", "DECLARE"), ("SET_SQL_HEADER", "SET_SQL_HEADER("), ("GET_FIELD", "O.GET("), ("OFFSET", "[OFFSET("), ("SAFE_OFFSET", "[SAFE_OFFSET("), ("ORDINAL", "[ORDINAL("), ("BOOL", "ASBOOL)"),
]
_FOUND = ", ".join(f"CASE WHEN text LIKE '%{trace.replace('_', '!_')}%' ESCAPE '!' THEN '{name}' END" for name, trace in _TRACES)


@query(rf"""WITH logged AS (SELECT doc_id, {_lint_case(False)} AS sql FROM documents),
bare AS (SELECT doc_id, upper(regexp_replace(regexp_replace(sql, '''[^'']*''|"[^"]*"|`[^`]*`|--[^\n]*|#[^\n]*|/\*.*?\*/', '', 'g'), '\s+', '', 'g')) AS text FROM logged),
found AS (SELECT doc_id, [x FOR x IN [{_FOUND}] IF x IS NOT NULL] AS residual FROM bare)
SELECT doc_id, array_to_string(residual, ',') AS residual, len(residual) = 0 AS is_clean FROM found""")
def sql_lint_report(spark, sf_dir):
    log = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_lint_case(True)} AS sql")
    return sql_text.remains(log).select("doc_id", F.array_join("residual", ",").alias("residual"), "is_clean")


@query(f"""WITH k AS (SELECT doc_id, doc_id % {len(_LINT_PARTS)} AS kind FROM documents)
SELECT doc_id, kind IN (10, 13) AS is_valid, CASE WHEN kind = 10 THEN 'TEMPLATE' END AS reviewed, CASE WHEN kind NOT IN (10, 13) THEN 'RESIDUAL_SYNTAX' END AS error_type,
  CAST([4, 3, 2, 2, 2, 4, 4, 4, 5, 5, 2, 1, 1, 0][kind + 1] AS INTEGER) AS suggestions FROM k""")
def sql_lint_kinds(spark, sf_dir):
    """Whether statements are valid, what people have to look at, and how many suggestions there are."""
    log = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_lint_case(True)} AS sql")
    return sql_text.lint(log).select("doc_id", "is_valid", "reviewed", "error_type", F.size("suggestions").alias("suggestions"))


@query(f"""WITH {_SCORED} SELECT source_engine, count(*) AS total_queries_processed, count(*) FILTER (event_id % 10 <> 0) AS successful_migrations, count(*) FILTER (event_id % 4 = 0) AS validated_queries,
  count(*) FILTER ({_LEVEL} = 'SIMPLE') AS simple_queries, count(*) FILTER ({_LEVEL} = 'MEDIUM') AS medium_queries, count(*) FILTER ({_LEVEL} = 'COMPLEX') AS complex_queries, round(avg(complexity_score), 4) AS average_score FROM scored GROUP BY 1""")
def query_stats(spark, sf_dir):
    scored = sql_text.complexity(query_log(spark, sf_dir)).withColumns({"migrated": F.col("event_id") % 10 != 0, "validated": F.col("event_id") % 4 == 0})
    return history.query_counts(scored)


@query("""WITH l AS (SELECT event_id, CAST(floor(value * 10) AS INTEGER) AS s, CAST(user_id % 50 * 3 AS INTEGER) AS t FROM events)
SELECT event_id, CASE WHEN s > 0 AND t > 0 THEN CASE WHEN t < s THEN 'faster' WHEN t > s THEN 'slower' ELSE 'same' END END AS verdict FROM l""")
def latency_compare(spark, sf_dir):
    df = table(spark, sf_dir, "events").selectExpr("event_id", "CAST(floor(value * 10) AS INT) AS source_latency_ms", "CAST(user_id % 50 * 3 AS INT) AS target_latency_ms")
    return df.select("event_id", history.latency_verdict().alias("verdict"))


@query("SELECT event_type, count(*) AS entries, sum(user_id) AS accesses, round(avg(user_id), 4) AS average_accesses FROM events GROUP BY 1")
def cache_stats(spark, sf_dir):
    return history.cache_stats(table(spark, sf_dir, "events"), "event_type", "user_id")
