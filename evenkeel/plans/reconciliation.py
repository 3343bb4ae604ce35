"""Queries of the reconciliation operators, over pairs derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.canonical import encode, hash_value, plain_scalar, row_hash, signature
from evenkeel.operators import compare, reconcile
from evenkeel.plans.forms import hash_sql, int_sql, number_sql, text_sql, time_sql
from evenkeel.plans.registry import query, table
from evenkeel.streaming import increments

# ---- pairs: lineitem against itself with rows dropped, changed and repeated; orders the same way


def lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    source = table(spark, sf_dir, "lineitem")
    changed = F.when(F.col("l_orderkey") % 101 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    target = source.where("l_orderkey % 97 <> 0").withColumn("l_quantity", changed)
    return source, target.unionByName(source.where("l_orderkey % 103 = 0"))


def orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    source = table(spark, sf_dir, "orders")
    target = source.where("o_orderkey % 100 <> 0").withColumns({"o_totalprice": F.when(F.col("o_orderkey") % 101 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")), "o_orderpriority": F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority"))})
    return source, target


_LINES = """s AS (SELECT * FROM lineitem),
t AS (SELECT * REPLACE (CASE WHEN l_orderkey % 101 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity) FROM lineitem WHERE l_orderkey % 97 <> 0
  UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 103 = 0)"""
_ORDERS = """s AS (SELECT * FROM orders),
t AS (SELECT * REPLACE (CASE WHEN o_orderkey % 101 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS o_orderpriority) FROM orders WHERE o_orderkey % 100 <> 0)"""


LINE_SQL = {c: number_sql(c) for c in ("l_discount", "l_extendedprice", "l_quantity", "l_tax")} | {c: int_sql(c) for c in ("l_linenumber", "l_orderkey", "l_partkey", "l_suppkey")} | {c: text_sql(c) for c in ("l_linestatus", "l_returnflag")} | {"l_shipdate": time_sql("l_shipdate")}
ORDER_SQL = {"o_custkey": int_sql("o_custkey"), "o_orderdate": time_sql("o_orderdate"), "o_orderkey": int_sql("o_orderkey"), "o_orderpriority": text_sql("o_orderpriority"), "o_orderstatus": text_sql("o_orderstatus"), "o_totalprice": number_sql("o_totalprice")}


_SIDES = f"""WITH {_LINES},
both_sides AS (SELECT {hash_sql(LINE_SQL)} AS row_hash, 1 AS s, 0 AS t FROM s UNION ALL SELECT {hash_sql(LINE_SQL)}, 0, 1 FROM t),
c AS (SELECT row_hash, sum(s) AS n_s, sum(t) AS n_t FROM both_sides GROUP BY row_hash)"""

# ---- scans and schemas


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def scan_filter(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice > 100000").select("o_orderkey", "o_totalprice")


@query("SELECT count(*) AS row_count FROM lineitem")
def row_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("row_count"))


_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


@query("WITH filled AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS filled, count(DISTINCT {c}) AS distinct_values FROM lineitem" for c in _COLUMNS) + """)
SELECT ordinal_position, column_name, CASE data_type WHEN 'BIGINT' THEN 'INT' WHEN 'INTEGER' THEN 'INT' WHEN 'VARCHAR' THEN 'STRING' ELSE data_type END AS canonical_type, filled, distinct_values
FROM information_schema.columns JOIN filled USING (column_name) WHERE table_name = 'lineitem'""")
def schema_scan(spark, sf_dir):
    """The columns of a table, and what the table holds in each."""
    df = table(spark, sf_dir, "lineitem")
    return compare.schema_rows(df).select("ordinal_position", "column_name", "canonical_type").join(compare.filled(df), "column_name")


@query("""WITH kinds AS (SELECT table_name, column_name, CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'NUMERIC' ELSE data_type END AS family FROM information_schema.columns),
s AS (SELECT column_name, family FROM kinds WHERE table_name = 'customer'),
t AS (SELECT 'c_' || substr(column_name, 3) AS column_name, family FROM kinds WHERE table_name = 'supplier'),
f AS (SELECT 'c_custkey' AS column_name, count(c_custkey) AS filled FROM customer UNION ALL SELECT 'c_name', count(c_name) FROM customer UNION ALL SELECT 'c_nationkey', count(c_nationkey) FROM customer
  UNION ALL SELECT 'c_mktsegment', count(c_mktsegment) FROM customer UNION ALL SELECT 'c_acctbal', count(c_acctbal) FROM customer)
SELECT s.column_name AS column_name_src, t.column_name AS column_name_tgt, CASE WHEN s.family = t.family THEN 'MATCH' ELSE 'NOT MATCH' END AS status, f.filled AS source_filled
FROM s FULL JOIN t USING (column_name) LEFT JOIN f ON f.column_name = s.column_name""")
def schema_compare(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    renamed = supplier.toDF(*("c_" + c[2:] for c in supplier.columns))
    customer = table(spark, sf_dir, "customer")
    filled = compare.filled(customer).select(F.col("column_name").alias("column_name_src"), F.col("filled").alias("source_filled"))
    return compare.schemas(customer, renamed).select("column_name_src", "column_name_tgt", "status").join(filled, "column_name_src", "left")


@query("SELECT c_acctbal, c_name, c_nationkey FROM customer")
def common_columns(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    renamed = supplier.toDF(*("C_" + c[2:].upper() for c in supplier.columns))
    return compare.aligned(table(spark, sf_dir, "customer"), renamed)[0]


# ---- counts and statistics


@query(f"""WITH {_ORDERS}, c AS (SELECT (SELECT count(*) FROM s) AS source_count, (SELECT count(*) FROM t) AS target_count)
SELECT *, source_count - target_count AS difference, CASE WHEN least(source_count, target_count) >= 0.95 * greatest(source_count, target_count) THEN 'PASS' ELSE 'FAIL' END AS status FROM c""")
def row_count_compare(spark, sf_dir):
    return compare.row_counts(*orders(spark, sf_dir), threshold=0.95)


@query(f"""WITH {_ORDERS}, c AS (SELECT (SELECT count(*) FROM s WHERE o_totalprice > 250000) AS source_count, (SELECT count(*) FROM t WHERE o_totalprice > 250000 AND o_orderstatus <> 'P') AS target_count)
SELECT *, source_count - target_count AS difference, CASE WHEN source_count = target_count THEN 'PASS' ELSE 'FAIL' END AS status FROM c""")
def where_per_side(spark, sf_dir):
    source, target = orders(spark, sf_dir)
    pair = reconcile.TablePair(source, target, source_where="o_totalprice > 250000", target_where="o_totalprice > 250000 AND o_orderstatus <> 'P'")
    return compare.row_counts(*pair.sides())


_STATS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS null_count, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 4) AS avg FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))


@query(_STATS)
def numeric_stats(spark, sf_dir):
    return compare.numeric_stats(table(spark, sf_dir, "lineitem")).withColumn("avg", F.round("avg", 4))


_ORDER_NUMBERS = ("o_custkey", "o_orderkey", "o_totalprice")


@query(f"WITH {_ORDERS}, r AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", " + ", ".join(f"(SELECT round(CAST({f}({c}) AS DOUBLE), 4) FROM {x}) AS {n}_{f}" for x, n in (("s", "source"), ("t", "target")) for f in ("min", "max", "avg")) for c in _ORDER_NUMBERS) + """)
SELECT *, CASE WHEN source_min = target_min AND source_max = target_max AND (source_avg = target_avg OR least(source_avg, target_avg) >= 0.99 * greatest(source_avg, target_avg)) THEN 'PASS'
  WHEN (source_min = target_min OR least(source_min, target_min) >= 0.99 * greatest(source_min, target_min)) AND (source_max = target_max OR least(source_max, target_max) >= 0.99 * greatest(source_max, target_max)) AND least(source_avg, target_avg) >= 0.99 * greatest(source_avg, target_avg) THEN 'PASS' ELSE 'FAIL' END AS status FROM r""")
def numeric_stats_compare(spark, sf_dir):
    return compare.numeric_stats_compare(*orders(spark, sf_dir), threshold=0.99).drop("source_null_count", "target_null_count")


@query(f"""WITH {_ORDERS} SELECT 'o_orderpriority' AS "column", (SELECT count(*) FROM s WHERE o_orderpriority IS NULL) AS source_null_count, (SELECT count(*) FROM t WHERE o_orderpriority IS NULL) AS target_null_count""")
def null_counts(spark, sf_dir):
    return compare.null_counts(*orders(spark, sf_dir))


# ---- rows


@query("SELECT " + ", ".join(f"{ORDER_SQL[c]} AS col_{i + 1}" for i, c in enumerate(sorted(ORDER_SQL))) + " FROM orders")
def row_values(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(*(encode(c, kinds[c]).alias(f"col_{i + 1}") for i, c in enumerate(sorted(kinds))))


@query("SELECT o_orderkey, " + " || '|' || ".join(ORDER_SQL[c] for c in sorted(ORDER_SQL)) + " AS signature FROM orders")
def row_signature(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.select("o_orderkey", signature(df).alias("signature"))


@query("SELECT " + " || '|' || ".join(ORDER_SQL[c] for c in sorted(ORDER_SQL)) + " AS signature FROM orders ORDER BY signature LIMIT 50")
def signature_sample(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.select(signature(df).alias("signature")).orderBy("signature").limit(compare.SAMPLE_ROWS)


@query(f"WITH {_LINES} SELECT {hash_sql(LINE_SQL)} AS row_hash, count(*) AS n FROM t GROUP BY 1")
def hash_counts(spark, sf_dir):
    return compare.hash_counts(lines(spark, sf_dir)[1])


_ROW_HASHES = """sum(n_s) AS source_hash_count, sum(n_t) AS target_hash_count, sum(least(n_s, n_t)) AS matched_hash_count,
  sum(greatest(n_s - n_t, 0)) AS source_not_in_target_count, sum(greatest(n_t - n_s, 0)) AS target_not_in_source_count"""


@query(f"{_SIDES} SELECT {_ROW_HASHES}, CASE WHEN count(*) FILTER (n_s <> n_t) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c")
def row_hash_compare(spark, sf_dir):
    return compare.row_hashes(*lines(spark, sf_dir)).drop("similarity")


@query(f"{_SIDES} SELECT round(sum(least(n_s, n_t)) / sum(greatest(n_s, n_t)), 6) AS similarity, CASE WHEN sum(least(n_s, n_t)) / sum(greatest(n_s, n_t)) >= 0.95 THEN 'PASS' ELSE 'FAIL' END AS status FROM c")
def row_hash_similarity(spark, sf_dir):
    return compare.row_hashes(*lines(spark, sf_dir), threshold=0.95).select(F.round("similarity", 6).alias("similarity"), "status")


@query(f"{_SIDES} SELECT row_hash, n_s - n_t AS surplus FROM c WHERE n_s > n_t")
def rows_source_only(spark, sf_dir):
    return compare.rows_only(*lines(spark, sf_dir), "source")


@query(f"{_SIDES} SELECT row_hash, n_t - n_s AS surplus FROM c WHERE n_t > n_s")
def rows_target_only(spark, sf_dir):
    return compare.rows_only(*lines(spark, sf_dir), "target")


@query(f"{_SIDES}, h AS (SELECT *, {hash_sql(LINE_SQL)} AS row_hash FROM s) SELECT row_hash, l_orderkey, l_linenumber, l_quantity FROM h WHERE row_hash IN (SELECT row_hash FROM c WHERE n_s > n_t)")
def hash_lookup(spark, sf_dir):
    source, target = lines(spark, sf_dir)
    return compare.rows_with_hashes(source, compare.rows_only(source, target, "source")).select("row_hash", "l_orderkey", "l_linenumber", "l_quantity")


@query(f"WITH {_ORDERS} SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.o_orderkey = s.o_orderkey)")
def left_anti_keys(spark, sf_dir):
    return compare.keys_missing(*orders(spark, sf_dir), ["o_orderkey"])


_DIFFERENCES = f"WITH {_ORDERS}, a AS (SELECT s.o_orderkey AS k, " + ", ".join(f"{ORDER_SQL[c].replace(c, 's.' + c)} AS s_{c}, {ORDER_SQL[c].replace(c, 't.' + c)} AS t_{c}" for c in ("o_orderpriority", "o_totalprice")) + " FROM s JOIN t ON s.o_orderkey = t.o_orderkey), d AS (" + " UNION ALL ".join(f"SELECT k AS o_orderkey, '{c}' AS \"column\", s_{c} AS source_value, t_{c} AS target_value FROM a WHERE s_{c} <> t_{c}" for c in ("o_orderpriority", "o_totalprice")) + ")"


@query(_DIFFERENCES + " SELECT * FROM d")
def column_diff(spark, sf_dir):
    return compare.column_differences(*orders(spark, sf_dir), ["o_orderkey"])


@query(_DIFFERENCES + ' SELECT "column", count(*) AS rows FROM d GROUP BY 1')
def mismatched_columns(spark, sf_dir):
    return compare.mismatched_columns(*orders(spark, sf_dir), ["o_orderkey"])


# ---- groups

_GROUPS = ("l_returnflag", "l_linestatus")
_OWN = {c: f for c, f in LINE_SQL.items() if c not in _GROUPS}
_LANES = " || ':' || ".join(f"CAST(sum(CAST('0x' || substr(h, {15 * i + 1}, 15) AS BIGINT)) AS VARCHAR)" for i in range(2))


def _group_sql(name: str) -> str:
    return f"SELECT {text_sql('l_returnflag')} AS l_returnflag, {text_sql('l_linestatus')} AS l_linestatus, count(*) AS row_count, upper(md5({_LANES})) AS group_hash FROM (SELECT *, {hash_sql(_OWN)} AS h FROM {name}) GROUP BY 1, 2"


@query(f"WITH {_LINES} {_group_sql('s')}")
def group_hash(spark, sf_dir):
    return compare.group_hashes(lines(spark, sf_dir)[0], _GROUPS)


_FLAGGED = f"""WITH s AS (SELECT * FROM lineitem), t AS (SELECT * REPLACE (CASE WHEN l_returnflag = 'A' AND l_orderkey % 101 = 0 THEN l_tax + 0.01 ELSE l_tax END AS l_tax) FROM lineitem WHERE NOT (l_returnflag = 'N' AND l_linestatus = 'O')),
a AS ({_group_sql('s')}), b AS ({_group_sql('t')}),
g AS (SELECT l_returnflag, l_linestatus, a.row_count AS source_row_count, a.group_hash AS source_hash, b.row_count AS target_row_count, b.group_hash AS target_hash, CASE WHEN a.group_hash = b.group_hash THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM a FULL JOIN b USING (l_returnflag, l_linestatus))"""


def _flagged(spark, sf_dir):
    source = table(spark, sf_dir, "lineitem")
    target = source.where("NOT (l_returnflag = 'N' AND l_linestatus = 'O')").withColumn("l_tax", F.expr("CASE WHEN l_returnflag = 'A' AND l_orderkey % 101 = 0 THEN l_tax + 0.01D ELSE l_tax END"))
    return source, target


@query(f"{_FLAGGED} SELECT * FROM g")
def group_hash_compare(spark, sf_dir):
    return compare.group_compare(*_flagged(spark, sf_dir), _GROUPS)


@query(f"""{_FLAGGED} SELECT coalesce(sum(source_row_count) FILTER (status = 'MATCH'), 0) AS matched_rows, coalesce(sum(source_row_count) FILTER (status <> 'MATCH'), 0) AS source_mismatched_rows,
  coalesce(sum(target_row_count) FILTER (status <> 'MATCH'), 0) AS target_mismatched_rows FROM g""")
def group_totals(spark, sf_dir):
    return compare.group_totals(compare.group_compare(*_flagged(spark, sf_dir), _GROUPS))


@query(f"SELECT l_orderkey, l_linenumber, {hash_sql(LINE_SQL)} AS row_hash FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' ORDER BY row_hash LIMIT 5")
def group_samples(spark, sf_dir):
    return compare.group_sample(table(spark, sf_dir, "lineitem"), {"l_returnflag": "R", "l_linestatus": "F"}).select("l_orderkey", "l_linenumber", "row_hash")


# ---- whole validations and values


_NUMERIC = ("l_discount", "l_extendedprice", "l_linenumber", "l_orderkey", "l_partkey", "l_quantity", "l_suppkey", "l_tax")
_SAME_STATS = " AND ".join(f"(SELECT (min({c}), max({c}), round(avg({c}), 4)) FROM s) = (SELECT (min({c}), max({c}), round(avg({c}), 4)) FROM t)" for c in _NUMERIC)


@query(f"""{_SIDES} SELECT CASE WHEN (SELECT count(*) FROM s) = (SELECT count(*) FROM t) THEN 'PASS' ELSE 'FAIL' END AS row_count,
CASE WHEN (SELECT list((column_name, column_type)) FROM (DESCRIBE SELECT * FROM s)) = (SELECT list((column_name, column_type)) FROM (DESCRIBE SELECT * FROM t)) THEN 'PASS' ELSE 'FAIL' END AS schema_check,
CASE WHEN {_SAME_STATS} THEN 'PASS' ELSE 'FAIL' END AS numeric_check, CASE WHEN (SELECT count(*) FROM c WHERE n_s <> n_t) = 0 THEN 'PASS' ELSE 'FAIL' END AS hash_validation""")
def query_pair_validate(spark, sf_dir):
    source, target = lines(spark, sf_dir)
    options = reconcile.Options(include_timestamp=True).with_metrics("all")
    record, _ = reconcile.validate_queries(spark, "SELECT * FROM {source}", "SELECT * FROM {target}", options, source=source, target=target)
    return record.select("row_count", "schema_check", "numeric_check", "hash_validation")


@query("""SELECT event_id, upper(md5('{"a":{"y":' || rtrim(rtrim(CAST(value AS VARCHAR), '0'), '.') || ',"z":' || user_id || '},"b":["' || least(event_type, 'm' || user_id) || '","' || greatest(event_type, 'm' || user_id) || '"]}')) AS row_hash FROM events WHERE value IS NOT NULL""")
def nested_json_hash(spark, sf_dir):
    """JSON whose keys and list members stand in no order, hashed by its ordered form."""
    texts = table(spark, sf_dir, "events").where("value IS NOT NULL").selectExpr("event_id", """concat(' {"b": ["', event_type, '", "m', user_id, '"],"a": {"z":', user_id, '.0, "y":', value, '}}') AS doc""")
    return texts.select("event_id", row_hash(texts, ["doc"], sort_json=True, escape=False).alias("row_hash"))


@query("SELECT o_orderkey, upper(md5(lower(trim(o_orderpriority)))) AS row_hash, o_orderkey % 3 <> 0 AS same FROM orders")
def folded_hash(spark, sf_dir):
    """Values and hashes that differ in case and padding alone are equal."""
    df = table(spark, sf_dir, "orders").withColumn("padded", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("  "), F.upper("o_orderpriority"))).otherwise(F.lower("o_orderpriority")))
    hashed = df.select("o_orderkey", row_hash(df, ["padded"], fold=True).alias("row_hash"))
    stored = F.concat(F.lit(" "), F.lower(F.when(F.col("o_orderkey") % 3 == 0, F.lit("none")).otherwise(F.col("row_hash"))), F.lit(" "))
    return hashed.select("o_orderkey", "row_hash", (hash_value(stored) == hash_value(F.col("row_hash"))).alias("same"))


@query("SELECT o_orderkey, upper(md5(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%g') || '|' || regexp_replace(regexp_replace(CAST(CAST(o_totalprice / 7 AS DECIMAL(38,8)) AS VARCHAR), '0+$', ''), '[.]$', ''))) AS row_hash FROM orders")
def coarse_hash(spark, sf_dir):
    """The forms for systems that keep milliseconds and eight decimals."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", (F.col("o_totalprice") / 7).alias("part"))
    return df.select("o_orderkey", row_hash(df, ["o_orderdate", "part"], coarse=True).alias("row_hash"))


@query("""SELECT event_id, CASE WHEN user_id % 2 = 0 THEN least(event_type, 'x' || user_id) || ',' || greatest(event_type, 'x' || user_id) ELSE strftime(ts, '%Y-%m-%d') END AS plain FROM events""")
def scalar_normalise(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    listed = F.concat(F.lit(" "), "event_type", F.lit(" , x"), F.col("user_id").cast("string"), F.lit(" "))
    return df.select("event_id", plain_scalar(F.when(F.col("user_id") % 2 == 0, listed).otherwise(F.date_format("ts", "dd-MM-yyyy"))).alias("plain"))


@query(f"SELECT user_id, upper(md5(CAST(event_id AS VARCHAR) || '|' || {text_sql('props')} || '|' || strftime(ts, '%Y-%m-%d'))) AS row_hash FROM events")
def dates_only_hash(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "props", "ts", "user_id")
    return df.select("user_id", row_hash(df, ["event_id", "props", "ts"], dates_only=True).alias("row_hash"))


@query("SELECT date_trunc('day', ts) AS window_start, count(*) AS rows, count(*) FILTER (value IS NULL) AS nulls, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream_window_counts(spark, sf_dir):
    """An extension: the events table as a stream, counted by day of event time."""
    counts = increments.windowed_counts(increments.stream(spark, f"{sf_dir}/events.parquet"))
    return increments.run(counts, increments.checkpoint_folder(spark, "evenkeel-stream"))
