"""Queries of the aggregates, windows, set operations, unnesting and functions that migrated SQL relies on."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenkeel.functions import warehouse as f
from evenkeel.operators.recursion import recursive
from evenkeel.plans.registry import query, table
from evenkeel.sources.files import working_folder

# ---- aggregates


@query("SELECT event_type, count(*) FILTER (value > 10) AS high, coalesce(bool_and(value > 0), false) AS all_positive, bool_or(value > 50) AS any_big, bit_and(user_id) AS band, bit_or(user_id) AS bor, bit_xor(user_id) AS bxor FROM events GROUP BY 1")
def agg_logic(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 10).alias("high"), F.bool_and(F.col("value") > 0).alias("all_positive"), F.bool_or(F.col("value") > 50).alias("any_big"), F.bit_and("user_id").alias("band"), F.bit_or("user_id").alias("bor"), F.bit_xor("user_id").alias("bxor"))


@query("SELECT o_custkey, string_agg(o_orderpriority, ', ' ORDER BY o_orderpriority) AS names, len(list(DISTINCT substr(o_orderpriority, 1, 1))) AS initials FROM orders GROUP BY 1")
def agg_listagg(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.expr("listagg(o_orderpriority, ', ') WITHIN GROUP (ORDER BY o_orderpriority)").alias("names"), F.size(F.collect_set(F.substring("o_orderpriority", 1, 1))).cast("long").alias("initials"))


@query("SELECT p_brand, median(p_size) AS middle, round(quantile_cont(p_retailprice, 0.9), 4) AS p90, mode_size FROM part JOIN (SELECT p_brand, p_size AS mode_size FROM part GROUP BY p_brand, p_size QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size) = 1) USING (p_brand) GROUP BY p_brand, mode_size")
def agg_median(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.median("p_size").alias("middle"), F.round(F.expr("percentile(p_retailprice, 0.9)"), 4).alias("p90"), F.mode("p_size", True).alias("mode_size"))


@query("SELECT o_orderstatus, count(*) AS n, sum(CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END) AS big, count(DISTINCT o_custkey) FILTER (o_orderpriority = '1-URGENT') AS urgent_customers, round(sum(o_totalprice) FILTER (o_orderkey % 2 = 0), 2) AS even_total FROM orders GROUP BY 1")
def agg_filter_where(spark, sf_dir):
    return spark.sql("""SELECT o_orderstatus, count(*) AS n, count_if(o_totalprice > 250000) AS big, count(DISTINCT o_custkey) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent_customers,
      round(sum(o_totalprice) FILTER (WHERE o_orderkey % 2 = 0), 2) AS even_total FROM {orders} GROUP BY o_orderstatus""", orders=table(spark, sf_dir, "orders"))


@query("SELECT p_type, to_json(map(list(p_size ORDER BY p_size), list(n ORDER BY p_size))) AS sizes FROM (SELECT p_type, CAST(p_size AS VARCHAR) AS p_size, count(*) AS n FROM part GROUP BY ALL) GROUP BY 1")
def agg_object(spark, sf_dir):
    counted = table(spark, sf_dir, "part").groupBy("p_type", F.col("p_size").cast("string").alias("p_size")).agg(F.count("*").alias("n"))
    return counted.groupBy("p_type").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p_size", "n"))))).alias("sizes"))


@query("SELECT event_type, true AS users_near, true AS quartiles_near, true AS top_users_near, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY 1")
def agg_approximate(spark, sf_dir):
    """Sketches: their values depend on the engine, so they are held against exact figures within their error bounds.

    Exact figures come from counts by value and by user, so no task holds a type's values. Where users are many and alike no count is sure, so
    approx_top_k returns none; then none may have more rows than the bound.
    """
    events = table(spark, sf_dir, "events")
    shares = (0.25, 0.5, 0.75)
    top_rows = F.coalesce(F.get(F.expr("approx_top_k(user_id, 3, 10000)"), F.lit(0))["count"], F.lit(0))
    sketched = events.groupBy(F.col("event_type").alias("of")).agg(F.approx_count_distinct("user_id", 0.02).alias("about"), F.percentile_approx("value", list(shares), 1000).alias("quartiles"), top_rows.alias("top_rows"))
    by_user = events.groupBy("event_type", "user_id").agg(F.count("*").alias("n")).groupBy("event_type").agg(F.count("user_id").alias("users"), F.sum("n").alias("n"), F.max("n").alias("most"))
    rows = lambda found: F.sum(F.when(found, F.col("n")).otherwise(0))
    quartile = [F.col("quartiles")[i] for i in range(len(shares))]
    by_value = events.groupBy("event_type", "value").agg(F.count("*").alias("n")).join(sketched, F.col("event_type").eqNullSafe(F.col("of")))
    ranks = by_value.groupBy("of").agg(F.any_value("about").alias("about"), F.any_value("top_rows").alias("top_rows"), rows(F.col("value").isNotNull()).alias("valued"), F.array(*(rows(F.col("value") < q) for q in quartile)).alias("below"), F.array(*(rows(F.col("value") <= q) for q in quartile)).alias("up_to"))
    near = F.lit(True)
    for i, share in enumerate(shares):
        near = near & (F.col("below")[i] <= F.col("valued") * (share + 0.01)) & (F.col("up_to")[i] >= F.col("valued") * (share - 0.01))
    met = ranks.join(by_user, F.col("event_type").eqNullSafe(F.col("of")))
    top = F.abs(F.col("top_rows") - F.col("most")) <= F.col("n") * 0.01
    return met.select("event_type", (F.abs(F.col("about") - F.col("users")) <= F.col("users") * 0.1).alias("users_near"), near.alias("quartiles_near"), top.alias("top_users_near"), "users", "n")


@query("SELECT o_custkey, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey DESC)[1:3] AS dearest, sum(o_orderkey % 3)::BIGINT AS parts FROM orders GROUP BY 1")
def agg_array_ordered(spark, sf_dir):
    """ARRAY_AGG with an order and a limit; ARRAY_CONCAT_AGG."""
    thirds = F.array_repeat("o_orderkey", (F.col("o_orderkey") % 3).cast("int"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(f.array_agg_ordered("o_orderkey", "o_totalprice", 3, True).alias("dearest"), F.size(f.array_concat_agg(thirds)).cast("long").alias("parts"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) < 429496729")
def table_sample(spark, sf_dir):
    """TABLESAMPLE of a tenth, the same rows each time."""
    return table(spark, sf_dir, "orders").where(f.sampled("o_orderkey", 10)).select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, max_by(o_orderkey, (o_totalprice, o_orderkey)) AS dearest, min_by(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest FROM orders GROUP BY 1")
def top1_max_by(spark, sf_dir):
    by = F.struct("o_totalprice", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", by).alias("dearest"), F.min_by("o_orderkey", by).alias("cheapest"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_n(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


# ---- windows


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def qualify_row_number(spark, sf_dir):
    """The latest order of each customer: as an aggregation, which needs no sort of a customer's orders."""
    latest = F.max_by("o_orderkey", F.struct("o_orderdate", -F.col("o_orderkey"))).alias("o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(latest)


@query("SELECT o_custkey, o_orderkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS place FROM orders QUALIFY place <= 2")
def qualify_rank(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.dense_rank().over(w).alias("place")).where("place <= 2")


@query("SELECT event_id, last_value(CASE WHEN value > 10 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_high FROM events")
def last_value_ignore_nulls(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return table(spark, sf_dir, "events").select("event_id", F.last(F.when(F.col("value") > 10, F.col("value")), True).over(w).alias("last_high"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS recent FROM events")
def window_frame_rows(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("recent"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS n FROM events")
def window_range_interval(spark, sf_dir):
    return spark.sql("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS n FROM {events}", events=table(spark, sf_dir, "events"))


@query("SELECT o_orderkey, count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS priorities FROM orders")
def count_distinct_over(spark, sf_dir):
    return f.count_distinct_over(table(spark, sf_dir, "orders"), "o_orderpriority", ["o_custkey"], "priorities").select("o_orderkey", "priorities")


# ---- sets, subqueries, unnesting


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_minus(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.where("o_orderstatus = 'F'").select("o_custkey").subtract(df.where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT o_custkey, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1")
def union_all_cte(spark, sf_dir):
    return spark.sql("WITH a AS (SELECT o_custkey FROM {orders} WHERE o_totalprice > 400000), b AS (SELECT o_custkey FROM {orders} WHERE o_orderpriority = '1-URGENT'), both AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT o_custkey, count(*) AS n FROM both GROUP BY o_custkey", orders=table(spark, sf_dir, "orders"))


@query("WITH c AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1), n AS (SELECT c_nationkey, sum(total) AS total FROM c JOIN customer ON c_custkey = o_custkey GROUP BY 1) SELECT n_name, round(total, 2) AS total FROM n JOIN nation ON n_nationkey = c_nationkey")
def cte_chain(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    nations = orders.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.sum("total").alias("total"))
    return nations.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", F.round("total", 2).alias("total"))


@query("""WITH RECURSIVE tree(k, step) AS (SELECT c_custkey, 0 FROM customer WHERE c_custkey // 2 = c_custkey OR c_custkey // 2 NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT c.c_custkey, step + 1 FROM tree JOIN customer c ON c.c_custkey // 2 = tree.k AND c.c_custkey <> tree.k) SELECT k, step FROM tree""")
def recursive_cte(spark, sf_dir):
    """Customers as a tree in which half of a key is its parent: from every root to every leaf, a written round for each step."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.expr("c_custkey div 2").alias("parent"))
    keys = customer.select(F.col("c_custkey").alias("known"))
    loose = customer.where("c_custkey <> parent").join(keys, F.col("parent") == F.col("known"), "left_anti")
    roots = customer.where("c_custkey = parent").union(loose).select(F.col("c_custkey").alias("k"), F.lit(0).alias("step"))
    children = customer.where("c_custkey <> parent")
    return recursive(roots, lambda rows: children.join(rows, F.col("parent") == F.col("k")).select(F.col("c_custkey").alias("k"), F.col("step") + 1), working_folder(spark, "evenkeel-recursion"))


@query("SELECT c_custkey, (SELECT string_agg(o_orderstatus, '|' ORDER BY o_orderstatus) FROM orders WHERE o_custkey = c_custkey) AS states FROM customer")
def array_subquery(spark, sf_dir):
    states = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderstatus")), "|").alias("states"))
    return table(spark, sf_dir, "customer").join(states, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "states")


@query("SELECT vec_id, unnest(embedding) AS x FROM embeddings")
def unnest_explode(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.explode("embedding").alias("x"))


@query("SELECT vec_id, x FROM embeddings LEFT JOIN LATERAL (SELECT unnest(CASE WHEN label = 3 THEN NULL ELSE embedding END) AS x) u ON true")
def unnest_outer(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.explode_outer(F.when(F.col("label") != 3, F.col("embedding"))).alias("x"))


@query("SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS x FROM embeddings")
def unnest_offset(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), "x")


@query("SELECT p_partkey, p_size IN (1, 5, 9) AS picked, NOT coalesce(p_brand IN ('Brand#1', 'Brand#2'), false) AS other_brand FROM part")
def in_unnest(spark, sf_dir):
    sizes, brands = F.array(*map(F.lit, (1, 5, 9))), F.array(*map(F.lit, ("Brand#1", "Brand#2")))
    return table(spark, sf_dir, "part").select("p_partkey", f.in_array("p_size", sizes).alias("picked"), (~f.in_array("p_brand", brands)).alias("other_brand"))


@query("SELECT p_partkey, i - 1 AS index, string_split(p_name, ' ')[i] AS word FROM part, range(1, 10) r(i) WHERE i <= len(string_split(p_name, ' '))")
def lateral_flatten(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("index", "word")).select("p_partkey", F.col("index").cast("long").alias("index"), "word")


@query("SELECT d, count(event_id) AS events FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT date_trunc('day', min(ts))::TIMESTAMP AS lo, date_trunc('day', max(ts))::TIMESTAMP AS hi FROM events)) LEFT JOIN events ON CAST(ts AS DATE) = d AND event_type = 'signup' GROUP BY 1")
def generate_dates(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    days = events.agg(F.min(F.to_date("ts")).alias("lo"), F.max(F.to_date("ts")).alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("d"))
    counted = events.where("event_type = 'signup'").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("events"))
    return days.join(counted, "d", "left").select("d", F.coalesce("events", F.lit(0)).alias("events"))


@query("SELECT o_orderkey, i AS part FROM orders, range(0, 4) r(i) WHERE i <= o_orderkey % 4")
def generator_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_orderkey") % 4)).alias("part"))


@query("SELECT * EXCLUDE (o_totalprice, o_orderdate) FROM orders")
def select_except(spark, sf_dir):
    return table(spark, sf_dir, "orders").drop("o_totalprice", "o_orderdate")


# ---- functions


@query("SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, upper(hex(c_name::BLOB)) AS h, base64(c_name::BLOB) AS b FROM customer")
def fn_hash_encode(spark, sf_dir):
    c = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", F.md5(c).alias("m"), F.sha2(c, 256).alias("s"), F.hex(c).alias("h"), F.base64(c.cast("binary")).alias("b"))


@query("""SELECT p_partkey, p_retailprice / nullif(p_size % 5, 0) AS quotient, CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_retailprice / (p_size % 5) END AS zero,
  CASE WHEN coalesce(nullif(p_size % 5, 3), 0) = 0 THEN 0 ELSE p_retailprice / (p_size % 5) END AS zero_null, p_partkey % 7 AS rest, p_partkey // 7 AS whole FROM part""")
def fn_safe_math(spark, sf_dir):
    rest = F.col("p_size") % 5
    return table(spark, sf_dir, "part").select("p_partkey", f.safe_divide("p_retailprice", rest).alias("quotient"), f.div0("p_retailprice", rest).alias("zero"), f.div0null("p_retailprice", F.nullif(rest, F.lit(3))).alias("zero_null"), (F.col("p_partkey") % 7).alias("rest"), F.expr("p_partkey div 7").alias("whole"))


@query("""SELECT c_custkey, round(log10(abs(c_acctbal) + 1), 6) AS l, trunc(c_acctbal / 10) / 10 AS cut, c_acctbal * c_acctbal AS sq, round(cbrt(c_custkey), 6) AS root,
  round(2 * 6371.0 * asin(sqrt(pow(sin(radians(c_nationkey * 2.0) / 2), 2) + cos(radians(10.0)) * cos(radians(10.0 + c_nationkey * 2.0)) * pow(sin(radians(c_nationkey * 3.0) / 2), 2))), 4) AS km FROM customer""")
def fn_math(spark, sf_dir):
    k = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(F.log(10.0, F.abs("c_acctbal") + 1), 6).alias("l"), f.trunc_to(F.col("c_acctbal") / 100, 1).alias("cut"), f.square("c_acctbal").alias("sq"), F.round(F.cbrt("c_custkey"), 6).alias("root"), F.round(f.haversine(F.lit(10.0), F.lit(20.0), 10.0 + k * 2.0, 20.0 + k * 3.0), 4).alias("km"))


@query("SELECT event_id, TRY_CAST(substr(event_type, 1, 1) || user_id AS INTEGER) AS never, TRY_CAST(CASE WHEN user_id % 2 = 0 THEN '12' ELSE 'x' END AS INTEGER) AS some, CAST(value AS DECIMAL(18,1)) AS d, CAST(user_id AS VARCHAR) AS s, user_id % 2 = 1 AS flag FROM events")
def fn_try_cast(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.substring("event_type", 1, 1), F.col("user_id").cast("string")).try_cast("int").alias("never"), F.when(F.col("user_id") % 2 == 0, "12").otherwise("x").try_cast("int").alias("some"), F.col("value").cast("decimal(18,1)").alias("d"), F.col("user_id").cast("string").alias("s"), (F.col("user_id") % 2).cast("boolean").alias("flag"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none, array_to_string(json_keys(props), ',') AS keys FROM events")
def fn_json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.none").alias("none"), F.array_join(f.object_keys("props"), ",").alias("keys"))


@query("""SELECT event_id, '{"user":' || user_id || ',"tags":["' || event_type || '",null]}' AS doc FROM events""")
def fn_json_build(spark, sf_dir):
    doc = F.to_json(F.struct(F.col("user_id").alias("user"), F.array(F.col("event_type"), F.lit(None)).alias("tags")), {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))


@query("""SELECT p_partkey, strpos(p_name, 'i') AS at, starts_with(p_name, 'red') AS red, p_name ILIKE '%BOLT%' AS bolt, split_part(p_name, ' ', 2) AS second, length(p_type) AS n, lpad(p_brand, 10, '*') AS padded,
  levenshtein(p_type, p_brand) AS distance, reverse(p_name) AS back, replace(p_name, ' ', '_') AS joined, ascii(p_name) AS code FROM part""")
def fn_string(spark, sf_dir):
    c = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", f.strpos(c, "i").cast("long").alias("at"), c.startswith("red").alias("red"), c.ilike("%BOLT%").alias("bolt"), f.split_part(c, " ", 2).alias("second"), F.length("p_type").cast("long").alias("n"), F.lpad("p_brand", 10, "*").alias("padded"), F.levenshtein("p_type", "p_brand").cast("long").alias("distance"), F.reverse(c).alias("back"), F.replace(c, F.lit(" "), F.lit("_")).alias("joined"), F.ascii(c).alias("code"))


@query(r"SELECT p_partkey, regexp_extract(p_brand, '#(\d+)', 1) AS number, regexp_matches(p_name, '^(red|blue)') AS coloured, regexp_replace(p_name, '[aeiou]', '_', 'g') AS masked, len(regexp_extract_all(p_name, '[aeiou]')) AS vowels FROM part")
def fn_regexp(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_extract("p_brand", r"#(\d+)", 1).alias("number"), F.col("p_name").rlike("^(red|blue)").alias("coloured"), F.regexp_replace("p_name", "[aeiou]", "_").alias("masked"), F.regexp_count("p_name", F.lit("[aeiou]")).cast("long").alias("vowels"))


@query("SELECT o_orderkey, CAST(o_orderdate + INTERVAL 40 DAY AS DATE) AS later, CAST(o_orderdate - INTERVAL 2 MONTH AS DATE) AS earlier, last_day(o_orderdate) AS month_end, o_orderdate + INTERVAL 90 MINUTE AS soon FROM orders")
def fn_date_arith(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_add(d, 40).alias("later"), F.add_months(d, -2).alias("earlier"), F.last_day(d).alias("month_end"), (d + F.expr("INTERVAL 90 MINUTE")).alias("soon"))


@query("""SELECT event_id, date_diff('year', TIMESTAMP '2023-12-31', ts) AS years, date_diff('month', TIMESTAMP '2023-11-30', ts) AS months, date_diff('day', TIMESTAMP '2023-12-31 23:59:59', ts) AS days, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS hours,
  CAST(floor((CAST(ts AS DATE) - DATE '1970-01-04') / 7) - floor((DATE '2023-12-30' - DATE '1970-01-04') / 7) AS BIGINT) AS weeks FROM events""")
def fn_date_diff(spark, sf_dir):
    at = lambda s: F.to_timestamp_ntz(F.lit(s))
    return table(spark, sf_dir, "events").select("event_id", f.date_diff("year", "ts", at("2023-12-31 00:00:00")).alias("years"), f.date_diff("month", "ts", at("2023-11-30 00:00:00")).alias("months"), f.date_diff("day", "ts", at("2023-12-31 23:59:59")).alias("days"), f.date_diff("hour", "ts", at("2024-01-01 00:00:00")).alias("hours"), f.date_diff("week", "ts", at("2023-12-30 00:00:00")).alias("weeks"))


@query("SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, CAST(date_trunc('year', o_orderdate) AS DATE) AS y, CAST(date_trunc('week', o_orderdate) AS DATE) AS w FROM orders")
def fn_date_trunc(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", *(F.date_trunc(unit, "o_orderdate").cast("date").alias(unit[0]) for unit in ("month", "quarter", "year", "week")))


@query("SELECT o_orderkey, CAST(date_trunc('week', o_orderdate + INTERVAL 1 DAY) AS DATE) - 1 AS week FROM orders")
def fn_week_sunday(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", f.week_start_sunday("o_orderdate").alias("week"))


@query("""SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS quarter_hour, time_bucket(INTERVAL 2 WEEK, ts, TIMESTAMP '1969-12-29') AS fortnight, time_bucket(INTERVAL 5 MONTH, ts, TIMESTAMP '1970-01-01') AS five_months,
  ts + INTERVAL 9 HOUR AS tokyo FROM events""")
def fn_time_slice(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", f.time_slice("ts", 15, "minute").alias("quarter_hour"), f.time_slice("ts", 2, "week").alias("fortnight"), f.time_slice("ts", 5, "month").alias("five_months"), f.convert_timezone("UTC", "Asia/Tokyo", "ts").alias("tokyo"))


@query("SELECT event_id, year(ts) AS y, quarter(ts) AS q, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, dayofweek(ts) + 1 AS dow, dayofyear(ts) AS doy, weekofyear(ts) AS iso_week FROM events")
def fn_extract(spark, sf_dir):
    parts = {"y": F.year, "q": F.quarter, "m": F.month, "d": F.dayofmonth, "h": F.hour, "mi": F.minute, "dow": F.dayofweek, "doy": F.dayofyear, "iso_week": F.weekofyear}
    return table(spark, sf_dir, "events").select("event_id", *(fn("ts").cast("long").alias(name) for name, fn in parts.items()))


@query("SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M') AS text, strftime(ts, '%j') AS day_of_year, CAST(ts AS DATE) AS back, TRY_CAST('2024-02-' || (20 + event_id % 12) AS DATE) AS bad FROM events")
def fn_date_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", f.format_date("%d/%m/%Y %H:%M", "ts").alias("text"), f.format_date("%j", "ts").alias("day_of_year"), f.parse_date("%Y-%m-%d", F.date_format("ts", "yyyy-MM-dd")).alias("back"), f.parse_date("%Y-%m-%d", F.concat(F.lit("2024-02-"), (20 + F.col("event_id") % 12).cast("string"))).alias("bad"))


@query("SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds, epoch_us(ts) // 1000 AS millis, epoch_us(ts) AS micros, CAST(ts AS DATE) - DATE '1970-01-01' AS days FROM events")
def fn_epoch(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", F.unix_seconds(ts).alias("seconds"), F.unix_millis(ts).alias("millis"), F.unix_micros(ts).alias("micros"), F.unix_date(F.to_date("ts")).cast("long").alias("days"))


@query("SELECT p_partkey, len(w) AS n, array_to_string(list_concat(w, [p_type]), '/') AS joined, array_to_string(list_reverse(w), ' ') AS back, list_contains(w, 'ring') AS ring, array_to_string(w[1:1], ',') AS head FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)")
def fn_array(spark, sf_dir):
    w = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.size(w).cast("long").alias("n"), F.array_join(F.concat(w, F.array("p_type")), "/").alias("joined"), F.array_join(F.reverse(w), " ").alias("back"), F.array_contains(w, "ring").alias("ring"), F.array_join(f.array_slice(w, 0, 1), ",").alias("head"))


@query("SELECT vec_id, round(list_sum([x::DOUBLE * 2 for x in embedding[1:8]]), 5) AS doubled, len([x for x in embedding if x > 0]) AS positive, round(list_sum([x::DOUBLE for x in embedding]), 5) AS total FROM embeddings")
def fn_array_hof(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(add(F.transform(F.slice(e, 1, 8), lambda x: x * 2)), 5).alias("doubled"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("positive"), F.round(add(e), 5).alias("total"))


@query("SELECT vec_id, embedding[1] AS first, embedding[3] AS third, embedding[61 + vec_id % 8] AS outside, embedding[-1] AS last FROM embeddings")
def fn_array_access(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", f.array_offset("embedding", 0).alias("first"), f.array_offset("embedding", 2, safe=False).alias("third"), F.get("embedding", (60 + F.col("vec_id") % 8).cast("int")).alias("outside"), F.element_at("embedding", -1).alias("last"))


@query("SELECT c_custkey, c_name AS name, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END AS even_segment, CASE WHEN c_nationkey % 2 = 0 THEN 2 ELSE 1 END AS size FROM customer")
def fn_struct_map(spark, sf_dir):
    pair = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")))
    named = table(spark, sf_dir, "customer").select(F.struct("c_custkey").alias("row"), pair.alias("m"))
    return named.select("row.c_custkey", F.col("m")["name"].alias("name"), F.col("m")["segment"].alias("even_segment"), F.size(F.map_filter("m", lambda _, v: v.isNotNull())).alias("size"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS word, coalesce(nullif(o_orderkey % 3, 0), 0) AS zero, nullif(o_orderkey % 3, 0) AS gone,
  CASE WHEN o_orderkey % 7 <> 0 THEN 'yes' ELSE 'no' END AS there, nullif(o_orderkey % 5, 0) IS NOT DISTINCT FROM nullif(o_custkey % 5, 0) AS same FROM orders""")
def fn_conditional(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", f.decode("o_orderstatus", "F", "done", "O", "open", default="other").alias("word"), f.zero_if_null(F.nullif(k % 3, F.lit(0))).alias("zero"), f.null_if_zero(k % 3).alias("gone"), f.nvl2(F.nullif(k % 7, F.lit(0)), F.lit("yes"), F.lit("no")).alias("there"), f.equal_null(F.nullif(k % 5, F.lit(0)), F.nullif(c % 5, F.lit(0))).alias("same"))
