"""Queries of semi-structured values, stored sketches, order-free hashes, collations and pivots, over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.functions import geo
from evenkeel.functions import variant as v
from evenkeel.functions import warehouse as f
from evenkeel.functions.canonical import hash_agg
from evenkeel.operators import compare, reshape, sketches
from evenkeel.plans.forms import hash_sql, int_sql, text_sql
from evenkeel.plans.registry import query, table
from evenkeel.sources.files import working_folder


def _objects(spark, sf_dir):
    """A JSON text for each document; every seventh is broken."""
    text = F.to_json(F.struct(F.col("doc_id").alias("id"), F.struct(F.col("n_chars").alias("chars"), F.lower("lang").alias("lang")).alias("about"), F.array("source", F.lit(None), F.lit("x y")).alias("tags"), F.expr("CAST(doc_id AS DOUBLE) / 4").alias("part of")), {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("{"), text)).otherwise(text).alias("doc"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN n_chars END AS chars, CASE WHEN doc_id % 7 <> 0 THEN source END AS first_tag, CASE WHEN doc_id % 7 <> 0 THEN lower(lang) END AS lang, CAST(NULL AS BIGINT) AS lang_as_number,
  CASE WHEN doc_id % 7 <> 0 THEN 'OBJECT' END AS about_type, CASE WHEN doc_id % 7 <> 0 THEN 'ARRAY' END AS tags_type, CASE WHEN doc_id % 7 <> 0 THEN 'NULL_VALUE' END AS null_type, CASE WHEN doc_id % 7 <> 0 THEN doc_id / 4 END AS part FROM documents""")
def fn_variant(spark, sf_dir):
    """PARSE_JSON, paths with casts, TYPEOF."""
    parsed = _objects(spark, sf_dir).select("doc_id", v.parse("doc").alias("d"))
    return parsed.select("doc_id", v.get("d", "about:chars", "bigint").alias("chars"), v.get("d", "tags[0]", "string").alias("first_tag"), v.get("d", "$.about.lang", "string").alias("lang"), v.get("d", "about.lang", "bigint").alias("lang_as_number"), v.type_of(v.get("d", "about")).alias("about_type"), v.type_of(v.get("d", "tags")).alias("tags_type"), v.type_of(v.get("d", "tags[1]")).alias("null_type"), v.get("d", "['part of']", "double").alias("part"))


@query("""WITH d AS (SELECT * FROM documents WHERE doc_id % 7 <> 0)
SELECT doc_id, 'id' AS path, 'id' AS key, CAST(NULL AS BIGINT) AS index, CAST(doc_id AS VARCHAR) AS value FROM d
UNION ALL SELECT doc_id, '[''part of'']', 'part of', NULL, rtrim(rtrim(CAST(doc_id / 4 AS VARCHAR), '0'), '.') FROM d
UNION ALL SELECT doc_id, 'about.chars', 'chars', NULL, CAST(n_chars AS VARCHAR) FROM d
UNION ALL SELECT doc_id, 'about.lang', 'lang', NULL, lower(lang) FROM d
UNION ALL SELECT doc_id, 'tags[0]', NULL, 0, source FROM d UNION ALL SELECT doc_id, 'tags[1]', NULL, 1, NULL FROM d UNION ALL SELECT doc_id, 'tags[2]', NULL, 2, 'x y' FROM d
UNION ALL SELECT doc_id, 'about', 'about', NULL, 'OBJECT' FROM d UNION ALL SELECT doc_id, 'tags', 'tags', NULL, 'ARRAY' FROM d""")
def flatten_recursive(spark, sf_dir):
    """FLATTEN(..., RECURSIVE => TRUE): every element at any depth."""
    parsed = _objects(spark, sf_dir).select("doc_id", v.parse("doc").alias("d"))
    found = v.flatten(parsed, "d", ["doc_id"], folder=working_folder(spark, "evenkeel-flatten"))
    kind = v.type_of("value")
    shown = F.when(kind.isin("OBJECT", "ARRAY"), kind).when(F.col("key") == "part of", F.regexp_replace(F.try_variant_get("value", "$", "double").cast("string"), r"\.0$", "")).otherwise(F.try_variant_get("value", "$", "string"))
    return found.select("doc_id", "path", "key", "index", shown.alias("value"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN i END AS index, CASE WHEN doc_id % 7 <> 0 THEN 'tags[' || i || ']' END AS path, CASE WHEN doc_id % 7 <> 0 THEN [source, NULL, 'x y'][i + 1] END AS value
FROM documents, range(0, 3) r(i) WHERE doc_id % 7 <> 0 OR i = 0""")
def flatten_outer(spark, sf_dir):
    """FLATTEN(input, PATH => 'tags', OUTER => TRUE)."""
    parsed = _objects(spark, sf_dir).select("doc_id", v.parse("doc").alias("d"))
    return v.flatten(parsed, "d", ["doc_id"], path="tags", outer=True).select("doc_id", "index", "path", F.try_variant_get("value", "$", "string").alias("value"))


@query("""WITH w AS (SELECT doc_id // 500 AS block, source AS item, sum(n_chars) AS weight FROM documents WHERE n_chars > 0 GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY weight DESC, item) AS place FROM w)
SELECT CAST(block AS VARCHAR) AS "group", CAST(place AS INTEGER) AS place, item, CAST(weight AS DOUBLE) AS weight, CAST(weight AS DOUBLE) AS most FROM p WHERE place <= 3""")
def approx_top_sum(spark, sf_dir):
    """The sources with most characters in each block of documents; summaries of even and odd documents are made apart and put together."""
    documents = table(spark, sf_dir, "documents").withColumn("block", F.expr("doc_id div 500"))
    halves = [sketches.top_sums(documents.where(F.col("doc_id") % 2 == i), "block", "source", "n_chars") for i in range(2)]
    return sketches.top_of_sums(halves[0].union(halves[1]), 3)


@query("SELECT doc_id // 1000 AS span, count(*) AS rows, count(DISTINCT source) AS distinct_values, CAST(quantile_disc(n_chars, 0.5) AS DOUBLE) AS middle FROM documents GROUP BY 1")
def stored_sketches(spark, sf_dir):
    """Sketches kept for each hundred documents, put together for each thousand."""
    place = working_folder(spark, "evenkeel-sketches")
    documents = table(spark, sf_dir, "documents").withColumn("day", F.expr("doc_id div 100"))
    sketches.kept_sketches(documents, ["day"], "source", "n_chars").write.parquet(f"{place}/kept")
    kept = spark.read.parquet(f"{place}/kept").withColumn("span", F.expr("day div 10"))
    return sketches.of_sketches(kept, ["span"], [0.5]).select("span", "rows", "distinct_values", F.col("quantiles")[0].alias("middle"))


_LANES = " || ':' || ".join(f"CAST(sum(CAST('0x' || substr(h, {15 * i + 1}, 15) AS BIGINT)) AS VARCHAR)" for i in range(2))


@query(f"SELECT doc_id // 50 AS block, upper(md5(count(*) || ':' || {_LANES})) AS hash FROM (SELECT doc_id, {hash_sql({'lang': text_sql('lang'), 'n_chars': int_sql('n_chars'), 'text': text_sql('text')})} AS h FROM documents) GROUP BY 1")
def agg_hash(spark, sf_dir):
    """HASH_AGG of three columns for each block of documents."""
    documents = table(spark, sf_dir, "documents")
    return documents.groupBy(F.expr("doc_id div 50").alias("block")).agg(hash_agg(documents, ["lang", "n_chars", "text"]).alias("hash"))


@query("""SELECT 'Doc ' || doc_id AS name, 'n_chars' AS "column", CAST(n_chars AS VARCHAR) AS source_value, CAST(n_chars + 1 AS VARCHAR) AS target_value FROM documents WHERE doc_id % 5 = 0""")
def collated_keys(spark, sf_dir):
    """Differences of rows whose keys are equal without case."""
    documents = table(spark, sf_dir, "documents")
    source = documents.select(F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("name"), "n_chars", "lang")
    target = documents.select(F.concat(F.lit("dOC "), F.col("doc_id").cast("string")).alias("name"), (F.col("n_chars") + (F.col("doc_id") % 5 == 0).cast("long")).alias("n_chars"), "lang")
    return compare.column_differences(source, target, ["name"], collation="UTF8_LCASE")


@query("""WITH c AS (SELECT doc_id // 50 AS block, lower(coalesce(lang, 'none')) AS lang, count(*) AS n, max(n_chars) AS longest FROM documents GROUP BY ALL),
k AS (SELECT DISTINCT block FROM c), l AS (SELECT DISTINCT lang FROM c)
SELECT k.block, l.lang || '_n' AS name, c.n AS value FROM k CROSS JOIN l LEFT JOIN c ON c.block = k.block AND c.lang = l.lang
UNION ALL SELECT k.block, l.lang || '_longest', c.longest FROM k CROSS JOIN l LEFT JOIN c ON c.block = k.block AND c.lang = l.lang""")
def pivot_unpivot(spark, sf_dir):
    """Counts and maxima of each language as columns, found first, and these as rows again, nulls too."""
    documents = table(spark, sf_dir, "documents").select(F.expr("doc_id div 50").alias("block"), F.lower(F.coalesce("lang", F.lit("none"))).alias("lang"), "n_chars")
    wide = reshape.pivot(documents, ["block"], "lang", {"n": F.count("*"), "longest": F.max("n_chars")})
    return reshape.unpivot(wide, ["block"], wide.columns[1:], nulls=True)


@query(r"""WITH h AS (SELECT page_id, regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]*)', 1) AS host FROM pages)
SELECT page_id, nullif(host, '') AS host, nullif(regexp_extract(lower(host), '[^.]*$'), '') AS suffix, nullif(regexp_extract(lower(host), '[^.]+\.[^.]*$'), '') AS domain FROM h""")
def fn_network(spark, sf_dir):
    """NET.HOST, NET.PUBLIC_SUFFIX, NET.REG_DOMAIN."""
    return table(spark, sf_dir, "pages").select("page_id", f.net_host("url").alias("host"), f.net_public_suffix("url").alias("suffix"), f.net_reg_domain("url").alias("domain"))


@query("""WITH d AS (SELECT doc_id, TIMESTAMP '1999-12-20 01:02:03.456789' + INTERVAL 1 HOUR * (doc_id * 37) AS t FROM documents)
SELECT doc_id, CAST(last_day(t) AS DATE) AS month, CAST(date_trunc('quarter', t) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter, make_date(year(t), 12, 31) AS year, CAST(date_trunc('week', t + INTERVAL 1 DAY) + INTERVAL 5 DAY AS DATE) AS week,
  CAST(date_trunc('week', t) + INTERVAL 6 DAY AS DATE) AS isoweek, isodow(t) AS day_of_week, dayofweek(t) + 1 AS dayofweek, CAST(strftime(t, '%U') AS BIGINT) AS week_number, weekofyear(t) AS iso_number, isoyear(t) AS iso_year, microsecond(t) % 1000000 AS micros FROM d""")
def fn_last_day(spark, sf_dir):
    """LAST_DAY with parts, and EXTRACT with the parts of other warehouses."""
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "timestamp_ntz '1999-12-20 01:02:03.456789' + make_dt_interval(0, CAST(doc_id * 37 AS INT)) AS t")
    ends = [f.last_day("t", p).alias(p) for p in ("month", "quarter", "year", "week", "isoweek")]
    parts = {"day_of_week": "day_of_week", "dayofweek": "dayofweek", "week_number": "week", "iso_number": "isoweek", "iso_year": "isoyear", "micros": "microsecond"}
    return d.select("doc_id", *ends, *(f.extract(part, "t").alias(name) for name, part in parts.items()))


_KM = "2 * 6371008.8 * asin(sqrt(least(pow(sin(radians(lat - 20) / 2), 2) + cos(radians(20)) * cos(radians(lat)) * pow(sin(radians(lon - 10) / 2), 2), 1)))"


@query(f"""WITH p AS (SELECT doc_id, CAST(doc_id * 37 % 360 - 180 AS DOUBLE) AS lon, CAST(doc_id * 17 % 200 - 100 AS DOUBLE) AS lat FROM documents), q AS (SELECT doc_id, lon, CASE WHEN abs(lat) <= 90 THEN lat END AS lat FROM p)
SELECT doc_id, CASE WHEN lat IS NOT NULL THEN 'POINT(' || CAST(lon AS BIGINT) || ' ' || CAST(lat AS BIGINT) || ')' END AS text, round({_KM}, 2) AS metres, {_KM} <= 3000000 AS near,
  round(CASE WHEN lon <> 10 OR lat <> 20 THEN (atan2(sin(radians(10 - lon)) * cos(radians(20)), cos(radians(lat)) * sin(radians(20)) - sin(radians(lat)) * cos(radians(20)) * cos(radians(10 - lon))) + 2 * pi()) % (2 * pi()) END, 6) AS direction,
  coalesce(lat >= 0 AND lat < 40 AND lon >= -20 AND lon < 60, false) AS inside FROM q""")
def fn_geo(spark, sf_dir):
    """ST_GEOGPOINT, ST_ASTEXT, ST_DISTANCE, ST_DWITHIN, ST_AZIMUTH, ST_CONTAINS."""
    points = table(spark, sf_dir, "documents").select("doc_id", geo.point(F.expr("doc_id * 37 % 360 - 180"), F.expr("doc_id * 17 % 200 - 100")).alias("p"))
    here = geo.point(F.lit(10), F.lit(20))
    ring = F.array(*(geo.point(F.lit(x), F.lit(y)) for x, y in ((-20, 0), (60, 0), (60, 40), (-20, 40), (-20, 0))))
    return points.select("doc_id", geo.as_text("p").alias("text"), F.round(geo.distance(here, "p"), 2).alias("metres"), geo.within(here, "p", 3_000_000).alias("near"), F.round(geo.azimuth("p", here), 6).alias("direction"), F.coalesce(geo.contains(ring, "p"), F.lit(False)).alias("inside"))
