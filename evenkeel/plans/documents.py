"""Queries over documents as a source and a changed copy: stored results, tables made anew, comparisons that read little or need no keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators import compare, hash_tree
from evenkeel.plans.forms import hash_sql, int_sql, text_sql
from evenkeel.plans.registry import query, table
from evenkeel.sources.files import working_folder
from evenkeel.sources.store import KeyedStore, TextCache, text_key
from evenkeel.sources.tables import materialise


def texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """documents, and a copy with rows dropped, texts changed and rows repeated."""
    source = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "source", "text")
    changed = F.when(F.col("doc_id") % 101 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    target = source.where("doc_id % 97 <> 0").withColumn("text", changed)
    return source, target.unionByName(source.where("doc_id % 103 = 0"))


_PAIR = """s AS (SELECT doc_id, lang, n_chars, source, text FROM documents),
t AS (SELECT * REPLACE (CASE WHEN doc_id % 101 = 0 THEN text || '!' ELSE text END AS text) FROM s WHERE doc_id % 97 <> 0 UNION ALL SELECT * FROM s WHERE doc_id % 103 = 0)"""
_HASH = hash_sql({"doc_id": int_sql("doc_id"), "n_chars": int_sql("n_chars")} | {c: text_sql(c) for c in ("lang", "source", "text")})
_COUNTED = f"""WITH {_PAIR}, h AS (SELECT *, {_HASH} AS row_hash, 1 AS in_s, 0 AS in_t FROM s UNION ALL SELECT *, {_HASH}, 0, 1 FROM t),
c AS (SELECT row_hash, sum(in_s) AS n_s, sum(in_t) AS n_t, any_value(doc_id) AS doc_id, any_value(length(text)) AS characters FROM h GROUP BY row_hash)"""


@query(f"""{_COUNTED} SELECT sum(n_s) AS source_hash_count, sum(n_t) AS target_hash_count, sum(least(n_s, n_t)) AS matched_hash_count, sum(greatest(n_s - n_t, 0)) AS source_not_in_target_count,
  sum(greatest(n_t - n_s, 0)) AS target_not_in_source_count, CASE WHEN count(*) FILTER (n_s <> n_t) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c""")
def row_hash_tree(spark, sf_dir):
    """The counts of row_hash_compare, moving only rows of unequal buckets."""
    return hash_tree.row_hashes(*texts(spark, sf_dir)).drop("similarity")


@query(f"""{_COUNTED}, x AS (SELECT 'source' AS side, row_hash, n_s - n_t AS surplus, doc_id, characters FROM c WHERE n_s > n_t UNION ALL SELECT 'target', row_hash, n_t - n_s, doc_id, characters FROM c WHERE n_t > n_s)
SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY side ORDER BY row_hash) <= 50""")
def row_examples(spark, sf_dir):
    """Whole rows that have no equal on the other side, 50 of each."""
    return hash_tree.unmatched_rows(*texts(spark, sf_dir)).select("side", "row_hash", "surplus", "doc_id", F.length("text").cast("long").alias("characters"))


_COLUMNS = ("doc_id", "lang", "n_chars", "source", "text")


@query(f"WITH {_PAIR}, u AS (SELECT {', '.join(_COLUMNS)}, sum(d) AS more FROM (SELECT *, 1 AS d FROM s UNION ALL SELECT *, -1 FROM t) GROUP BY ALL HAVING sum(d) <> 0), met AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", sum(least(a, b)) AS rows FROM (SELECT sum(greatest(more, 0)) AS a, sum(greatest(-more, 0)) AS b FROM u GROUP BY {', '.join(x for x in _COLUMNS if x != c)})" for c in _COLUMNS) + ') SELECT "column", CAST(rows AS BIGINT) AS rows FROM met WHERE rows > 0')
def columns_without_keys(spark, sf_dir):
    """The columns in which rows differ, found without keys."""
    return compare.mismatched_without_keys(*texts(spark, sf_dir))


# ---- stored tables


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A validation result for each document."""
    return table(spark, sf_dir, "documents").selectExpr("concat('v', doc_id) AS validation_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id % 1000 AS INT)) AS validation_ts", "concat('src.', source) AS src_table_name", "CASE WHEN n_chars % 9 = 0 THEN 'FAIL' ELSE 'PASS' END AS row_count", "CASE WHEN doc_id % 4 <> 0 THEN lang END AS run_by")


@query("""WITH r AS (SELECT 'v' || doc_id AS validation_id, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (doc_id % 1000) AS validation_ts, 'src.' || source AS src_table_name, CASE WHEN n_chars % 9 = 0 THEN 'FAIL' ELSE 'PASS' END AS row_count, CASE WHEN doc_id % 4 <> 0 THEN lang END AS run_by FROM documents),
n AS (SELECT validation_id, validation_ts + INTERVAL 1 DAY AS validation_ts, src_table_name, 'PASS' AS row_count, CASE WHEN validation_id LIKE '%7' THEN 'late' END AS run_by FROM r WHERE validation_id LIKE '%3' OR validation_id LIKE '%7')
SELECT r.validation_id, coalesce(n.validation_ts, r.validation_ts) AS validation_ts, r.src_table_name, coalesce(n.row_count, r.row_count) AS row_count, coalesce(n.run_by, r.run_by) AS run_by FROM r LEFT JOIN n USING (validation_id)""")
def stored_upsert(spark, sf_dir):
    """Results stored by key, then later ones of some of them merged in."""
    first = _results(spark, sf_dir)
    store = KeyedStore(spark, working_folder(spark, "evenkeel-results"), first.schema, "validation_id", buckets=16)
    store.upsert(first)
    later = first.where("validation_id LIKE '%3' OR validation_id LIKE '%7'")
    store.upsert(later.withColumns({"validation_ts": F.expr("validation_ts + INTERVAL 1 DAY"), "row_count": F.lit("PASS"), "run_by": F.when(F.col("validation_id").like("%7"), "late")}))
    return store.read()


@query("""WITH e AS (SELECT lang || ' ' || source || ' ' || (doc_id // 4) AS text, doc_id FROM documents),
k AS (SELECT text, count(*) AS lookups FROM e GROUP BY 1), p AS (SELECT DISTINCT text FROM e WHERE doc_id % 3 = 0 AND text IS NOT NULL)
SELECT k.text, 'to ' || p.text AS result, CASE WHEN p.text IS NULL THEN 0 ELSE k.lookups END AS accesses FROM k LEFT JOIN p ON p.text = k.text WHERE k.text IS NOT NULL""")
def text_cache(spark, sf_dir):
    """Texts put into a cache, looked up by all rows with other spacing, and what each has been used."""
    asked = table(spark, sf_dir, "documents").select(F.concat_ws(" ", "lang", "source", F.expr("doc_id div 4").cast("string")).alias("text"), "doc_id").where("lang IS NOT NULL AND source IS NOT NULL")
    now = F.to_timestamp_ntz(F.lit("2024-05-01 00:00:00"))
    cache = TextCache(spark, working_folder(spark, "evenkeel-cache"), buckets=8)
    put = asked.where("doc_id % 3 = 0").select("text").distinct()
    cache.put(put.select(text_key(F.col("text")).alias("text_key"), "text", F.concat(F.lit("to "), "text").alias("result")), now)
    spaced = F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("\n  ")))
    cache.lookup(asked.select(text_key(spaced).alias("text_key")), now)
    entries = cache.store.read().select(F.col("text_key").alias("k"), "result", "accesses")
    keys = asked.select("text").distinct()
    return keys.join(entries, text_key(F.col("text")) == F.col("k"), "left").select("text", "result", F.coalesce("accesses", F.lit(0)).alias("accesses"))


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def target_materialise(spark, sf_dir):
    """The result of a query made a table in a schema that isn't there yet, replaced by another's, and read."""
    place = working_folder(spark, "evenkeel-tables")
    name = f"evenkeel_{place[-10:]}.copied"
    documents = table(spark, sf_dir, "documents")
    materialise(documents.groupBy("lang").agg(F.count("*").alias("documents")), name, location=place)
    return materialise(documents.select("doc_id", "lang", "source", "n_chars"), name, location=place)
