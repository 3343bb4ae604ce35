"""Job files as DataFrames: validation jobs (two layouts) and query files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FLAGS = ("1", "true", "yes", "y")

#: Parts of a statement that a semicolon in them doesn't end. Possessive, so that a text of any length needs no deep stack.
COMMENT = r"""--[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)"""
QUOTED = r'''"{3}(?:[^"]++|"(?!""))*+"{3}|"(?:[^"\\]++|\\.)*+"|`[^`]*+`|''' + r"'{3}(?:[^']++|'(?!''))*+'{3}|'(?:[^'\\]++|\\.)*+'"
STATEMENT = rf"""(?s)((?:[^;'"`/-]++|{COMMENT}|{QUOTED}|['"`/-])++)"""


def _csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True, comment="#", multiLine=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.toDF(*(c.strip("﻿ ").lower() for c in df.columns))


def _flag(name: str):
    return F.coalesce(F.lower(F.trim(name)).isin(*_FLAGS), F.lit(False)).alias(name)


def _names(name: str):
    parts = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"[\[\]'\"]", ""), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    return parts.alias(name)


def _metrics(name: str = "metrics"):
    every = F.array(*(F.lit(x) for x in ("row_count", "schema", "numeric", "hash")))
    own = F.transform(_names(name), F.lower)
    return F.when(F.array_contains(own, "all"), every).otherwise(own).alias("metrics")


def table_jobs(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """source_table, target_table, validation_type, metrics, case_sensitive, include_timestamp, categorical_columns.

    strict: a type that is neither shallow nor deep raises when the row is read. Without it the type stays as it is, and the runner
    makes it the ERROR of its row.
    """
    df = _csv(spark, path)
    if "categorical_columns" not in df.columns:
        df = df.withColumn("categorical_columns", F.lit(None).cast("string"))
    kind = F.lower(F.trim("validation_type"))
    if strict:
        kind = F.when(kind.isin("shallow", "deep"), kind).otherwise(F.raise_error(F.concat(F.lit("validation type must be shallow or deep: "), F.coalesce(kind, F.lit("")))).cast("string"))
    return df.select(F.trim("source_table").alias("source_table"), F.trim("target_table").alias("target_table"), kind.alias("validation_type"), _metrics(), _flag("case_sensitive"), _flag("include_timestamp"), _names("categorical_columns"))


def coordinate_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The layout with catalog, schema and table of each side, filters, a threshold (above 1: a percentage) and keys. problem: why a row can't run."""
    df = _csv(spark, path)
    for c in ("where_clause", "use_separate_where", "source_where", "target_where", "metrics", "case_sensitive", "include_timestamp", "row_threshold", "categorical_columns", "primary_keys"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    name = lambda side: F.concat_ws(".", *(F.trim(f"{side}_{p}") for p in ("catalog", "schema", "table"))).alias(f"{side}_table")
    share = F.col("row_threshold").try_cast("double")
    wrong = F.when(F.nullif(F.trim("row_threshold"), F.lit("")).isNotNull() & share.isNull(), F.concat(F.lit("row_threshold is no number: "), F.trim("row_threshold")))
    apart = F.coalesce(F.lower(F.trim("use_separate_where")).isin(*_FLAGS), F.lit(False))
    shared = F.coalesce(F.nullif(F.trim("where_clause"), F.lit("")), F.lit("1=1"))
    side = lambda c: F.when(apart, F.coalesce(F.nullif(F.trim(c), F.lit("")), shared)).otherwise(shared).alias(c)
    return df.select(name("source"), name("target"), F.lower(F.trim("validation_type")).alias("validation_type"), side("source_where"), side("target_where"), _metrics(), _flag("case_sensitive"), _flag("include_timestamp"), F.when(share > 1, share / 100).otherwise(share).alias("row_threshold"), _names("categorical_columns"), _names("primary_keys"), wrong.alias("problem"))


def query_file(spark: SparkSession, path: str) -> DataFrame:
    """sql, one row for each statement: of the first column named for queries, else the first column.

    Semicolons in quotes (also triple ones and backticks) and in comments don't split; a quote that never closes is a character
    like any other; what has no text besides comments is no statement.
    """
    df = _csv(spark, path)
    named = [c for c in ("bq_sql", "sql", "query", "bigquery_sql", "bq_query") if c in df.columns]
    text = F.col(f"`{named[0] if named else df.columns[0]}`")
    statements = F.transform(F.regexp_extract_all(text, F.lit(STATEMENT), F.lit(1)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return df.select(F.explode(F.filter(statements, lambda s: F.trim(F.regexp_replace(s, rf"(?s){COMMENT}|\s+", "")) != "")).alias("sql"))
