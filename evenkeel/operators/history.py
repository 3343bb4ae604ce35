"""The store of validation results and queries: upserts, filters, dashboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIST_LIMIT, DASHBOARD_LIMIT = 500, 5000
CHECK_COLUMNS = ("row_count", "schema_check", "numeric_check", "hash_validation")


def upsert(stored: DataFrame, new: DataFrame, key: str = "validation_id", order: str = "validation_ts", keep_if_null: Sequence[str] = ("run_by",)) -> DataFrame:
    """One row a key: the latest; columns in keep_if_null fall back to the latest value that isn't null.

    One aggregation by key, no sort of a key's rows.
    """
    both = stored.select(*stored.columns, F.lit(0).alias("__new")).unionByName(new.select(*stored.columns, F.lit(1).alias("__new")))
    at = F.struct(order, "__new")
    rest = [c for c in stored.columns if c != key]
    last = F.max_by(F.struct(*rest), at).alias("__last")
    known = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(f"__{c}") for c in keep_if_null]
    merged = both.groupBy(key).agg(last, *known)
    return merged.select(key, *(F.coalesce(f"__last.{c}", f"__{c}").alias(c) if c in keep_if_null else F.col(f"__last.{c}").alias(c) for c in rest)).select(*stored.columns)


def job_upsert(stored: DataFrame, new: DataFrame, key: str = "validation_id", overwrite: Sequence[str] = ("state",), order: str | None = None) -> DataFrame:
    """New states over old ones; every other field keeps its old value where the new one is null.

    Of several new rows of a key the latest by `order` counts (without one: the greatest row), and of each other field its latest
    value that isn't null. One aggregation by key; a null key stays one row.
    """
    both = stored.select(*stored.columns, F.lit(0).alias("__new")).unionByName(new.select(*stored.columns, F.lit(1).alias("__new")))
    rest = [c for c in stored.columns if c != key]
    at = F.struct("__new", *([order] if order else []), *rest)
    taken = [F.max_by(F.struct(c), at)[c].alias(c) if c in overwrite else F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in rest]
    return both.groupBy(key).agg(*taken).select(*stored.columns)


def cache_stats(entries: DataFrame, group: str, accesses: str) -> DataFrame:
    """For each group of cache entries: entries, accesses, average_accesses."""
    return entries.groupBy(group).agg(F.count("*").alias("entries"), F.sum(accesses).alias("accesses"), F.round(F.avg(accesses), 4).alias("average_accesses"))


def between(df: DataFrame, start: str | None, end: str | None, column: str = "validation_ts") -> DataFrame:
    """Days from start to end, the end included."""
    if start:
        df = df.where(F.col(column) >= F.to_timestamp_ntz(F.lit(start)))
    if end:
        df = df.where(F.col(column) < F.to_timestamp_ntz(F.lit(end)) + F.expr("interval 1 day"))
    return df


def of_engine(df: DataFrame, engine: str, column: str = "source_engine", fallback: Column | None = None, default: str = "snowflake") -> DataFrame:
    """Rows of an engine; rows without one count as the default's."""
    found = F.coalesce(F.nullif(F.lower(F.trim(column)), F.lit("")), fallback if fallback is not None else F.lit(None), F.lit(default))
    return df.where(found == engine.strip().lower())


def search(df: DataFrame, text: str, page: int, size: int, columns: Sequence[str] = ("validation_id", "src_table_name", "tgt_table_name"), order: str = "validation_ts") -> DataFrame:
    """A page (from 0) of the rows with the text in any of the columns, latest first."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(text.strip().lower()), F.lit(False))
    return df.where(hit).orderBy(F.desc(order), columns[0]).offset(page * size).limit(size)


def latest(df: DataFrame, n: int = LIST_LIMIT, order: str = "validation_ts", key: str = "validation_id") -> DataFrame:
    return df.orderBy(F.desc(order), key).limit(n)


def dashboard(df: DataFrame) -> DataFrame:
    """Distinct table pairs, runs, and passes and failures of each check."""
    pair = F.concat_ws("|", F.coalesce("src_table_name", F.lit("")), F.coalesce("tgt_table_name", F.lit("")))
    names = {"row_count": "row_count", "schema_check": "schema", "numeric_check": "numeric", "hash_validation": "row_hash"}
    counts = [F.count_if(F.upper(c) == status.upper()).alias(f"{name}_{status}") for status in ("pass", "fail") for c, name in names.items()]
    return df.agg(F.countDistinct(pair).alias("tables_validated"), F.count("*").alias("total_runs"), *counts)


def overall_status(checks: Sequence[str] = CHECK_COLUMNS) -> Column:
    """ERROR if no check was selected or one has it, PASS if all that were selected pass, else FAIL."""
    seen = F.filter(F.array(*(F.upper(F.trim(c)) for c in checks)), lambda s: s.isNotNull() & ~s.isin("", "NONE", "NULL"))
    return F.when(F.size(seen) == 0, F.lit("ERROR")).when(F.array_contains(seen, "ERROR"), F.lit("ERROR")).when(F.forall(seen, lambda s: s == "PASS"), F.lit("PASS")).otherwise(F.lit("FAIL"))


def status_counts(df: DataFrame, checks: Sequence[str] = CHECK_COLUMNS) -> DataFrame:
    return df.select(overall_status(checks).alias("status")).agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(f"{s.lower()}_count") for s in ("PASS", "FAIL", "ERROR")))


def query_counts(df: DataFrame, engine: str = "source_engine", level: str = "complexity_level", migrated: str = "migrated", validated: str = "validated", score: str = "complexity_score") -> DataFrame:
    """For each engine: queries, migrated and validated ones, those of each level, the mean score."""
    levels = [F.count_if(F.col(level) == name).alias(f"{name.lower()}_queries") for name in ("SIMPLE", "MEDIUM", "COMPLEX")]
    return df.groupBy(engine).agg(F.count("*").alias("total_queries_processed"), F.count_if(migrated).alias("successful_migrations"), F.count_if(validated).alias("validated_queries"), *levels, F.round(F.avg(score), 4).alias("average_score"))


def latency_verdict(source: str = "source_latency_ms", target: str = "target_latency_ms") -> Column:
    """faster, slower or same for the target; null if either wasn't measured."""
    s, t = F.coalesce(F.col(source), F.lit(0)), F.coalesce(F.col(target), F.lit(0))
    return F.when((s > 0) & (t > 0), F.when(t < s, F.lit("faster")).when(t > s, F.lit("slower")).otherwise(F.lit("same")))
