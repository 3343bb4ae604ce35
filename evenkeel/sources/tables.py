"""Where tables come from and go to: catalog listings, tables made anew, JDBC sources, and results of queries kept for the length of a comparison."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.sources import files


def _quoted(*parts: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


def catalogs(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW CATALOGS").select("catalog")


def schemas(spark: SparkSession, catalog: str) -> DataFrame:
    """catalog, schema."""
    return spark.sql(f"SHOW SCHEMAS IN {_quoted(catalog)}").select(F.lit(catalog).alias("catalog"), F.col("namespace").alias("schema"))


def tables(spark: SparkSession, catalog: str, schema: str) -> DataFrame:
    """catalog, schema, table; temporary views are left out."""
    return spark.sql(f"SHOW TABLES IN {_quoted(catalog, schema)}").where("NOT isTemporary").select(F.lit(catalog).alias("catalog"), F.lit(schema).alias("schema"), F.col("tableName").alias("table"))


def jdbc(spark: SparkSession, url: str, relation: str, split_on: str | None = None, bounds: tuple | None = None, parts: int = 16, **options) -> DataFrame:
    """A table, or a query in parentheses, of a database. Filters, columns, aggregates and limits on it go to the database.

    split_on: an ordered column whose range `bounds` is read in `parts` at once; values outside the bounds are in the first and last part.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=relation, pushDownAggregate=True, pushDownLimit=True, **options)
    if split_on is not None:
        low, high = bounds if bounds is not None else jdbc(spark, url, relation, **options).agg(F.min(split_on), F.max(split_on)).first()
        if low is not None:
            reader = reader.options(partitionColumn=split_on, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def materialise(df: DataFrame, name: str, provider: str = "parquet", location: str | None = None) -> DataFrame:
    """Create or replace the table catalog.schema.name (catalog and schema are the current ones where they are left out) by df; its rows.

    The schema is made where it is missing. Rows are written to a table beside it first, which then takes the name, so a write that
    fails leaves the old table, and nothing else, behind. Catalogs that replace tables by themselves do that instead.
    location: a folder below which the table's files lie; without it the catalog's own place.
    """
    spark = df.sparkSession
    parts = name.split(".")
    catalog = parts[-3] if len(parts) > 2 else spark.catalog.currentCatalog()
    schema = parts[-2] if len(parts) > 1 else spark.catalog.currentDatabase()
    place, table = _quoted(catalog, schema), parts[-1]
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {place}")
    if catalog != "spark_catalog":
        df.writeTo(f"{place}.{_quoted(table)}").using(provider).createOrReplace()
        return spark.table(f"{place}.{_quoted(table)}")
    mark = uuid.uuid4().hex[:10]
    staged = f"{place}.{_quoted(f'{table}__{mark}')}"
    writer = df.write.format(provider)
    if location is not None:
        writer = writer.option("path", f"{location.rstrip('/')}/{table}__{mark}")
    try:
        writer.saveAsTable(staged)
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {staged}")
        if location is not None:
            files.delete(spark, f"{location.rstrip('/')}/{table}__{mark}")
        raise
    spark.sql(f"DROP TABLE IF EXISTS {place}.{_quoted(table)}")
    spark.sql(f"ALTER TABLE {staged} RENAME TO {_quoted(schema, table)}")
    return spark.table(f"{place}.{_quoted(table)}")


@contextmanager
def materialised(folder: str, *frames: DataFrame) -> Iterator[list[DataFrame]]:
    """The frames written as Parquet below a shared folder and read back, deleted at the end: a slow or remote query runs once."""
    spark = frames[0].sparkSession
    path = f"{folder.rstrip('/')}/materialised-{uuid.uuid4().hex}"
    try:
        out = []
        for i, df in enumerate(frames):
            df.write.parquet(f"{path}/{i}")
            out.append(spark.read.schema(df.schema).parquet(f"{path}/{i}"))
        yield out
    finally:
        files.delete(spark, path)
