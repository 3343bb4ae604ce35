"""Counts that grow with a stream: rows and nulls of each event-time window, for continuous reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.sources.files import working_folder
from evenkeel.sources.store import KeyedStore


def stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """A stream of a Parquet table; files that arrive later are read when they arrive."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # as a pattern a table of one file is found too
    return spark.readStream.schema(schema).options(**options).parquet(pattern)


def windowed_counts(events: DataFrame, time_col: str = "ts", value_col: str = "value", window: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """window_start, rows, nulls, sums of each window. Rows that come more than `lateness` behind the latest time seen are dropped if their window is over."""
    when = F.col(time_col).cast("timestamp")
    marked = events.withColumn("__at", when).withWatermark("__at", lateness)
    return marked.groupBy(F.window("__at", window)).agg(F.count("*").alias("rows"), F.count_if(F.col(value_col).isNull()).alias("nulls"), F.round(F.sum(value_col), 2).alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "rows", "nulls", "total")


def _latest(old: DataFrame, new: DataFrame) -> DataFrame:
    """A window's counts only grow, so the row with most rows is the latest."""
    both = old.unionByName(new)
    rest = [c for c in new.columns if c != "window_start"]
    last = F.max(F.struct("rows", *(c for c in rest if c != "rows"))).alias("last")
    return both.groupBy("window_start").agg(last).select("window_start", *(F.col(f"last.{c}").alias(c) for c in rest))


def run(counts: DataFrame, folder: str, buckets: int = 8) -> DataFrame:
    """Run what is there now, and return the counts of all windows so far: a keyed table below the folder.

    Update mode: a batch brings only the windows that changed, and windows behind the watermark leave the stream's state, so it doesn't grow
    for ever. A batch that runs again after a failure puts the same rows again. The state of a stream that goes on is in the folder too.
    """
    store = KeyedStore(counts.sparkSession, f"{folder}/counts", counts.schema, "window_start", buckets)

    def put(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            store.merge(batch, _latest)
        finally:
            batch.unpersist()

    counts.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return store.read()


def checkpoint_folder(spark: SparkSession, name: str) -> str:
    """In the shared folder of spark.checkpoint.dir; a temporary one where that is unset on a local master."""
    return working_folder(spark, name)
