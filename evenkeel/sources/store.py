"""A keyed table on shared storage that upserts without a rewrite of what they don't touch.

Rows lie in folders bucket=0, bucket=1, ... by the hash of their key. A merge reads only the buckets that new rows fall into, writes
them anew beside the table, and then puts each finished folder in its old one's place. The files of other buckets stay as they
are. A run that is killed before its buckets are finished leaves the old state; one that is killed while folders change places
is carried on by the next one that opens the table, as the finished folders are still there. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.operators import history
from evenkeel.sources import files

_STAGED = "_staged-"


class KeyedStore:
    """key: one column. buckets: so many that a bucket is some hundred megabytes; it stays what it was when the table began."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.recover()

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int").alias("bucket")

    def recover(self) -> None:
        """Carry on what was finished, delete what wasn't."""
        for name in files.names(self.spark, self.path):
            if name.startswith(_STAGED):
                staged = f"{self.path}/{name}"
                if files.exists(self.spark, f"{staged}/_SUCCESS"):
                    self._swap(staged)
                else:
                    files.delete(self.spark, staged)

    def _swap(self, staged: str) -> None:
        for name in files.names(self.spark, staged):
            if name.startswith("bucket="):
                files.move(self.spark, f"{staged}/{name}", f"{self.path}/{name}")
        files.delete(self.spark, staged)

    def read(self) -> DataFrame:
        if not any(n.startswith("bucket=") for n in files.names(self.spark, self.path)):
            return self.spark.createDataFrame([], self.schema)
        whole = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(whole).parquet(self.path).select(*(F.col(f"`{c}`") for c in self.schema.names))

    def get(self, key) -> DataFrame:
        """The row of a key: one bucket is read."""
        wanted = self.spark.range(1).select(F.lit(key).cast(self.schema[self.key].dataType).alias(self.key))
        bucket = wanted.select(self._bucket()).first().bucket
        return self._of([bucket]).where(F.col(f"`{self.key}`").eqNullSafe(F.lit(key)))

    def _of(self, buckets: Sequence[int]) -> DataFrame:
        there = set(files.names(self.spark, self.path))
        paths = [f"{self.path}/bucket={b}" for b in buckets if f"bucket={b}" in there]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, new: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Put how(old, new) in place of the rows of the buckets that new falls into; their numbers.

        how gets whole buckets and returns one row for each key, e.g. history.upsert. new is read twice, so it should be a table or cheap.
        """
        new = new.select(*(F.col(f"`{c}`").cast(self.schema[c].dataType).alias(c) for c in self.schema.names))
        # at most as many rows as there are buckets
        touched = sorted(r.bucket for r in new.select(self._bucket()).distinct().collect())
        if not touched:
            return []
        merged = how(self._of(touched), new).select(*self.schema.names)
        staged = f"{self.path}/{_STAGED}{uuid.uuid4().hex}"
        # a bucket's rows end up in few files, and no bucket in one task alone: keys are dealt within it
        dealt = merged.withColumn("bucket", self._bucket()).repartition("bucket", F.pmod(F.xxhash64(F.col(self.key), F.lit(1)), F.lit(4)))
        for b in touched:
            files.make(self.spark, f"{staged}/bucket={b}")  # a bucket may come out empty
        dealt.write.mode("append").partitionBy("bucket").parquet(staged)
        self._swap(staged)
        return touched

    def upsert(self, new: DataFrame, order: str = "validation_ts", keep_if_null: Sequence[str] = ("run_by",)) -> list[int]:
        """The latest row of each key, as history.upsert says."""
        return self.merge(new, lambda old, rows: history.upsert(old, rows, self.key, order, keep_if_null))


# ---------------------------------------------------------------- a cache of texts


CACHE = "text_key string, text string, result string, created_at timestamp_ntz, expires_at timestamp_ntz, last_access timestamp_ntz, accesses long"


def text_key(text: Column, *context: Column) -> Column:
    """What a cached text is found by: the SHA-256 of the text without differences of white space at its ends and between words, and of its context."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.sha2(F.to_json(F.array(plain, *(F.coalesce(c.cast("string"), F.lit("")) for c in context))), 256)


def _cached(old: DataFrame, new: DataFrame) -> DataFrame:
    """The latest text, result and dates; accesses add up."""
    rows = old.unionByName(new)
    at = F.struct("created_at", "result", "text", "expires_at")
    put = F.when(F.col("result").isNotNull(), at)
    last = [F.max_by(F.col(c), put).alias(c) for c in ("text", "result", "created_at", "expires_at")]
    return rows.groupBy("text_key").agg(*last, F.max("last_access").alias("last_access"), F.sum("accesses").alias("accesses"))


class TextCache:
    """Results of texts with an expiry and counts of their use; both are merged as increments, so runs can put and count at any time."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.store = KeyedStore(spark, path, CACHE, "text_key", buckets)

    def put(self, entries: DataFrame, at: Column, days: int = 30) -> None:
        """entries: text_key, text, result."""
        self.store.merge(entries.select("text_key", "text", "result", at.alias("created_at"), (at + F.make_dt_interval(F.lit(days))).alias("expires_at"), F.lit(None).alias("last_access"), F.lit(0).alias("accesses")), _cached)

    def lookup(self, wanted: DataFrame, at: Column, count: bool = True) -> DataFrame:
        """wanted (text_key) with result, null where there is none or it has expired. count: add the hits to the entries' accesses."""
        fresh = self.store.read().where(F.col("expires_at") > at).select("text_key", "result")
        if count:
            hits = wanted.join(fresh, "text_key").groupBy("text_key").agg(F.count("*").alias("accesses"))
            self.store.merge(hits.select("text_key", F.lit(None).alias("text"), F.lit(None).alias("result"), F.lit(None).alias("created_at"), F.lit(None).alias("expires_at"), at.alias("last_access"), "accesses"), _cached)
            fresh = self.store.read().where(F.col("expires_at") > at).select("text_key", "result")
        return wanted.join(fresh, "text_key", "left")

    def expire(self, at: Column) -> None:
        """Delete what has expired: buckets that hold some are written anew."""
        gone = self.store.read().where(F.col("expires_at") <= at)
        self.store.merge(gone, lambda old, rows: old.join(rows.select("text_key"), "text_key", "left_anti"))

    def stats(self, at: Column) -> DataFrame:
        """entries, accesses, expired, average_accesses."""
        return self.store.read().agg(F.count("*").alias("entries"), F.coalesce(F.sum("accesses"), F.lit(0)).alias("accesses"), F.count_if(F.col("expires_at") <= at).alias("expired"), F.round(F.avg("accesses"), 4).alias("average_accesses"))
