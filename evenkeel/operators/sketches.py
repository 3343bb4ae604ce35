"""Summaries of fixed size that are stored and merged: heavy hitters by weight, distinct counts, quantiles."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COUNTERS = 4096


def top_sums(df: DataFrame, group: str, item: str, weight: str, counters: int = COUNTERS) -> DataFrame:
    """A summary of each task's rows: group, item (as text), weight, lost.

    A task adds up weights (not negative) by item and keeps the `counters` heaviest of each group whenever it holds many times more.
    lost: what any item of the group may have had before it was dropped, at most; no more than the task's weight of the
    group over counters for each time something was dropped. Summaries of tasks, days or sources are put together by union.
    """
    rows = df.select(F.col(group).cast("string").alias("g"), F.col(item).cast("string").alias("item"), F.col(weight).cast("double").alias("w")).where("w > 0")

    def run(batches):
        held, lost = None, {}

        def added(tables):
            return pa.concat_tables(tables).group_by(["g", "item"]).aggregate([("w", "sum")]).rename_columns(["g", "item", "w"]).select(["g", "item", "w"])

        def least(table):
            frame = table.to_pandas().sort_values(["w", "item"], ascending=[False, True], kind="stable")
            place = frame.groupby("g", dropna=False).cumcount()
            for g, w in frame[place >= counters].groupby("g", dropna=False)["w"].max().items():
                key = None if g != g else g
                lost[key] = lost.get(key, 0.0) + float(w)
            return pa.Table.from_pandas(frame[place < counters], schema=table.schema, preserve_index=False)

        kinds = pa.schema([("g", pa.string()), ("item", pa.string()), ("w", pa.float64())])
        for batch in batches:
            own = pa.Table.from_batches([batch]).cast(kinds)
            held = added([own] if held is None else [held, own])
            if held.num_rows > 16 * counters:
                held = least(held)
        if held is not None and held.num_rows:
            out = least(held)
            yield from pa.table([*out.columns, pa.array([lost.get(g, 0.0) for g in out.column("g").to_pylist()])], names=["g", "item", "weight", "lost"]).to_batches(1 << 14)

    found = rows.mapInArrow(run, "g string, item string, weight double, lost double")
    part = F.concat(F.lit(f"{uuid.uuid4().hex}-"), F.spark_partition_id().cast("string"))
    return found.select(F.col("g").alias("group"), "item", "weight", "lost", part.alias("part"))


def top_of_sums(summaries: DataFrame, k: int) -> DataFrame:
    """APPROX_TOP_SUM: for each group its k heaviest items, with weight (never too high) and most (never too low)."""
    lost = summaries.select("group", "part", "lost").distinct().groupBy("group").agg(F.sum("lost").alias("lost")).withColumnRenamed("group", "of")
    weights = summaries.groupBy("group", "item").agg(F.sum("weight").alias("weight"))
    # tasks send k rows of a group at most
    place = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("weight"), "item"))
    best = weights.withColumn("place", place).where(F.col("place") <= k)
    return best.join(lost, F.col("group").eqNullSafe(F.col("of"))).select("group", "place", "item", "weight", (F.col("weight") + F.col("lost")).alias("most"))


def kept_sketches(df: DataFrame, keys: Sequence[str], distinct: str, value: str, log_size: int = 14, k: int = 2048) -> DataFrame:
    """A row for each combination of keys (a day, say) with rows, a sketch of the distinct values of one column and one of another's quantiles.

    Distinct counts are within about 1.04 / sqrt(2^log_size) and exact while they are few, ranks of quantiles within about 2.3 / k and exact below k values.
    """
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.hll_sketch_agg(distinct, log_size).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("value_sketch"))


def of_sketches(sketches: DataFrame, keys: Sequence[str], quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Kept sketches put together by fewer keys (a month, a range of days): rows, distinct_values, quantiles."""
    merged = sketches.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.hll_union_agg("distinct_sketch").alias("d"), F.kll_merge_agg_double("value_sketch").alias("v"))
    return merged.select(*keys, "rows", F.hll_sketch_estimate("d").alias("distinct_values"), F.kll_sketch_get_quantile_double("v", F.array(*map(F.lit, quantiles))).alias("quantiles"))
