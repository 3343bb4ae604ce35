"""Recursive queries of any depth and size: each round's new rows are a written table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recursive(seed: DataFrame, step: Callable[[DataFrame], DataFrame], folder: str, new_by: Sequence[str] | None = None) -> DataFrame:
    """seed, and what step makes of each round's rows, until a round is empty: WITH RECURSIVE ... UNION ALL without a limit of rows or rounds.

    folder: a shared folder, in which round=0, round=1, ... stay as long as the result is read; a lost executor costs a read of the last
    round. new_by: columns by which rows must be new, as with UNION (DISTINCT), so that cycles end; rows that repeat within a
    round are then one.
    """
    spark = seed.sparkSession
    schema = seed.schema
    names = seed.columns

    def put(rows: DataFrame, n: int) -> DataFrame:
        rows.select(*(F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(rows.columns, schema))).write.parquet(f"{folder}/round={n}")
        return spark.read.schema(schema).parquet(f"{folder}/round={n}")

    def so_far(n: int) -> DataFrame:
        return spark.read.schema(schema).parquet(*(f"{folder}/round={i}" for i in range(n)))

    frontier = put(seed if new_by is None else seed.dropDuplicates(list(new_by)), 0)
    n = 1
    while not frontier.isEmpty():
        rows = step(frontier)
        if new_by is not None:
            rows = rows.toDF(*names).dropDuplicates(list(new_by))
            known = so_far(n).select(*(F.col(f"`{c}`").alias(f"known{i}") for i, c in enumerate(new_by)))
            rows = rows.join(known, [F.col(f"`{c}`").eqNullSafe(F.col(f"known{i}")) for i, c in enumerate(new_by)], "left_anti")
        frontier = put(rows, n)
        n += 1
    return so_far(n)
