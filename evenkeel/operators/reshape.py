"""PIVOT and UNPIVOT."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_VALUES = 1000


def pivot(df: DataFrame, keys: Sequence[str], column: str, figures: dict[str, Column], values: Sequence | None = None, most: int = MOST_VALUES) -> DataFrame:
    """A row for each combination of keys and a column for each value of `column` (value_figure, or the value alone for one figure).

    values: those wanted, in this order. Without them a first pass finds them, in order, nulls (named null) last; more than `most` are an error,
    as a plan holds a column for each. A value that no row of a key has gives null. One aggregation, no join.
    """
    if values is None:
        found = df.select(column).distinct().orderBy(F.asc_nulls_last(column)).limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"{column} has more than {most} values")
        values = [r[0] for r in found]
    by_value = df.groupBy(*keys, F.col(column).alias("__value")).agg(*(c.alias(f"__{n}") for n, c in figures.items()))
    out = []
    for v in values:
        name = "null" if v is None else str(v)
        for n in figures:
            out.append(F.first(F.when(F.col("__value").eqNullSafe(F.lit(v)), F.col(f"__{n}")), ignorenulls=True).alias(name if len(figures) == 1 else f"{name}_{n}"))
    return by_value.groupBy(*keys).agg(*out)


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value", nulls: bool = False) -> DataFrame:
    """A row for each of the columns with its name and value, of a type that all have in common; nulls: keep rows with null values."""
    out = df.select(*(F.col(f"`{k}`") for k in keys), F.explode(F.array(*(F.struct(F.lit(c).alias(name), F.col(f"`{c}`").alias(value)) for c in columns))).alias("x")).select(*(F.col(f"`{k}`") for k in keys), "x.*")
    return out if nulls else out.where(F.col(value).isNotNull())
