"""Semi-structured values as Spark's variant type: paths with casts, their schemas, and flattening at any depth."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.warehouse import col
from evenkeel.operators.recursion import recursive

_PLAIN = r"^[A-Za-z_][A-Za-z0-9_]*$"


def json_path(path: str) -> str:
    """$.a.b[0] from a:b[0], a.b[0] or $.a.b[0]."""
    bare = re.sub(r"^\$\.?", "", path.strip()).replace(":", ".").strip(".")
    return "$" + ("" if bare.startswith("[") or not bare else ".") + bare


def parse(c) -> Column:
    """PARSE_JSON; null where the text is no JSON."""
    return F.try_parse_json(col(c))


def get(c, path: str, kind: str = "variant") -> Column:
    """GET_PATH, and c:path::kind: null where nothing is there or it can't be cast."""
    return F.try_variant_get(col(c), json_path(path), kind)


def type_of(c) -> Column:
    """TYPEOF: OBJECT, ARRAY, VARCHAR, INTEGER, DECIMAL, DOUBLE, BOOLEAN, NULL_VALUE or another type's name."""
    found = F.schema_of_variant(col(c))
    return F.when(found.startswith("OBJECT"), "OBJECT").when(found.startswith("ARRAY"), "ARRAY").when(found == "STRING", "VARCHAR").when(found == "BIGINT", "INTEGER").when(found.startswith("DECIMAL"), "DECIMAL").when(found == "VOID", "NULL_VALUE").otherwise(found)


def schema_of(df: DataFrame, c: str, *keys: str) -> DataFrame:
    """The schema that all values of a group have in common."""
    return df.groupBy(*keys).agg(F.schema_of_variant_agg(F.col(c)).alias("schema"))


def _step(rows: DataFrame, keep: Sequence[str], outer: bool = False) -> DataFrame:
    """One level below value: key, path, index, value, this."""
    names = ", ".join(f"t.`{c}`" for c in keep)
    found = rows.sparkSession.sql(f"SELECT {names + ', ' if names else ''}t.path AS base, t.value AS this, e.pos, e.key, e.value FROM {{t}} t, LATERAL variant_explode{'_outer' if outer else ''}(t.value) e", t=rows)
    named = F.when(F.col("key").rlike(_PLAIN), F.concat(F.when(F.col("base") != "", F.lit(".")).otherwise(""), "key")).otherwise(F.concat(F.lit("['"), F.replace("key", F.lit("'"), F.lit("\\'")), F.lit("']")))
    path = F.when(F.col("pos").isNull(), F.lit(None)).when(F.col("key").isNotNull(), F.concat("base", named)).otherwise(F.concat("base", F.lit("["), F.col("pos").cast("string"), F.lit("]")))
    index = F.when(F.col("key").isNull(), F.col("pos")).cast("long")
    return found.select(*(F.col(f"`{c}`") for c in keep), "key", path.alias("path"), index.alias("index"), "value", "this")


def flatten(df: DataFrame, value: str, keep: Sequence[str] = (), path: str = "", outer: bool = False, folder: str | None = None, mode: str = "BOTH") -> DataFrame:
    """FLATTEN: the columns in keep, and key, path, index, value and this (what the element was taken from).

    value: a variant column. path: flatten what is there in it. outer: a row with nulls where nothing comes out. folder: RECURSIVE, every
    element at any depth, a written round below this shared folder for each level. mode: OBJECT or ARRAY takes members of these alone.
    """
    base = json_path(path)[1:].lstrip(".")
    top = df.select(*(F.col(f"`{c}`") for c in keep), F.lit(base).alias("path"), get(value, path).alias("value") if base else F.col(value).alias("value"))
    wanted = F.lit(True) if mode == "BOTH" else F.col("path").isNull() | (F.col("key").isNotNull() if mode == "OBJECT" else F.col("index").isNotNull())
    first = _step(top, keep, outer).where(wanted)
    if folder is None:
        return first
    container = F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)")
    return recursive(first, lambda rows: _step(rows.where(container).select(*keep, "path", "value"), keep).where(wanted), folder)
