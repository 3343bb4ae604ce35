"""Type names that compare across warehouses: canonical names, families, compatibility."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Spellings of each canonical type, lower case.
SPELLINGS = {
    "INT": ["int64", "int", "integer", "bigint", "long", "smallint", "tinyint", "byteint", "short", "byte"],
    "DOUBLE": ["float", "float4", "float8", "double", "double precision", "real", "float64"],
    "STRING": ["varchar", "char", "character", "string", "text", "time", "variant"],
    "BINARY": ["binary", "varbinary", "bytes"],
    "BOOLEAN": ["boolean", "bool"],
    "TIMESTAMP": ["timestamp", "timestamp_ltz", "timestamp_ntz", "timestamp_tz", "datetime", "timestamp with time zone", "timestamp without time zone"],
    "DATE": ["date"],
    "STRUCT": ["struct", "object"],
    "ARRAY": ["array"],
    "MAP": ["map"],
    "NULL": ["void", "null"],
}
FAMILIES = {
    "NUMERIC": ["INT", "DECIMAL", "DOUBLE"],
    "TIMESTAMP": ["TIMESTAMP"],
    "DATE": ["DATE"],
    "BOOLEAN": ["BOOLEAN"],
    "BINARY": ["BINARY"],
    "COMPLEX": ["STRUCT", "ARRAY", "MAP"],
}
_NAMES = {spelling: name for name, spellings in SPELLINGS.items() for spelling in spellings}
_FAMILY = {name: family for family, names in FAMILIES.items() for name in names}
_DECIMALS = ("number", "decimal", "dec", "numeric", "bignumeric")


def canonical(kind: T.DataType | str | None) -> str:
    """Canonical name of a Spark type or of any warehouse's spelling. Decimals of scale 0 are INT; null or blank is UNKNOWN."""
    text = kind.simpleString() if isinstance(kind, T.DataType) else (kind or "")
    text = " ".join(text.lower().split())
    if not text:
        return "UNKNOWN"
    base, _, inside = re.split(r"([<(])", text, maxsplit=1) if re.search(r"[<(]", text) else (text, "", "")
    base = base.strip()
    if base in _DECIMALS:
        sizes = re.findall(r"\d+", inside)
        return "INT" if len(sizes) == 2 and sizes[1] == "0" else "DECIMAL"
    if base == "timestamp" and text.endswith("time zone"):
        return "TIMESTAMP"
    return _NAMES.get(base, base.upper())


def family(kind: T.DataType | str | None) -> str:
    return _FAMILY.get(canonical(kind), "STRING")


def compatible(a: T.DataType | str | None, b: T.DataType | str | None) -> bool:
    """The same canonical name, or the same family."""
    return canonical(a) == canonical(b) or family(a) == family(b)


def common_name(a: T.DataType | str | None, b: T.DataType | str | None) -> str:
    """The name both are compared under: their family (NUMBER for numeric ones), else STRING."""
    if family(a) != family(b):
        return "STRING"
    return {"NUMERIC": "NUMBER"}.get(family(a), family(a))
