"""One text form for values of any type, so that rows of two systems can be compared by a hash.

By default the forms are exact but for padding: two values have the same text only if they are equal, where spaces around a
text, a JSON text or its keys don't count. trim=False counts these too. `coarse` forms round numbers to eight
decimals and cut times to milliseconds, for systems that don't keep more.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL = "<NULL>"


def _short(text: Column) -> Column:
    """Text with a decimal point without the zeros behind it that say nothing."""
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))


def _coarse(c: Column) -> Column:
    return F.coalesce(_short(c.try_cast("decimal(38,8)").cast("string")), c.cast("string"))


def _double(c: Column) -> Column:
    """The shortest decimal that is this number; without an exponent from 1e-21 to 1e22, where a decimal holds every digit."""
    c = c + F.lit(0.0).cast("float")  # -0 becomes 0
    size = F.abs(c)
    wide = F.coalesce(_short(F.when(size >= 1e7, c.try_cast("decimal(38,16)").cast("string")).when(size >= 1e-21, c.try_cast("decimal(38,38)").cast("string"))), c.cast("string"))
    return F.when(((size < 1e7) & (size >= 1e-3)) | (size == 0), _short(c.cast("string"))).otherwise(wide)


class _Object(list):
    """The pairs of a JSON object; a key may be there twice."""


#: Numbers beyond so many places are written with an exponent.
_MOST_PLACES = 400


def _number(value: Decimal) -> str:
    """All digits of a number, without an exponent or idle zeros."""
    sign, digits, exponent = value.as_tuple()
    if not any(digits):
        return "0"
    if abs(value.adjusted()) > _MOST_PLACES:
        all_digits = "".join(map(str, digits)).lstrip("0")
        few = all_digits.rstrip("0")
        return f"{'-' if sign else ''}{few}E{exponent + len(all_digits) - len(few)}"
    text = format(value, "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def _quoted(text: str, trim: bool) -> str:
    """A JSON string; halves of surrogate pairs, which UTF-8 can't hold, stay escaped."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", json.dumps(text.strip() if trim else text, ensure_ascii=False))


def _ordered(value, trim: bool) -> str:
    """JSON with keys in order and list members in the order of their own text; numbers without an exponent or idle zeros. Repeated keys all stay."""
    if isinstance(value, _Object):
        pairs = sorted((k.strip().lower(), k, _ordered(v, trim)) for k, v in value)
        return "{" + ",".join(f"{_quoted(k, trim)}:{v}" for _, k, v in pairs) + "}"
    if isinstance(value, list):
        return "[" + ",".join(sorted((_ordered(v, trim) for v in value), key=lambda t: (t.lower(), t))) + "]"
    if isinstance(value, Decimal):
        return _number(value)
    return _quoted(value, trim) if isinstance(value, str) else json.dumps(value)


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def _json_text(text: str | None, trim: bool) -> str | None:
    try:
        return _ordered(json.loads(text, parse_float=Decimal, parse_int=Decimal, parse_constant=_no_constant, object_pairs_hook=_Object), trim) if text is not None else None
    except (ValueError, RecursionError, ArithmeticError):
        return None


@F.pandas_udf(T.StringType())
def _json_trimmed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _json_text(t, True))


@F.pandas_udf(T.StringType())
def _json_exact(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _json_text(t, False))


def json_in_order(c: Column, trim: bool = True) -> Column:
    """A JSON object or array with keys and list members in order at every depth; null if the text is none.

    trim: spaces around keys and texts don't count. The one place outside llm where Python runs: only for columns whose JSON is to be put in order, in Arrow batches.
    """
    return (_json_trimmed if trim else _json_exact)(F.when(c.rlike(r"^\s*[{\[]"), c))


def _uneven(kind: T.DataType) -> bool:
    """Whether equal values of the type can differ in form: -0 and 0, and the order of a map."""
    if isinstance(kind, T.StructType):
        return any(_uneven(f.dataType) for f in kind)
    return isinstance(kind, (T.FloatType, T.DoubleType, T.MapType)) or isinstance(kind, T.ArrayType) and _uneven(kind.elementType)


def _even(c: Column, kind: T.DataType) -> Column:
    """The value with 0 for -0 and the entries of maps by key, at every depth."""
    if not _uneven(kind):
        return c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _even(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_even(c.getField(f.name), f.dataType).alias(f.name) for f in kind)))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(_even(e["key"], kind.keyType).alias("key"), _even(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    return F.when(c == 0, F.lit(0).cast(kind)).otherwise(c)


def _nested(c: Column, kind: T.DataType) -> Column:
    """Structs, arrays and maps as JSON; entries of maps by key, times with every digit."""
    return F.to_json(_even(c, kind), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})


def encode(name: str, kind: T.DataType, dates_only: bool = False, sort_json: bool = False, escape: bool = True, coarse: bool = False, fold: bool = False, trim: bool = True) -> Column:
    """The text form of a column. Null is <NULL>.

    Text: a backslash or pipe is escaped, and so is the text <NULL> itself, so that joined values stay apart. fold: case doesn't count. trim: spaces around it don't count.
    """
    c = F.col(f"`{name}`")
    if isinstance(kind, T.BinaryType):
        out = F.upper(F.hex(c))
    elif isinstance(kind, T.BooleanType):
        out = F.lower(c.cast("string"))
    elif isinstance(kind, T.DateType):
        out = F.date_format(c, "yyyy-MM-dd")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out = F.to_date(c).cast("string") if dates_only else F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS") if coarse else c.cast("string")
    elif isinstance(kind, T.IntegralType):
        out = c.cast("string")
    elif isinstance(kind, T.NumericType) and coarse:
        out = _coarse(c)
    elif isinstance(kind, T.DecimalType):
        out = _short(c.cast("string")) if kind.scale > 0 else c.cast("string")
    elif isinstance(kind, T.NumericType):
        out = _double(c)
    else:
        nested = isinstance(kind, (T.MapType, T.StructType, T.ArrayType, T.VariantType))
        out = F.to_json(c) if isinstance(kind, T.VariantType) else _nested(c, kind) if nested else F.trim(c.cast("string")) if trim else c.cast("string")
        if sort_json or isinstance(kind, T.VariantType):  # equal variants can differ in the form of their numbers
            out = F.coalesce(json_in_order(out, trim), out)
        out = F.lower(out) if fold else out
        if escape:
            out = F.replace(F.replace(out, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
            out = out if nested else F.when(out == NULL, F.lit("\\" + NULL)).otherwise(out)
    return F.coalesce(out, F.lit(NULL))


def hash_value(c: Column) -> Column:
    """A stored hash as it is compared: without padding and case."""
    return F.lower(F.trim(c))


def signature(df: DataFrame, columns: Sequence[str] | None = None, **options) -> Column:
    """The columns' text forms joined by pipes, in the order of their lower-cased names."""
    kinds = {f.name: f.dataType for f in df.schema}
    names = sorted(columns if columns is not None else kinds, key=str.lower)
    return F.concat_ws("|", *(encode(n, kinds[n], **options) for n in names))


def row_hash(df: DataFrame, columns: Sequence[str] | None = None, **options) -> Column:
    return F.upper(F.md5(signature(df, columns, **options)))


def hash_agg(df: DataFrame, columns: Sequence[str] | None = None, **options) -> Column:
    """HASH_AGG: an aggregate of any columns that doesn't depend on the order of rows and sees nulls, repeats and every changed value.

    The MD5 of the count and of two sums, of 60-bit lanes of the rows' hashes; tasks send their sums alone. Halves of
    lanes are summed apart, which can't overflow.
    """
    own = row_hash(df, columns, **options)
    sums = []
    for i in range(2):
        lane = F.conv(F.substring(own, 15 * i + 1, 15), 16, 10).cast("long")
        high, low = F.sum(F.shiftright(lane, 30)), F.sum(lane.bitwiseAND(F.lit((1 << 30) - 1)))
        sums.append((high.cast("decimal(20,0)") * (1 << 30) + low).cast("decimal(38,0)").cast("string"))
    return F.upper(F.md5(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums)))


def iso_date(c: Column) -> Column:
    """dd-MM-yyyy flipped to yyyy-MM-dd where it is a date; other text as it is."""
    found = F.try_to_timestamp(F.when(c.rlike(r"^\d{2}-\d{2}-\d{4}$"), c), F.lit("dd-MM-yyyy"))
    return F.coalesce(F.date_format(found, "yyyy-MM-dd"), c)


def plain_scalar(c: Column) -> Column:
    """A text value without differences of form: trimmed, ISO dates, JSON keys in order, comma lists of two or more in order."""
    text = F.trim(c)
    items = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    ordered = F.array_sort(items, lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    listed = F.when(text.contains(",") & ~text.startswith("{") & ~text.startswith("[") & (F.size(items) >= 2), F.array_join(ordered, ","))
    return F.coalesce(json_in_order(text), listed, iso_date(text))
