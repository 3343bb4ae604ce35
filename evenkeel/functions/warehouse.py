"""Functions of other warehouses as Spark columns, with those warehouses' meaning (null where they give null)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- safe arithmetic


def safe_divide(a, b) -> Column:
    return F.try_divide(col(a), col(b))


def div0(a, b) -> Column:
    """0 where the divisor is 0."""
    return F.when(col(b) == 0, F.lit(0.0)).otherwise(F.try_divide(col(a), col(b)))


def div0null(a, b) -> Column:
    """0 where the divisor is 0 or null."""
    return F.when(F.coalesce(col(b), F.lit(0)) == 0, F.lit(0.0)).otherwise(F.try_divide(col(a), col(b)))


def zero_if_null(c) -> Column:
    return F.coalesce(col(c), F.lit(0))


def null_if_zero(c) -> Column:
    return F.nullif(col(c), F.lit(0))


def square(c) -> Column:
    return col(c) * col(c)


def trunc_to(c, digits: int) -> Column:
    """Cut towards zero after so many decimals."""
    scale = F.lit(10.0**digits)
    scaled = col(c) * scale
    return F.when(scaled >= 0, F.floor(scaled)).otherwise(F.ceil(scaled)) / scale


def haversine(lat1, lon1, lat2, lon2, radius_km: float = 6371.0) -> Column:
    a = F.pow(F.sin(F.radians(col(lat2) - col(lat1)) / 2), 2) + F.cos(F.radians(col(lat1))) * F.cos(F.radians(col(lat2))) * F.pow(F.sin(F.radians(col(lon2) - col(lon1)) / 2), 2)
    return 2 * radius_km * F.asin(F.sqrt(a))


# ---- conditions


def decode(c, *pairs, default=None) -> Column:
    """Compare by `is not distinct from`: null meets null."""
    out = F.lit(default)
    for value, result in reversed(list(zip(pairs[::2], pairs[1::2]))):
        out = F.when(col(c).eqNullSafe(F.lit(value)), F.lit(result)).otherwise(out)
    return out


def nvl2(c, there, missing) -> Column:
    return F.when(col(c).isNotNull(), there).otherwise(missing)


def equal_null(a, b) -> Column:
    return col(a).eqNullSafe(col(b))


def in_array(c, array) -> Column:
    """False, never null, where the array has no such value."""
    return F.coalesce(F.array_contains(col(array), col(c)), F.lit(False))


# ---- dates

_MONTHS = {"month": 1, "quarter": 3, "year": 12}


def date_diff(unit: str, later, earlier) -> Column:
    """Boundaries of the unit that are crossed (not whole units that passed); weeks begin on Sunday."""
    a, b = col(later), col(earlier)
    if unit in _MONTHS:
        index = lambda c: F.floor((F.year(c) * 12 + F.month(c) - 1) / _MONTHS[unit])
        return (index(a) - index(b)).cast("long")
    if unit == "day":
        return F.datediff(a, b).cast("long")
    if unit == "week":
        week = lambda c: F.floor((F.datediff(c, F.lit("1970-01-04").cast("date"))) / 7)
        return (week(a) - week(b)).cast("long")
    seconds = {"hour": 3600, "minute": 60, "second": 1}[unit]
    index = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / seconds)
    return (index(a) - index(b)).cast("long")


def week_start_sunday(c) -> Column:
    return F.date_sub(F.date_trunc("week", F.date_add(col(c).cast("date"), 1)).cast("date"), 1)


def last_day(c, part: str = "month") -> Column:
    """LAST_DAY(date, part); a week ends on Saturday, an isoweek on Sunday."""
    d = col(c).cast("date")
    if part == "week":
        return F.date_add(week_start_sunday(d), 6)
    if part == "isoweek":
        return F.date_add(F.date_trunc("week", d).cast("date"), 6)
    return F.date_sub(F.add_months(F.date_trunc(part, d).cast("date"), _MONTHS[part]), 1)


def extract(part: str, c) -> Column:
    """EXTRACT with the parts of other warehouses: as long, and as double for epoch."""
    t = col(c)
    micros = F.extract(F.lit("second"), t.cast("timestamp_ntz")) * 1_000_000
    parts = {
        "dayofweek": F.dayofweek(t), "day_of_week": F.weekday(t) + 1, "dow": F.weekday(t) + 1, "dayofyear": F.dayofyear(t), "day_of_year": F.dayofyear(t), "doy": F.dayofyear(t), "isoweek": F.weekofyear(t), "isoyear": F.extract(F.lit("YEAROFWEEK"), t), "year_of_week": F.extract(F.lit("YEAROFWEEK"), t), "yow": F.extract(F.lit("YEAROFWEEK"), t),
        "week": F.floor((F.dayofyear(t) - F.dayofweek(t) + 7) / 7), "millisecond": F.floor(micros / 1000) % 1000, "microsecond": micros % 1_000_000,
    }
    found = parts.get(part.lower())
    return (found if found is not None else F.extract(F.lit(part), t)).cast("long")


# ---- networks


def net_host(c) -> Column:
    """NET.HOST: the host of a url without user and port; null where there is none."""
    return F.nullif(F.regexp_extract(col(c), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]*)", 1), F.lit(""))


def net_public_suffix(c, suffixes: Sequence[str] = ()) -> Column:
    """NET.PUBLIC_SUFFIX: the last label of the host, or one of the given suffixes of several labels."""
    host = F.lower(net_host(c))
    found = F.element_at(F.split(host, r"\."), -1)
    for suffix in sorted(suffixes, key=len):
        found = F.when((host == suffix) | host.endswith("." + suffix), F.lit(suffix)).otherwise(found)
    return found


def net_reg_domain(c, suffixes: Sequence[str] = ()) -> Column:
    """NET.REG_DOMAIN: the public suffix and the label before it; null where there is none."""
    host, suffix = F.lower(net_host(c)), net_public_suffix(c, suffixes)
    before = F.substring(host, F.lit(1), F.length(host) - F.length(suffix) - 1)
    return F.when(F.length(before) > 0, F.concat(F.element_at(F.split(before, r"\."), -1), F.lit("."), suffix))


# Strftime tokens and their Java patterns.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%p": "a", "%I": "hh", "%%": "%"}


def java_pattern(strftime: str) -> str:
    """The Java pattern of a strftime format; an unknown token raises."""
    out, i = [], 0
    while i < len(strftime):
        if strftime[i] == "%":
            token = strftime[i : i + 2]
            if token not in STRFTIME:
                raise ValueError(f"format token {token!r} has no Java pattern")
            out.append(STRFTIME[token])
            i += 2
        else:
            out.append(f"'{strftime[i]}'" if strftime[i].isalpha() else strftime[i])
            i += 1
    return "".join(out)


def format_date(strftime: str, c) -> Column:
    return F.date_format(col(c), java_pattern(strftime))


def parse_date(strftime: str, c) -> Column:
    """Null where the text is no date of the format."""
    return F.try_to_timestamp(col(c), F.lit(java_pattern(strftime))).cast("date")


# ---- texts and arrays


def split_part(c, by: str, n: int) -> Column:
    return F.split_part(col(c), F.lit(by), F.lit(n))


def strpos(c, part: str) -> Column:
    return F.locate(part, col(c))


def array_slice(c, begin: int, end: int) -> Column:
    """From begin (0 is the first) up to but not including end."""
    return F.slice(col(c), begin + 1, end - begin)


def array_offset(c, n: int, safe: bool = True) -> Column:
    """The element at n, counted from 0; null (or an error) outside."""
    return F.get(col(c), F.lit(n)) if safe else F.element_at(col(c), n + 1)


def object_keys(c) -> Column:
    return F.array_sort(F.json_object_keys(col(c)))


def array_agg_ordered(value, order, limit: int | None = None, descending: bool = False) -> Column:
    """ARRAY_AGG(value IGNORE NULLS ORDER BY order LIMIT limit), by order and then value."""
    rows = F.sort_array(F.collect_list(F.when(col(value).isNotNull(), F.struct(col(order).alias("o"), col(value).alias("v")))), not descending)
    return F.transform(rows if limit is None else F.slice(rows, 1, limit), lambda r: r["v"])


def array_concat_agg(c) -> Column:
    """All arrays of a group end to end, in no order; null arrays count as empty."""
    return F.flatten(F.collect_list(col(c)))


def count_distinct_over(df: DataFrame, value: str, keys: Sequence[str], name: str) -> DataFrame:
    """df with COUNT(DISTINCT value) OVER (PARTITION BY keys), nulls not counted.

    As an aggregation and a join back, so that no task holds all rows or values of a frequent key. Null keys are a key.
    """
    counted = df.groupBy(*(F.col(k).alias(f"__key{i}") for i, k in enumerate(keys))).agg(F.countDistinct(value).alias(name))
    return df.join(counted, [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)]).select(*df.columns, name)


# ---- times and samples


def time_slice(c, n: int, unit: str) -> Column:
    """The begin of the slice of n units, counted from 1970-01-01 (weeks: from the Monday before), that a time lies in."""
    t = col(c)
    if unit in _MONTHS:
        step = n * _MONTHS[unit]
        index = F.floor(((F.year(t) - 1970) * 12 + F.month(t) - 1) / step) * step
        return F.add_months(F.lit("1970-01-01").cast("date"), index.cast("int")).cast("timestamp_ntz")
    seconds = n * {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[unit]
    shift = 3 * 86400 if unit == "week" else 0
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    since = F.timestamp_diff("SECOND", origin, F.date_trunc("second", t).cast("timestamp_ntz")) + shift
    begin = since - F.pmod(since, F.lit(seconds)) - shift
    # in days and seconds, as a number of seconds after 2038 is no integer of 32 bits
    days = F.floor(begin / 86400)
    return origin + F.make_dt_interval(days.cast("int"), F.lit(0), F.lit(0), (begin - days * 86400).cast("decimal(18,6)"))


def convert_timezone(source: str, target: str, c) -> Column:
    return F.convert_timezone(F.lit(source), F.lit(target), col(c))


def sampled(key, percent: float) -> Column:
    """Whether a row is in a sample that is the same each time: by the MD5 of its key."""
    return F.conv(F.substring(F.md5(col(key).cast("string")), 1, 8), 16, 10).cast("long") < F.lit(int(percent / 100 * (1 << 32)))
