"""Text forms and row hashes of the test tables in DuckDB SQL."""

from __future__ import annotations


def number_sql(c: str) -> str:
    """Numbers of the test tables have no exponent in DuckDB's text."""
    return f"coalesce(rtrim(rtrim(CAST({c} AS VARCHAR), '0'), '.'), '<NULL>')"


def text_sql(c: str) -> str:
    return rf"coalesce(replace(replace(trim({c}), '\', '\\'), '|', '\|'), '<NULL>')"


def time_sql(c: str) -> str:
    return f"coalesce(rtrim(rtrim(strftime({c}, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.'), '<NULL>')"


def int_sql(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), '<NULL>')"


def hash_sql(forms: dict[str, str]) -> str:
    return "upper(md5(" + " || '|' || ".join(forms[c] for c in sorted(forms)) + "))"
