"""Hash numbers that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Digits of an MD5 that make a number below 2^52, exact as a double too.
_DIGITS = 13
SPAN = 1 << (4 * _DIGITS)


def number(*parts: Column) -> Column:
    """A whole number in [0, 2^52) from the MD5 of the parts joined by ``|``; null parts are skipped."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, _DIGITS), 16, 10).cast("long")


def number_sql(*parts: str) -> str:
    """The same in DuckDB."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, {_DIGITS}) AS BIGINT)"


def row_key(key: str, text: str) -> Column:
    """What a document is hashed by: its id or, without one, its text."""
    return F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))


def row_key_sql(key: str, text: str) -> str:
    return f"coalesce(CAST({key} AS VARCHAR), 'text:' || coalesce({text}, ''))"
