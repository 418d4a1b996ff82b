"""Calendar parts and number formatting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def day_of_week(ts: Column | str) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(ts).cast("tinyint")


def month(ts: Column | str) -> Column:
    return F.month(ts).cast("tinyint")


def four_decimals(c: Column | str) -> Column:
    """A metric as text with four decimals, ``N/A`` where it is undefined."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.when(c.isNotNull(), F.format_string("%.4f", c)), F.lit("N/A"))


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch; a timestamp without a zone is read in the session's zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))
