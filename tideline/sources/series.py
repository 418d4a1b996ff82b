"""Bringing any table into the common shape ``(series_id, ts, row_key, value columns…)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

SERIES, TS, KEY = "series_id", "ts", "row_key"

# Column names recognised, in order of preference.
DATE_NAMES = ("date", "Date", "datetime", "Datetime", "timestamp", "Timestamp", "ds")
VALUE_NAMES = ("value", "Value", "close", "Close", "y")
ANALYSIS_NAMES = ("value", "Close", "close")
TRUTH = "is_anomaly"

# Fixed value: what a ticker may look like once trimmed and upper-cased.
TICKER_PATTERN = r"^[A-Z0-9.\-^=]{1,20}$"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def detect_date_column(df: DataFrame) -> str:
    return next((c for c in DATE_NAMES if c in df.columns), df.columns[0])


def detect_value_column(df: DataFrame) -> str:
    found = next((c for c in VALUE_NAMES if c in df.columns), None)
    if found:
        return found
    numeric = numeric_columns(df)
    if not numeric:
        raise ValueError("no numeric column found")
    return numeric[0]


def detect_analysis_column(df: DataFrame) -> str:
    """The column to analyse in a standardised table, never the ground truth if avoidable."""
    found = next((c for c in ANALYSIS_NAMES if c in df.columns), None)
    if found:
        return found
    numeric = [c for c in numeric_columns(df) if c not in (KEY, SERIES)]
    if not numeric:
        raise ValueError("no numeric column found")
    return next((c for c in numeric if c != TRUTH), numeric[0])


def value_columns(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """Every numeric column that is no key."""
    found = [c for c in numeric_columns(df) if c not in (*keys, SERIES, TS, KEY)]
    if not found:
        raise ValueError("there is no column of numbers")
    return found


def _timestamp(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.col(name)
    return F.col(name).cast("timestamp_ntz")


def _number(df: DataFrame, name: str) -> Column:
    """Cast to double; under ANSI mode text that is no number raises. NaN becomes NULL."""
    c = F.col(name).cast("double")
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def standardise(
    df: DataFrame,
    date_col: str,
    value_col: str | None = None,
    series: str | Column | None = None,
    key: str | Column | None = None,
) -> DataFrame:
    """Promote ``date_col`` to ``ts`` and keep ``value_col``, or every numeric column.

    ``series`` names the column (or gives the expression) telling series apart; without one the
    table is a single series. ``key`` breaks ties between equal timestamps and should be unique
    within a series; without one a hash of the row is used.
    """
    missing = [c for c in (date_col, value_col) if c is not None and c not in df.columns]
    if missing:
        raise ValueError(f"the table lacks {missing}")
    reserved = {date_col, *(c for c in (series, key) if isinstance(c, str))}
    values = [value_col] if value_col else [c for c in numeric_columns(df) if c not in reserved]
    if not values:
        raise ValueError("there is no column of numbers")
    series_expr = F.lit("series") if series is None else (F.col(series) if isinstance(series, str) else series)
    key_expr = F.xxhash64(*df.columns) if key is None else (F.col(key) if isinstance(key, str) else key)
    return df.select(
        series_expr.cast("string").alias(SERIES),
        _timestamp(df, date_col).alias(TS),
        key_expr.alias(KEY),
        *[_number(df, c).alias(c) for c in values],
    )


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    date_col: str = "date",
    value_col: str = "value",
    extra: Mapping[str, str] | None = None,
    series: str | None = None,
    key: str | None = None,
) -> DataFrame:
    """Read CSV files strictly: a bad date or number raises, extra columns must be numeric.

    The columns are those of the header line; ``extra`` gives their types where double is not
    wanted. Without ``series`` every file is a series of its own.
    """
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in (date_col, value_col) if c not in header]
    if missing:
        raise ValueError(f"the CSV header lacks {missing}")
    types = dict(extra or {})

    def kind(c: str) -> str:
        if c == date_col:
            return "timestamp_ntz"
        if c in (series, key):
            return types.get(c, "string")
        return types.get(c, "double")

    schema = ", ".join(f"`{c}` {kind(c)}" for c in header)
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    extras = [c for c in header if c not in (date_col, value_col, series, key)]
    series_expr = F.col(series) if series else F.col("_metadata.file_path")
    key_expr = F.col(key) if key else F.xxhash64(*header)
    out = raw.select(
        series_expr.cast("string").alias(SERIES),
        F.col(date_col).alias(TS),
        key_expr.alias(KEY),
        _number(raw, value_col).alias(value_col),
        *[_number(raw, c).cast(types.get(c, "double")).alias(c) for c in extras],
    )
    return require_rows(out)


def require_rows(df: DataFrame, message: str = "no rows are left") -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def select_ohlcv(
    df: DataFrame,
    tickers: Sequence[str] | None,
    start,
    end,
    column: str = "Close",
    ticker_col: str = "ticker",
    date_col: str = "date",
) -> DataFrame:
    """One price column of some tickers (all if None) with ``start <= date < end``."""
    if start >= end:
        raise ValueError("the period is empty: start does not come before end")
    if column not in df.columns:
        raise ValueError(f"the table has {df.columns}, not {column!r}")
    picked = df.where((F.col(date_col) >= F.lit(start)) & (F.col(date_col) < F.lit(end)))
    if tickers is not None:
        picked = picked.where(F.col(ticker_col).isin(list(tickers)))
    return require_rows(standardise(picked, date_col, column, series=ticker_col, key=F.xxhash64(ticker_col, date_col)))


def normalise_ticker(c: Column | str) -> Column:
    """Trimmed and upper-cased ticker; NULL where it cannot be one."""
    t = F.upper(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(t.rlike(TICKER_PATTERN), t)


def validate(df: DataFrame, required: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Rows in all and rows breaking each rule, in one pass: ``(rule, rows)``.

    Missing columns raise at once; what only the data can tell is counted.
    """
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"the table lacks the required {missing}")
    rules = {"rows": F.count(F.lit(1))}
    for c in required:
        rules[f"{c} missing"] = F.count_if(F.col(c).isNull())
    for c in numeric:
        text = F.col(c).cast("string")
        rules[f"{c} not numeric"] = F.count_if(text.isNotNull() & F.expr(f"try_cast(cast(`{c}` as string) as double)").isNull())
    totals = df.agg(*[v.alias(k) for k, v in rules.items()])
    return totals.unpivot([], list(rules), "rule", "rows")
