"""Reading rate tables and checking their rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratepanel.functions.dates import parse_mixed_date
from ratepanel.operators.clean import unique_rates

# Column names of rate files and of panels.
FILE_NAMES = {"date": "date", "currency_code": "key", "exchange_rate": "rate"}
NAME_COLUMN = "currency"
BAR_COLUMNS = ("open", "high", "low", "close", "volume")
FORMATS = ("csv", "parquet", "orc", "json")


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Raise at plan time when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def standard_columns(df: DataFrame, names: Mapping[str, str] = FILE_NAMES) -> DataFrame:
    """Panel column names and types from a file's columns.

    Text dates go through the mixed parser; what cannot be read becomes NULL.
    """
    require(df, list(names))
    df = df.drop(NAME_COLUMN).withColumnsRenamed(dict(names))
    date = parse_mixed_date("date") if isinstance(df.schema["date"].dataType, T.StringType) else F.col("date")
    numbers = {c: F.expr(f"try_cast(`{c}` AS double)") for c in ("rate", *BAR_COLUMNS) if c in df.columns}
    return df.withColumns({"date": date, "key": F.col("key").cast("string"), **numbers})


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Without the currency name column and without rows that have a NULL."""
    return df.drop(NAME_COLUMN).na.drop("any")


def read_rates(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    names: Mapping[str, str] = FILE_NAMES,
    unique: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """A rate file as a panel of (key, date, rate).

    Columns are read as text and cast, so no pass over the file is spent on
    guessing types. Duplicate (key, date) rows are averaged unless ``unique``
    is off; ``keep`` retains further columns and then also keeps duplicates.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}, expected one of {', '.join(FORMATS)}")
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    raw = standard_columns(reader.format(fmt).load(path), names)
    rows = drop_incomplete(raw.select("key", "date", "rate", *keep))
    return unique_rates(rows) if unique and not keep else rows


def load_summary(df: DataFrame, key: str = "key") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"))


def with_reason(df: DataFrame, key: str = "key", date: str = "date", rate: str = "rate") -> DataFrame:
    """Why a row cannot be scored; NULL for a good row."""
    reason = (
        F.when(F.col(date).isNull(), "missing date")
        .when(F.col(key).isNull(), "missing key")
        .when(F.col(rate).isNull(), "missing rate")
        .when(F.col(rate) <= 0, "rate not positive")
    )
    return df.withColumn("reason", reason)


def split_valid(df: DataFrame, key: str = "key", date: str = "date", rate: str = "rate") -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected rows with the reason."""
    require(df, [key, date, rate])
    marked = with_reason(df, key, date, rate)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())
