"""Ticks to bars, and bars of many series side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratepanel.operators.layout import fill_forward, open_series


def bar_columns(ts: str = "ts", value: str = "value") -> list[Column]:
    """Open, high, low, close and tick count.

    Buffers of fixed width, so that ticks are hashed into bars and never
    sorted. Of several ticks at the very first or last instant any one counts.
    """
    return [
        F.min_by(value, ts).alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.max_by(value, ts).alias("close"),
        F.count(value).alias("volume"),
    ]


def bars(df: DataFrame, unit: str = "day", key: str = "key", ts: str = "ts", value: str = "value", out: str = "date") -> DataFrame:
    """One bar per key and time unit; partial bars are merged before the shuffle."""
    period = F.date_trunc(unit, F.col(ts))
    if unit in ("day", "week", "month", "quarter", "year"):
        period = period.cast("date")
    else:
        period = period.cast(df.schema[ts].dataType)
    return df.groupBy(key, period.alias(out)).agg(*bar_columns(ts, value))


def align_wide(
    df: DataFrame, labels: Sequence[str], fields: Sequence[str], label: str = "key", date: str = "date"
) -> DataFrame:
    """One row per date, columns ``<label>_<field>``; dates are the union over
    the series. The label list fixes the columns."""
    cells = [F.first(f, ignorenulls=True).alias(f) for f in fields]
    wide = df.where(F.col(label).isin(list(labels))).groupBy(date).pivot(label, list(labels)).agg(*cells)
    if len(fields) == 1:
        wide = wide.withColumnsRenamed({name: f"{name}_{fields[0]}" for name in labels})
    return wide


def fill_gaps(df: DataFrame, columns: Sequence[str], date: str = "date", key: str | None = None, rows_per_block: int | None = None) -> DataFrame:
    """Fill forward, then the head backward. The backward fill uses later
    values: keep it out of features."""
    names = df.columns
    series = key or "_series"
    if key is None:
        df = df.withColumn(series, F.lit(0))
    s, laid = open_series(df, 1, series, date, rows_per_block)
    return s.close(fill_forward(s, laid, columns, head=True)).select(*names)


def close_only(df: DataFrame, date: str = "date", suffix: str = "_close") -> DataFrame:
    """The date and the columns whose name ends in the suffix."""
    return df.select(date, *[c for c in df.columns if c.lower().endswith(suffix.lower())])


def latest_per_key(df: DataFrame, key: str = "key", date: str = "date") -> DataFrame:
    """The newest row of each key, merged before the shuffle."""
    rest = [F.max_by(c, date).alias(c) for c in df.columns if c not in (key, date)]
    return df.groupBy(key).agg(F.max(date).alias(date), *rest).select(*df.columns)


def tail_per_key(df: DataFrame, n: int, key: str = "key", date: str = "date") -> DataFrame:
    """The newest ``n`` rows of each key, cut down before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(date))
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")
