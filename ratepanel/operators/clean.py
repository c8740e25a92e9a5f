"""Outlier fences and duplicate handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratepanel.operators.quantiles import MAX_GROUP_VALUES, quantiles


def with_fences(
    df: DataFrame,
    m: float = 1.5,
    by_key: bool = True,
    key: str = "key",
    rate: str = "rate",
    max_group_values: int = MAX_GROUP_VALUES,
) -> DataFrame:
    """Add ``_low`` and ``_high``, the inclusive fences of each row's group."""
    by = [key] if by_key else []
    hinge = quantiles(df, {"_q1": (rate, 0.25), "_q3": (rate, 0.75)}, by, max_group_values)
    reach = (F.col("_q3") - F.col("_q1")) * F.lit(m)
    fences = hinge.select(*by, (F.col("_q1") - reach).alias("_low"), (F.col("_q3") + reach).alias("_high"))
    # global fences are one aggregate row; per-key fences are left to AQE,
    # which broadcasts them only when it has seen that they are small
    return df.join(fences, by) if by else df.join(F.broadcast(fences))


def inside_fences(rate: str = "rate") -> Column:
    return F.col(rate).between(F.col("_low"), F.col("_high"))


def iqr_filter(
    df: DataFrame,
    m: float = 1.5,
    by_key: bool = True,
    key: str = "key",
    rate: str = "rate",
    max_group_values: int = MAX_GROUP_VALUES,
) -> DataFrame:
    """Keep rows within ``m`` interquartile ranges of the hinges."""
    fenced = with_fences(df, m, by_key, key, rate, max_group_values)
    return fenced.where(inside_fences(rate)).select(*df.columns)


def iqr_report(df: DataFrame, m: float = 1.5, key: str = "key", rate: str = "rate") -> DataFrame:
    """Rows kept and dropped per key."""
    fenced = with_fences(df, m, True, key, rate)
    return fenced.groupBy(key).agg(
        F.count_if(inside_fences(rate)).alias("kept"),
        F.count_if(~inside_fences(rate)).alias("dropped"),
    )


def unique_rates(df: DataFrame, key: str = "key", date: str = "date", rate: str = "rate") -> DataFrame:
    """One row per key and date; duplicates are averaged."""
    return df.groupBy(key, date).agg(F.avg(rate).alias(rate))


def in_order(df: DataFrame, key: str = "key", date: str = "date") -> DataFrame:
    """Key and date order, for sinks; windows carry their own order."""
    return df.orderBy(key, date)
