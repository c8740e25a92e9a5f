"""Prediction intervals from residuals of rows that no model was fitted on.

The half width of an interval is the quantile of the absolute residuals at the level asked
for, by model and key. A key with fewer than ``LEAST`` residuals takes the quantile of all keys of its model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratepanel.operators.quantiles import quantiles

LEVEL = 0.9
LEAST = 100


def calibrate(
    preds: DataFrame,
    level: float = LEVEL,
    by: Sequence[str] = ("model",),
    key: str = "key",
    y: str = "y",
    p: str = "pred",
    least: int = LEAST,
) -> DataFrame:
    """(by, key, n, half_width) from long predictions, which are read several times.

    Keys with fewer than ``least`` residuals have no row; the row of a null key is that of all keys.
    """
    if not 0 < level < 1:
        raise ValueError(f"a level lies between 0 and 1, not {level}")
    rows = preds.select(*by, key, F.abs(F.col(y) - F.col(p)).alias("_residual")).where(F.col("_residual").isNotNull())
    wanted = {"half_width": ("_residual", level)}

    def solved(df: DataFrame, groups: Sequence[str]) -> DataFrame:
        counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
        return counts.join(quantiles(df, wanted, groups), list(groups))

    counts = rows.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.count(F.lit(1)).alias("_n"))
    large = rows.join(counts.where(F.col("_n") >= least).drop("_n"), [*by, key], "left_semi")
    of_all = solved(rows, by).withColumn(key, F.lit(None).cast(rows.schema[key].dataType))
    return solved(large, [*by, key]).unionByName(of_all)


def attach(
    df: DataFrame, widths: DataFrame, by: Sequence[str] = ("model",), key: str = "key", out: str = "half_width"
) -> DataFrame:
    """The half width of each row: its key's, else its model's, else null."""
    own = widths.where(F.col(key).isNotNull()).select(*by, key, F.col("half_width").alias("_own"))
    # one row per model
    whole = widths.where(F.col(key).isNull()).select(*by, F.col("half_width").alias("_whole"))
    found = df.join(own, [*by, key], "left").join(F.broadcast(whole), list(by), "left")
    return found.withColumn(out, F.coalesce("_own", "_whole")).select(*df.columns, out)


def coverage(df: DataFrame, by: Sequence[str] = ("model",), y: str = "y", p: str = "pred", half: str = "half_width") -> DataFrame:
    """(by, n, coverage, width): the share of rows inside their interval, and its mean width."""
    known = df.where(F.col(y).isNotNull() & F.col(p).isNotNull() & F.col(half).isNotNull())
    inside = (F.abs(F.col(y) - F.col(p)) <= F.col(half)).cast("double")
    return known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(inside).alias("coverage"), F.avg(2 * F.col(half)).alias("width"))
