"""Forecast evaluation over long predictions: one row per model and row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratepanel.functions.indicators import EPS
from ratepanel.operators.layout import BLOCK, OWN, position_blocks

DIRECTION_BLOCK = 100_000

# Metric columns in report order.
METRICS = ("MSE", "MAE", "RMSE", "MAPE", "R2", "DA")


def error_columns(y: str = "y", p: str = "pred", epsilon: float = EPS) -> dict[str, Column]:
    """Aggregates for the error metrics; rows with ``y = 0`` leave MAPE."""
    err = F.col(y) - F.col(p)
    squared = err * err
    total = F.var_pop(y) * F.count(y)
    return {
        "MSE": F.avg(squared),
        "MAE": F.avg(F.abs(err)),
        "RMSE": F.sqrt(F.avg(squared)),
        "MAPE": F.avg(F.when(F.col(y) != 0, F.abs(F.try_divide(err, F.col(y))))) * 100,
        "R2": 1 - F.try_divide(F.sum(squared), total + epsilon),
    }


def regression(
    df: DataFrame, by: Sequence[str] = ("model",), y: str = "y", p: str = "pred", epsilon: float = EPS
) -> DataFrame:
    """MSE, MAE, RMSE, MAPE and R2 per group. ``epsilon=0`` is the older R2."""
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in error_columns(y, p, epsilon).items()])


def directional(
    df: DataFrame,
    by: Sequence[str] = ("model",),
    position: str = "pos",
    y: str = "y",
    p: str = "pred",
    rows_per_block: int = DIRECTION_BLOCK,
) -> DataFrame:
    """Share of steps (percent) with the same sign of change; one row gives 0.

    ``position`` numbers the rows without gaps inside each group of ``by``. The
    steps are found in blocks of positions, so a model's rows are never
    gathered in one task.
    """
    laid = position_blocks(df, position, 1, rows_per_block)
    w = Window.partitionBy(*by, BLOCK).orderBy(position)
    moved = lambda c: F.signum(F.col(c) - F.lag(c).over(w))
    steps = laid.withColumns({"_dy": moved(y), "_dp": moved(p)}).where(OWN)
    same = F.when(F.col("_dy").isNotNull(), (F.col("_dy") == F.col("_dp")).cast("double"))
    return steps.groupBy(*by).agg((F.coalesce(F.avg(same), F.lit(0.0)) * 100).alias("DA"))


def compare(
    df: DataFrame,
    by: Sequence[str] = ("model",),
    position: str = "pos",
    y: str = "y",
    p: str = "pred",
    rows_per_block: int = DIRECTION_BLOCK,
) -> DataFrame:
    """All metrics, one row per group, from one pass over the predictions."""
    laid = position_blocks(df, position, 1, rows_per_block)
    w = Window.partitionBy(*by, BLOCK).orderBy(position)
    moved = lambda c: F.signum(F.col(c) - F.lag(c).over(w))
    steps = laid.withColumns({"_dy": moved(y), "_dp": moved(p)}).where(OWN)
    same = F.when(F.col("_dy").isNotNull(), (F.col("_dy") == F.col("_dp")).cast("double"))
    found = [c.alias(n) for n, c in error_columns(y, p).items()]
    return steps.groupBy(*by).agg(*found, (F.coalesce(F.avg(same), F.lit(0.0)) * 100).alias("DA"))


def best(table: DataFrame, model: str = "model", metric: str = "MAE") -> DataFrame:
    """The row with the lowest error; equal errors in model order."""
    return table.orderBy(F.asc(metric), F.asc(model)).limit(1)


def normalise(table: DataFrame, metrics: Sequence[str] = ("MAE", "RMSE", "MAPE", "R2", "DA")) -> DataFrame:
    """Every metric to 0..1 over the models of the table."""
    ends = table.agg(*[f(m).alias(f"_{n}_{m}") for m in metrics for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = {m: (F.col(m) - F.col(f"_lo_{m}")) / (F.col(f"_hi_{m}") - F.col(f"_lo_{m}") + EPS) for m in metrics}
    rest = [c for c in table.columns if c not in metrics and c not in METRICS]
    return table.join(F.broadcast(ends)).withColumns(scaled).select(*rest, *metrics)


def sample(df: DataFrame, n: int = 300, by: str = "model", position: str = "pos") -> DataFrame:
    """The first ``n`` rows of each model, for charts."""
    w = Window.partitionBy(by).orderBy(position)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def within(df: DataFrame, tolerance: float = 0.05, by: Sequence[str] = ("model",), y: str = "y", p: str = "pred") -> DataFrame:
    """Share of rows (percent) off by at most ``tolerance`` of the true value."""
    close = F.abs(F.col(y) - F.col(p)) <= F.abs(F.col(y)) * tolerance
    return df.groupBy(*by).agg((F.avg(close.cast("double")) * 100).alias("within_pct"))
