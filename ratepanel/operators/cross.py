"""Features across keys: common index and rolling correlation.

Everything stays long. The wide date-by-key matrix is an output form only; the
correlation uses that a missing day has return 0, so the sums over a window of
calendar rows are sums over the days a key really has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratepanel.functions.indicators import ratio
from ratepanel.operators.features import DEFAULTS
from ratepanel.operators.layout import BLOCK, OWN, fill_forward, is_calendar, open_series, with_rank

CALENDAR_BLOCK = 100_000
INDEX = "cal_idx"


def pivot_mean(
    df: DataFrame,
    keys: Sequence[Any],
    key: str = "key",
    date: str = "date",
    rate: str = "rate",
) -> DataFrame:
    """Wide date-by-key table; duplicates averaged. ``keys`` fixes the columns."""
    return df.groupBy(date).pivot(key, list(keys)).agg(F.avg(rate))


def daily_mean(df: DataFrame, key: str, date: str, rate: str) -> DataFrame:
    return df.groupBy(key, date).agg(F.avg(rate).alias(rate))


def calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """Dates on which any key has a row, numbered from 0."""
    dates = df.select(date).distinct()
    if is_calendar(df, date):
        # bounded by the calendar: one row per day
        return dates.withColumn(INDEX, (F.row_number().over(Window.orderBy(date)) - 1).cast("long"))
    return with_rank(dates, [date], INDEX)


def per_date(side: DataFrame, df: DataFrame, date: str) -> DataFrame:
    """The side of a join that has one row per date.

    Over a calendar it is bounded (a century has 37 thousand days), and sending
    it to the rows saves shuffling them by date. Timestamps have no such bound.
    """
    return F.broadcast(side) if is_calendar(df, date) else side


def _calendar_blocks(df: DataFrame, halo: int, rows_per_block: int) -> DataFrame:
    home = F.floor(F.col(INDEX) / rows_per_block)
    reach = F.floor((F.col(INDEX) + halo) / rows_per_block)
    return df.withColumn(BLOCK, F.explode(F.sequence(home, reach))).withColumn(OWN, F.col(BLOCK) == home)


def _return_on_calendar(key: Sequence[str], rate: str) -> Column:
    """Log return when the key also had the calendar row before, else 0."""
    w = Window.partitionBy(*key, BLOCK).orderBy(INDEX)
    adjacent = F.lag(INDEX).over(w) == F.col(INDEX) - 1
    grown = F.log(F.try_divide(F.col(rate), F.lag(rate).over(w)))
    return F.coalesce(F.when(adjacent, grown), F.lit(0.0))


def calendar_returns(
    df: DataFrame,
    key: str = "key",
    date: str = "date",
    rate: str = "rate",
    out: str = "cal_return",
    dense: bool = False,
    rows_per_block: int = CALENDAR_BLOCK,
) -> DataFrame:
    """Log returns against the previous row of the common calendar.

    Sparse (default): rows the key has; every other calendar row has return 0.
    Dense: those zero rows are written out as well.
    """
    days = calendar(df, date)
    rows = daily_mean(df, key, date, rate).join(per_date(days, df, date), date)
    blocked = _calendar_blocks(rows, 1, rows_per_block)
    found = (
        blocked.withColumn(out, _return_on_calendar([key], rate)).where(OWN).select(key, INDEX, out)
    )
    if dense:
        # every key writes its calendar block by block; rows it lacks are 0
        last = days.agg(F.max(INDEX).alias("_last"))
        step = F.lit(rows_per_block)
        grid = (
            df.select(key)
            .distinct()
            .join(F.broadcast(last))
            .withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / step))))
            .withColumn(
                INDEX,
                F.explode(F.sequence(F.col("_b") * step, F.least(F.col("_last"), (F.col("_b") + 1) * step - 1))),
            )
            .select(key, INDEX)
        )
        found = grid.join(found, [key, INDEX], "left").withColumn(out, F.coalesce(out, F.lit(0.0)))
    return found.join(per_date(days, df, date), INDEX).select(key, date, out)


def top_keys(df: DataFrame, n: int = 5, key: str = "key") -> DataFrame:
    """Most frequent keys; equal counts in key order."""
    return (
        df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), F.asc(key)).limit(n)
    )


def fx_index(
    df: DataFrame,
    keys: Sequence[Any] | None = None,
    n: int = 5,
    key: str = "key",
    date: str = "date",
    rate: str = "rate",
    out: str = "fx_index",
) -> DataFrame:
    """Equal-weight mean of the chosen keys per date."""
    if keys:
        chosen = df.where(F.col(key).isin(list(keys)))
    else:
        # at most n rows on the small side
        chosen = df.join(F.broadcast(top_keys(df, n, key).select(key)), key, "left_semi")
    return daily_mean(chosen, key, date, rate).groupBy(date).agg(F.avg(rate).alias(out))


def merge_index(
    df: DataFrame,
    index: DataFrame,
    key: str = "key",
    date: str = "date",
    rate: str = "rate",
    out: str = "fx_index",
    rows_per_block: int | None = None,
) -> DataFrame:
    """Index joined by date and filled forward inside each key, and the rate
    relative to it."""
    joined = df.join(per_date(index, df, date), date, "left")
    s, laid = open_series(joined, 1, key, date, rows_per_block)
    filled = s.close(fill_forward(s, laid, [out]))
    return filled.withColumn("rate_vs_index", ratio(F.col(rate), F.col(out)))


def rolling_corr(
    df: DataFrame,
    base: Any,
    window: int = 30,
    min_periods: int | None = None,
    key: str = "key",
    date: str = "date",
    rate: str = "rate",
    out: str | None = None,
    rows_per_block: int = CALENDAR_BLOCK,
) -> DataFrame:
    """Rolling Pearson correlation of calendar returns with the base key.

    One row per (key, date) of ``df``. NULL, the base key itself and a base
    that is not in the panel all give 0.
    """
    out = out or f"corr_vs_{base}_{window}d"
    if min_periods is None:
        min_periods = max(5, window // 3)
    days = calendar(df, date)
    rows = daily_mean(df, key, date, rate).join(per_date(days, df, date), date)

    # base returns and their window sums on every calendar row
    base_rows = days.join(rows.where(F.col(key) == F.lit(base)).select(INDEX, F.col(rate).alias("_rate")), INDEX, "left")
    on_calendar = Window.partitionBy(BLOCK).orderBy(INDEX)
    step = F.coalesce(
        F.log(F.try_divide(F.col("_rate"), F.lag("_rate").over(on_calendar))), F.lit(0.0)
    )
    frame = on_calendar.rowsBetween(-(window - 1), Window.currentRow)
    base_side = (
        _calendar_blocks(base_rows, window, rows_per_block)
        .withColumn("_y", step)
        .withColumn("_sy", F.sum("_y").over(frame))
        .withColumn("_syy", F.sum(F.col("_y") * F.col("_y")).over(frame))
        .where(OWN)
        .select(INDEX, "_y", "_sy", "_syy")
    )

    # a key's return needs one row more than the window itself
    keyed = Window.partitionBy(key, BLOCK).orderBy(INDEX).rangeBetween(-(window - 1), Window.currentRow)
    x, y = F.col("_x"), F.col("_y")
    n = F.least(F.col(INDEX) + 1, F.lit(window)).cast("double")
    sums = (
        _calendar_blocks(rows.join(per_date(base_side, df, date), INDEX), window, rows_per_block)
        .withColumn("_x", _return_on_calendar([key], rate))
        .withColumn("_sx", F.sum(x).over(keyed))
        .withColumn("_sxx", F.sum(x * x).over(keyed))
        .withColumn("_sxy", F.sum(x * y).over(keyed))
        .where(OWN)
    )
    cov = F.col("_sxy") / n - F.col("_sx") / n * F.col("_sy") / n
    var_x = F.greatest(F.col("_sxx") / n - F.pow(F.col("_sx") / n, 2), F.lit(0.0))
    var_y = F.greatest(F.col("_syy") / n - F.pow(F.col("_sy") / n, 2), F.lit(0.0))
    corr = F.try_divide(cov, F.sqrt(var_x * var_y))
    ready = (F.col(key) != F.lit(base)) & (n >= min_periods)
    value = F.coalesce(F.when(ready, corr), F.lit(0.0))
    return sums.select(key, date, value.alias(out))


def add_cross(
    df: DataFrame,
    cfg: Mapping[str, Any] | None = None,
    key: str = "key",
    date: str = "date",
    rate: str = "rate",
    rows_per_block: int | None = None,
) -> DataFrame:
    """Correlation, index and relative rate joined back to the panel."""
    cfg = DEFAULTS["cross_currency"] if cfg is None else cfg
    if not cfg.get("enabled", False):
        return df
    base, window = cfg.get("base_currency"), cfg.get("corr_window", 30)
    name = f"corr_vs_{base}_{window}d"
    index = fx_index(df, cfg.get("index_currencies") or None, cfg.get("index_size", 5), key, date, rate)
    out = merge_index(df, index, key, date, rate, rows_per_block=rows_per_block)
    if base is None:
        return out.withColumn(name, F.lit(0.0))
    corr = rolling_corr(df, base, window, None, key, date, rate, name)
    return out.join(corr, [key, date], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
