"""Indicator columns over a laid-out series.

Each function returns Columns by output name. Functions whose docstring names
a helper column expect it to have been added in an earlier select.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratepanel.functions.dates import calendar_part
from ratepanel.operators.layout import Series

# Fixed value: keeps a ratio finite when its divisor is zero.
EPS = 1e-10


def ratio(top: Column, bottom: Column) -> Column:
    return top / (bottom + EPS)


def growth(s: Series, p: Column, steps: int = 1) -> Column:
    """Rate over the earlier rate; NULL on the first rows."""
    return F.try_divide(p, F.lag(p, steps).over(s.ordered()))


def sma(s: Series, p: Column, windows: Iterable[int]) -> dict[str, Column]:
    return {f"SMA_{w}": F.avg(p).over(s.last(w)) for w in windows}


def gains_and_losses(step: Column) -> tuple[Column, Column]:
    """NULL steps stay NULL, so that they do not count as zero."""
    up = F.when(step.isNotNull(), F.greatest(step, F.lit(0.0)))
    down = F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0)))
    return up, down


def rsi(gain: Column, loss: Column) -> Column:
    """Relative strength from plain rolling means of gains and losses."""
    return 100 - 100 / (1 + ratio(gain, loss))


def extremes(s: Series, x: Column, period: int) -> tuple[Column, Column]:
    """Lowest and highest of the last ``period`` values."""
    return F.min(x).over(s.last(period)), F.max(x).over(s.last(period))


def place_in_range(x: Column, low: Column, high: Column) -> Column:
    """0 at the low, 1 at the high."""
    return ratio(x - low, high - low)


def williams(p: Column, low: Column, high: Column) -> Column:
    return -100 * ratio(high - p, high - low)


def spread(s: Series, x: Column, window: int) -> Column:
    """Sample deviation; 0 where a frame has one value only."""
    return F.coalesce(F.stddev_samp(x).over(s.last(window)), F.lit(0.0))


def bollinger(p: Column, middle: Column, deviation: Column, k: float) -> dict[str, Column]:
    upper, lower = middle + k * deviation, middle - k * deviation
    return {
        "BB_upper": upper,
        "BB_lower": lower,
        "BB_width": upper - lower,
        "BB_pct": ratio(p - lower, upper - lower),
    }


def true_range(high: Column, low: Column, last_close: Column) -> Column:
    """Widest of the day's range and the two gaps from yesterday's close."""
    return F.greatest(high - low, F.abs(high - last_close), F.abs(low - last_close))


def signed_volume(step: Column, volume: Column) -> Column:
    """Volume with the sign of the price step; the first row counts as no step."""
    return F.signum(F.coalesce(step, F.lit(0.0))) * volume


def lags(s: Series, p: Column, periods: Iterable[int], fill: str) -> dict[str, Column]:
    """``ffill`` leaves the head NULL; ``bfill`` fills it from the first value,
    which leaks later knowledge into the head rows."""
    if fill not in ("ffill", "bfill"):
        raise ValueError(f"unknown lag fill {fill!r}")
    out = {}
    for k in periods:
        shifted = F.lag(p, k).over(s.ordered())
        out[f"lag_{k}"] = shifted if fill == "ffill" else F.coalesce(shifted, F.first(p).over(s.so_far()))
    return out


def calendar(date: Column, names: Iterable[str]) -> dict[str, Column]:
    return {name: calendar_part(date, name) for name in names}
