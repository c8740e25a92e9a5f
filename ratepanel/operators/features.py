"""The per-key feature set, driven by a configuration.

All groups share one layout: the panel is shuffled once, and every window is
written against that partitioning. Features are emitted in a few selects,
because some are windows over others (RSI over steps, StochRSI over RSI).
"""

from __future__ import annotations

import copy
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratepanel.functions import indicators as ind
from ratepanel.functions.dates import CALENDAR_PARTS
from ratepanel.operators.ema import ema_columns, memory, number_rows, run_lengths
from ratepanel.operators.layout import open_series, running_sum

# The default configuration.
DEFAULTS: dict[str, dict[str, Any]] = {
    "moving_averages": {"enabled": True, "sma_windows": [5, 10, 20, 50], "ema_windows": [5, 12, 26]},
    "macd": {"enabled": True, "fast": 12, "slow": 26, "signal": 9},
    "rsi": {"enabled": True, "period": 14},
    "stoch_rsi": {"enabled": True, "period": 14},
    "williams_r": {"enabled": True, "period": 14},
    "bollinger_bands": {"enabled": True, "window": 20, "std_dev": 2},
    "atr": {"enabled": False},
    "obv": {"enabled": False},
    "returns_volatility": {"enabled": True, "vol_windows": [5, 20]},
    "lags": {"enabled": True, "periods": [1, 2, 3, 5, 10], "fill_method": "ffill"},
    "calendar": {"enabled": True, "features": list(CALENDAR_PARTS)},
    "cross_currency": {
        "enabled": True,
        "base_currency": "USD",
        "corr_window": 30,
        "index_currencies": [],
        "index_size": 5,
    },
    "target": {"mode": "raw_rate", "n_steps_ahead": 1},
}

# Fixed value: rows averaged by ATR.
ATR_PERIOD = 14


def config(overrides: Mapping[str, Mapping[str, Any]] | None = None) -> dict[str, dict[str, Any]]:
    """The defaults with single settings replaced."""
    cfg = copy.deepcopy(DEFAULTS)
    for group, settings in (overrides or {}).items():
        if group not in cfg:
            raise ValueError(f"unknown feature group {group!r}")
        cfg[group].update(settings)
    return cfg


def load_config(path: str) -> dict[str, dict[str, Any]]:
    """Configuration from a YAML file; groups it leaves out keep the defaults."""
    import yaml

    with open(path) as f:
        return config(yaml.safe_load(f) or {})


def only(*groups: str, **overrides: Mapping[str, Any]) -> dict[str, dict[str, Any]]:
    """The defaults with all per-key groups off but the named ones."""
    cfg = config(overrides)
    for group, settings in cfg.items():
        if group != "target":
            settings["enabled"] = group in groups
    return cfg


def legacy_config() -> dict[str, dict[str, Any]]:
    """The older preset: no Williams %R, back-filled lags, no quarter."""
    return config(
        {
            "williams_r": {"enabled": False},
            "returns_volatility": {"vol_windows": [20]},
            "lags": {"fill_method": "bfill"},
            "calendar": {"features": ["day_of_week", "month", "is_month_end"]},
            "cross_currency": {"enabled": False},
        }
    )


# Columns the current preset adds and the older one does not have.
LEGACY_OMITS = ("BB_pct", "pct_change")


def _on(cfg: Mapping[str, Any], group: str) -> bool:
    return bool(cfg.get(group, {}).get("enabled", False))


def look_back(cfg: Mapping[str, Any]) -> int:
    """Rows before a row that can still change its features."""
    reach = [1]
    if _on(cfg, "moving_averages"):
        reach += list(cfg["moving_averages"]["sma_windows"])
        reach += [memory(w) for w in cfg["moving_averages"]["ema_windows"]]
    if _on(cfg, "macd"):
        m = cfg["macd"]
        reach.append(max(memory(m["fast"]), memory(m["slow"])) + memory(m["signal"]))
    if _on(cfg, "rsi"):
        stoch = cfg["stoch_rsi"]["period"] if _on(cfg, "stoch_rsi") else 0
        reach.append(cfg["rsi"]["period"] + stoch + 1)
    if _on(cfg, "williams_r"):
        reach.append(cfg["williams_r"]["period"])
    if _on(cfg, "bollinger_bands"):
        reach.append(cfg["bollinger_bands"]["window"])
    if _on(cfg, "atr"):
        reach.append(ATR_PERIOD + 1)
    if _on(cfg, "returns_volatility"):
        reach += [w + 1 for w in cfg["returns_volatility"]["vol_windows"]]
    if _on(cfg, "lags"):
        reach += list(cfg["lags"]["periods"])
    return max(reach)


def add_features(
    df: DataFrame,
    cfg: Mapping[str, Any] | None = None,
    key: str = "key",
    date: str = "date",
    rate: str = "rate",
    rows_per_block: int | None = None,
) -> DataFrame:
    """Append the configured feature columns to a panel."""
    cfg = cfg or config()
    columns = df.columns
    has_bars = {"high", "low", "close"} <= set(columns)
    s, df = open_series(df, look_back(cfg), key, date, rows_per_block)
    p = F.col(rate)
    prev, step = F.col("_prev"), F.col("_step")
    names: list[str] = []

    # windows over the panel, then expressions on them; a window used twice is
    # named once, since equal window expressions are not merged
    base: dict[str, Column] = {"_prev": F.lag(p).over(s.ordered())}
    derived: dict[str, Column] = {"_step": p - prev}
    # windows over those, and so on
    base2: dict[str, Column] = {}
    derived2: dict[str, Column] = {}
    base3: dict[str, Column] = {}
    derived3: dict[str, Column] = {}

    averages: dict[str, int] = {}
    if _on(cfg, "moving_averages"):
        found = ind.sma(s, p, cfg["moving_averages"]["sma_windows"])
        base |= found
        averages = {f"EMA_{w}": w for w in cfg["moving_averages"]["ema_windows"]}
        names += [*found, *averages]
    macd = cfg["macd"] if _on(cfg, "macd") else None
    if macd:
        names += ["MACD", "MACD_signal", "MACD_hist"]
    if _on(cfg, "rsi"):
        period = cfg["rsi"]["period"]
        up, down = ind.gains_and_losses(step)
        base2 |= {"_gain": F.avg(up).over(s.last(period)), "_loss": F.avg(down).over(s.last(period))}
        derived2["RSI"] = ind.rsi(F.col("_gain"), F.col("_loss"))
        names.append("RSI")
        if _on(cfg, "stoch_rsi"):
            strength = F.col("RSI")
            base3["_rsi_low"], base3["_rsi_high"] = ind.extremes(s, strength, cfg["stoch_rsi"]["period"])
            derived3["StochRSI"] = ind.place_in_range(strength, F.col("_rsi_low"), F.col("_rsi_high"))
            names.append("StochRSI")
    if _on(cfg, "williams_r"):
        base["_low"], base["_high"] = ind.extremes(s, p, cfg["williams_r"]["period"])
        derived["WilliamsR"] = ind.williams(p, F.col("_low"), F.col("_high"))
        names.append("WilliamsR")
    if _on(cfg, "bollinger_bands"):
        window, k = cfg["bollinger_bands"]["window"], cfg["bollinger_bands"]["std_dev"]
        middle = f"SMA_{window}" if f"SMA_{window}" in base else "_middle"
        if middle not in base:
            base[middle] = F.avg(p).over(s.last(window))
        base["_deviation"] = ind.spread(s, p, window)
        bands = ind.bollinger(p, F.col(middle), F.col("_deviation"), k)
        derived |= bands
        names += list(bands)
    if _on(cfg, "atr") and has_bars:
        base["_last_close"] = F.lag("close").over(s.ordered())
        derived["_range"] = ind.true_range(F.col("high"), F.col("low"), F.col("_last_close"))
        base2["ATR"] = F.avg("_range").over(s.last(ATR_PERIOD))
        derived2["ATR_pct"] = ind.ratio(F.col("ATR"), p)
        names += ["ATR", "ATR_pct"]
    obv = _on(cfg, "obv") and "volume" in columns
    if obv:
        derived["_flow"] = ind.signed_volume(p - prev, F.col("volume"))
        names.append("OBV")
    if _on(cfg, "returns_volatility"):
        windows = cfg["returns_volatility"]["vol_windows"]
        derived["log_return"] = F.coalesce(F.log(F.try_divide(p, prev)), F.lit(0.0))
        derived["pct_change"] = F.coalesce(F.try_divide(p, prev) - 1, F.lit(0.0))
        vols = {f"volatility_{w}": ind.spread(s, F.col("log_return"), w) for w in windows}
        base2 |= vols
        names += ["log_return", "pct_change", *vols]
        if len(windows) >= 2:
            derived2["vol_ratio"] = ind.ratio(*[F.col(f"volatility_{w}") for w in windows[:2]])
            names.append("vol_ratio")
    if _on(cfg, "lags"):
        found = ind.lags(s, p, cfg["lags"]["periods"], cfg["lags"].get("fill_method", "ffill"))
        base |= found
        names += list(found)
    if _on(cfg, "calendar"):
        found = ind.calendar(F.col(date), cfg["calendar"]["features"])
        derived |= found
        names += list(found)

    # all windows in date order first: they and the row numbers share one sort
    spans = dict(averages)
    if macd:
        spans |= {f"EMA_{span}": span for span in (macd["fast"], macd["slow"])}
    if spans:
        df = number_rows(df, s)
    for stage in (base, derived, base2, derived2, base3, derived3):
        if stage:
            df = df.withColumns(stage)
    if obv:
        df = running_sum(s, df, "_flow", "OBV")
    if spans:
        lengths = run_lengths([*spans.values(), *([macd["signal"]] if macd else [])])
        df = ema_columns(df, s, rate, spans, lengths)
        if macd:
            df = df.withColumn("MACD", F.col(f"EMA_{macd['fast']}") - F.col(f"EMA_{macd['slow']}"))
            df = ema_columns(df, s, "MACD", {"MACD_signal": macd["signal"]}, lengths)
            df = df.withColumn("MACD_hist", F.col("MACD") - F.col("MACD_signal"))
    return s.close(df).select(*columns, *names)


# --- one group at a time ----------------------------------------------------


def _group(df: DataFrame, groups: Sequence[str], settings: Mapping[str, Mapping[str, Any]], options: Any) -> DataFrame:
    return add_features(df, only(*groups, **settings), **options)


def sma(df: DataFrame, windows: Sequence[int] = (5, 10, 20, 50), **options: Any) -> DataFrame:
    return _group(df, ["moving_averages"], {"moving_averages": {"sma_windows": windows, "ema_windows": []}}, options)


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, **options: Any) -> DataFrame:
    return _group(df, ["macd"], {"macd": {"fast": fast, "slow": slow, "signal": signal}}, options)


def rsi(df: DataFrame, period: int = 14, **options: Any) -> DataFrame:
    return _group(df, ["rsi"], {"rsi": {"period": period}}, options)


def stoch_rsi(df: DataFrame, period: int = 14, rsi_period: int = 14, **options: Any) -> DataFrame:
    settings = {"rsi": {"period": rsi_period}, "stoch_rsi": {"period": period}}
    return _group(df, ["rsi", "stoch_rsi"], settings, options)


def williams(df: DataFrame, period: int = 14, **options: Any) -> DataFrame:
    return _group(df, ["williams_r"], {"williams_r": {"period": period}}, options)


def bollinger(df: DataFrame, window: int = 20, std_dev: float = 2, **options: Any) -> DataFrame:
    return _group(df, ["bollinger_bands"], {"bollinger_bands": {"window": window, "std_dev": std_dev}}, options)


def atr(df: DataFrame, **options: Any) -> DataFrame:
    return _group(df, ["atr"], {}, options)


def obv(df: DataFrame, **options: Any) -> DataFrame:
    return _group(df, ["obv"], {}, options)


def returns(df: DataFrame, vol_windows: Sequence[int] = (5, 20), **options: Any) -> DataFrame:
    """Log return, relative change and their rolling deviations."""
    return _group(df, ["returns_volatility"], {"returns_volatility": {"vol_windows": vol_windows}}, options)


def lags(df: DataFrame, periods: Sequence[int] = (1, 2, 3, 5, 10), fill: str = "ffill", **options: Any) -> DataFrame:
    return _group(df, ["lags"], {"lags": {"periods": periods, "fill_method": fill}}, options)


def calendar(df: DataFrame, parts: Sequence[str] = CALENDAR_PARTS, **options: Any) -> DataFrame:
    return _group(df, ["calendar"], {"calendar": {"features": parts}}, options)


def legacy_features(df: DataFrame, **options: Any) -> DataFrame:
    return add_features(df, legacy_config(), **options).drop(*LEGACY_OMITS)


def drop_warm_up(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with every feature known."""
    return df.na.drop("any", subset=list(columns) if columns else None)


def warm_up_report(df: DataFrame, key: str = "key", columns: Sequence[str] | None = None) -> DataFrame:
    """Rows kept and lost to NULL features, per key."""
    known = F.lit(True)
    for c in columns or df.columns:
        known = known & F.col(c).isNotNull()
    return df.groupBy(key).agg(F.count_if(known).alias("kept"), F.count_if(~known).alias("lost"))
