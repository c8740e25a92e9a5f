"""Per-key and cross-key features."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratepanel.operators import cross, features
from ratepanel.operators.ema import ema
from ratepanel.plans import panels
from ratepanel.plans.catalog.inputs import BARS, bars_table
from ratepanel.plans.catalog.registry import (
    BASE_KEY,
    PANEL,
    RAW,
    W0,
    ema_sql,
    last,
    query,
    r,
    rounded,
    rs,
    with_sql,
)

SMA_WINDOWS = (5, 10, 20, 50)
LAGS = (1, 2, 3, 5, 10)


def on_orders(spark: SparkSession, sf: str, operator: Callable[..., DataFrame], **settings: Any) -> DataFrame:
    """One operator on the orders panel."""
    return rounded(operator(panels.panel_orders(spark, sf), **settings))


def feature_sql(*columns: str, source: str = "panel", ctes: tuple[str, ...] = (PANEL,)) -> str:
    return with_sql(*ctes) + f"SELECT key, date, {r('rate')}, {', '.join(columns)} FROM {source}"


SMAS = [r(f"avg(rate) OVER {last(w)}", f"SMA_{w}") for w in SMA_WINDOWS]


@query("c1_sma", feature_sql(*SMAS))
def c1(spark: SparkSession, sf: str) -> DataFrame:
    return on_orders(spark, sf, features.sma)


EMAS = ema_sql("panel", "rate", {"EMA_5": 5, "EMA_12": 12, "EMA_26": 26})


@query("c2_ema", feature_sql(rs(["EMA_5", "EMA_12", "EMA_26"]), source="ema", ctes=(PANEL, EMAS)))
def c2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ema(panels.panel_orders(spark, sf), "rate", {"EMA_5": 5, "EMA_12": 12, "EMA_26": 26}))


@query(
    "c2_ema_supplier",
    with_sql(
        "panel AS (SELECT CAST(l_suppkey AS VARCHAR) AS key, CAST(l_shipdate AS DATE) AS date, "
        "avg(l_extendedprice / 100003e0) AS rate FROM lineitem GROUP BY 1, 2)",
        ema_sql("panel", "rate", {"EMA_26": 26}),
    )
    + f"SELECT key, date, {rs(['EMA_26'])} FROM ema",
)
def c2_supplier(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ema(panels.panel_supplier(spark, sf), "rate", {"EMA_26": 26}).drop("rate"))


MACD = (
    PANEL,
    ema_sql("panel", "rate", {"fast": 12, "slow": 26}),
    "macd AS (SELECT key, date, rate, fast - slow AS MACD FROM ema)",
    ema_sql("macd", "MACD", {"MACD_signal": 9}, "signal", keep=("rate",)),
)


@query("c3_macd", feature_sql(rs(["MACD"]), source="macd", ctes=MACD[:3]))
def c3(spark: SparkSession, sf: str) -> DataFrame:
    return on_orders(spark, sf, features.macd).drop("MACD_signal", "MACD_hist")


@query("c4_macd_signal", feature_sql(rs(["MACD_signal"]), source="signal", ctes=MACD))
def c4(spark: SparkSession, sf: str) -> DataFrame:
    return on_orders(spark, sf, features.macd).drop("MACD", "MACD_hist")


@query("c5_macd_hist", feature_sql(r("MACD - MACD_signal", "MACD_hist"), source="signal", ctes=MACD))
def c5(spark: SparkSession, sf: str) -> DataFrame:
    return on_orders(spark, sf, features.macd).drop("MACD", "MACD_signal")


STEPS = f"""steps AS (SELECT *, rate - lag(rate) OVER {W0} AS d FROM panel)"""
RSI = f"""rsi AS (
  SELECT *, 100 - 100 / (1 + avg(CASE WHEN d IS NOT NULL THEN greatest(d, 0) END) OVER {last(14)}
    / (avg(CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END) OVER {last(14)} + 1e-10)) AS RSI
  FROM steps
)"""
STOCH = f"""(RSI - min(RSI) OVER {last(14)}) / (max(RSI) OVER {last(14)} - min(RSI) OVER {last(14)} + 1e-10)"""


@query("c6_rsi", feature_sql(rs(["RSI"]), source="rsi", ctes=(PANEL, STEPS, RSI)))
def c6(spark: SparkSession, sf: str) -> DataFrame:
    return on_orders(spark, sf, features.rsi)


@query("c7_stoch_rsi", feature_sql(r(STOCH, "StochRSI", 4), source="rsi", ctes=(PANEL, STEPS, RSI)))
def c7(spark: SparkSession, sf: str) -> DataFrame:
    out = features.stoch_rsi(panels.panel_orders(spark, sf))
    return out.select("key", "date", F.round("rate", 6).alias("rate"), F.round("StochRSI", 4).alias("StochRSI"))


WILLIAMS = (
    f"-100 * (max(rate) OVER {last(14)} - rate) / (max(rate) OVER {last(14)} - min(rate) OVER {last(14)} + 1e-10)"
)


@query("c8_williams_r", feature_sql(r(WILLIAMS, "WilliamsR")))
def c8(spark: SparkSession, sf: str) -> DataFrame:
    return on_orders(spark, sf, features.williams)


BANDS = f"""bands AS (
  SELECT *, avg(rate) OVER {last(20)} AS mid, coalesce(stddev_samp(rate) OVER {last(20)}, 0) AS dev FROM panel
)"""
BAND_COLUMNS = [
    r("mid + 2 * dev", "BB_upper"),
    r("mid - 2 * dev", "BB_lower"),
    r("(mid + 2 * dev) - (mid - 2 * dev)", "BB_width"),
    r("(rate - (mid - 2 * dev)) / ((mid + 2 * dev) - (mid - 2 * dev) + 1e-10)", "BB_pct"),
]


@query("c9_bollinger", feature_sql(*BAND_COLUMNS, source="bands", ctes=(PANEL, BANDS)))
def c9(spark: SparkSession, sf: str) -> DataFrame:
    return on_orders(spark, sf, features.bollinger)


def priced_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars; the rate is the close."""
    return bars_table(spark, sf).withColumn("rate", F.col("close"))


PRICED = BARS + ", priced AS (SELECT *, close AS rate FROM bars)"
ATR = f"""ranges AS (
  SELECT *, greatest(high - low, abs(high - lag(close) OVER {W0}), abs(low - lag(close) OVER {W0})) AS tr FROM priced
), atr AS (SELECT *, avg(tr) OVER {last(14)} AS ATR FROM ranges)"""


@query(
    "c10_atr",
    with_sql(PRICED, ATR) + f"SELECT key, date, {r('close')}, {r('ATR')}, {r('ATR / (rate + 1e-10)', 'ATR_pct', 4)} FROM atr",
)
def c10(spark: SparkSession, sf: str) -> DataFrame:
    out = features.atr(priced_bars(spark, sf))
    # a close of 0 puts the ratio at 1e10 and beyond, where only its leading digits are meant
    return out.select("key", "date", F.round("close", 6).alias("close"), F.round("ATR", 6).alias("ATR"), F.round("ATR_pct", 4).alias("ATR_pct"))


@query(
    "c11_obv",
    with_sql(PRICED, f"flows AS (SELECT *, sign(coalesce(rate - lag(rate) OVER {W0}, 0)) * volume AS flow FROM priced)")
    + "SELECT key, date, CAST(sum(flow) OVER (PARTITION BY key ORDER BY date ROWS UNBOUNDED PRECEDING) AS DOUBLE) + 0.0 AS OBV FROM flows",
)
def c11(spark: SparkSession, sf: str) -> DataFrame:
    out = features.obv(priced_bars(spark, sf))
    return out.select("key", "date", F.round("OBV", 6).alias("OBV"))


RETURNS = f"""returns AS (
  SELECT *, coalesce(ln(rate / lag(rate) OVER {W0}), 0) AS log_return, coalesce(rate / lag(rate) OVER {W0} - 1, 0) AS pct_change
  FROM panel
)"""
VOLS = f"""vols AS (
  SELECT *, coalesce(stddev_samp(log_return) OVER {last(5)}, 0) AS volatility_5,
    coalesce(stddev_samp(log_return) OVER {last(20)}, 0) AS volatility_20
  FROM returns
)"""


def returns_of(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    return on_orders(spark, sf, features.returns).select("key", "date", "rate", *names)


@query("c12_log_return", feature_sql(rs(["log_return"]), source="returns", ctes=(PANEL, RETURNS)))
def c12(spark: SparkSession, sf: str) -> DataFrame:
    return returns_of(spark, sf, "log_return")


@query("c13_pct_change", feature_sql(rs(["pct_change"]), source="returns", ctes=(PANEL, RETURNS)))
def c13(spark: SparkSession, sf: str) -> DataFrame:
    return returns_of(spark, sf, "pct_change")


@query("c14_volatility", feature_sql(rs(["volatility_5", "volatility_20"]), source="vols", ctes=(PANEL, RETURNS, VOLS)))
def c14(spark: SparkSession, sf: str) -> DataFrame:
    return returns_of(spark, sf, "volatility_5", "volatility_20")


VOL_RATIO = "volatility_5 / (volatility_20 + 1e-10)"


@query("c15_vol_ratio", feature_sql(r(VOL_RATIO, "vol_ratio"), source="vols", ctes=(PANEL, RETURNS, VOLS)))
def c15(spark: SparkSession, sf: str) -> DataFrame:
    return returns_of(spark, sf, "vol_ratio")


LAG_COLUMNS = [r(f"lag(rate, {k}) OVER {W0}", f"lag_{k}") for k in LAGS]
BACK_FILLED = [r(f"coalesce(lag(rate, {k}) OVER {W0}, first_value(rate) OVER {W0})", f"lag_{k}") for k in LAGS]


@query("c16_lags_ffill", feature_sql(*LAG_COLUMNS))
def c16(spark: SparkSession, sf: str) -> DataFrame:
    return on_orders(spark, sf, features.lags)


@query("c17_lags_bfill", feature_sql(*BACK_FILLED))
def c17(spark: SparkSession, sf: str) -> DataFrame:
    return on_orders(spark, sf, features.lags, fill="bfill")


CALENDAR = [
    "CAST(isodow(date) - 1 AS INTEGER) AS day_of_week",
    "CAST(month(date) AS INTEGER) AS month",
    "CAST(quarter(date) AS INTEGER) AS quarter",
    "CAST(date = last_day(date) AS INTEGER) AS is_month_end",
]


@query("c18_calendar", feature_sql(*CALENDAR))
def c18(spark: SparkSession, sf: str) -> DataFrame:
    return on_orders(spark, sf, features.calendar)


ALL_CTES = (
    PANEL,
    ema_sql("panel", "rate", {"EMA_5": 5, "EMA_12": 12, "EMA_26": 26}),
    "macd AS (SELECT key, date, rate, EMA_5, EMA_12, EMA_26, EMA_12 - EMA_26 AS MACD FROM ema)",
    ema_sql("macd", "MACD", {"MACD_signal": 9}, "signal", keep=("rate", "EMA_5", "EMA_12", "EMA_26")),
    STEPS.replace("FROM panel", "FROM signal"),
    RSI,
    RETURNS.replace("FROM panel", "FROM rsi"),
    VOLS,
    BANDS.replace("FROM panel", "FROM vols"),
)
ALL_COLUMNS = [
    *SMAS,
    rs(["EMA_5", "EMA_12", "EMA_26", "MACD", "MACD_signal"]),
    r("MACD - MACD_signal", "MACD_hist"),
    rs(["RSI"]),
    r(STOCH, "StochRSI", 4),
    r(WILLIAMS, "WilliamsR"),
    *BAND_COLUMNS,
    rs(["log_return", "pct_change", "volatility_5", "volatility_20"]),
    r(VOL_RATIO, "vol_ratio"),
    *LAG_COLUMNS,
    *CALENDAR,
]


def full_set(spark: SparkSession, sf: str) -> DataFrame:
    return features.add_features(panels.panel_orders(spark, sf), features.config())


@query("c19_feature_set", feature_sql(*ALL_COLUMNS, source="bands", ctes=ALL_CTES))
def c19(spark: SparkSession, sf: str) -> DataFrame:
    out = full_set(spark, sf)
    return rounded(out.withColumn("StochRSI", F.round("StochRSI", 4)))


SUPPLIERS = """panel AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS key, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / 100003e0) AS rate
  FROM lineitem GROUP BY 1, 2
)"""


@query("c19_feature_set_supplier", feature_sql(*ALL_COLUMNS, source="bands", ctes=(SUPPLIERS, *ALL_CTES[1:])))
def c19_supplier(spark: SparkSession, sf: str) -> DataFrame:
    """The whole set on the panel with many keys."""
    out = features.add_features(panels.panel_supplier(spark, sf))
    return rounded(out.withColumn("StochRSI", F.round("StochRSI", 4)))


LEGACY_COLUMNS = [
    *SMAS,
    rs(["EMA_5", "EMA_12", "EMA_26", "MACD", "MACD_signal"]),
    r("MACD - MACD_signal", "MACD_hist"),
    rs(["RSI"]),
    r(STOCH, "StochRSI", 4),
    *BAND_COLUMNS[:3],
    rs(["log_return", "volatility_20"]),
    *BACK_FILLED,
    *[c for c in CALENDAR if "quarter" not in c],
]


@query("c20_legacy_set", feature_sql(*LEGACY_COLUMNS, source="bands", ctes=ALL_CTES))
def c20(spark: SparkSession, sf: str) -> DataFrame:
    out = features.legacy_features(panels.panel_orders(spark, sf))
    return rounded(out.withColumn("StochRSI", F.round("StochRSI", 4)))


@query(
    "c21_warm_up_report",
    with_sql(PANEL, f"lagged AS (SELECT key, lag(rate, 10) OVER {W0} AS lag_10 FROM panel)")
    + "SELECT key, count(lag_10) AS kept, count(*) - count(lag_10) AS lost FROM lagged GROUP BY key",
)
def c21(spark: SparkSession, sf: str) -> DataFrame:
    return features.warm_up_report(full_set(spark, sf))


# --- across keys ------------------------------------------------------------

# Order priorities of the test tables, as pivot columns.
KEYS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
INDEX_SIZE = 3


@query(
    "d1_pivot_mean",
    with_sql(RAW)
    + "SELECT date, "
    + ", ".join(f"round(avg(rate) FILTER (WHERE key = '{k}'), 6) + 0.0 AS \"{k}\"" for k in KEYS)
    + " FROM raw GROUP BY date",
)
def d1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cross.pivot_mean(panels.order_rates(spark, sf), KEYS))


GRID = """days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM panel)),
grid AS (
  SELECT k.key, d.date, d.idx, p.rate FROM (SELECT DISTINCT key FROM panel) k CROSS JOIN days d
  LEFT JOIN panel p ON p.key = k.key AND p.date = d.date
), cal AS (
  SELECT key, date, idx, rate, coalesce(ln(rate / lag(rate) OVER (PARTITION BY key ORDER BY date)), 0) AS ret FROM grid
)"""


@query("d2_calendar_returns", with_sql(PANEL, GRID) + f"SELECT key, date, {r('ret', 'cal_return')} FROM cal WHERE rate IS NOT NULL")
def d2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cross.calendar_returns(panels.panel_orders(spark, sf)))


@query("d2_calendar_returns_dense", with_sql(PANEL, GRID) + f"SELECT key, date, {r('ret', 'cal_return')} FROM cal")
def d2_dense(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cross.calendar_returns(panels.panel_orders(spark, sf), dense=True))


TOP = f"top AS (SELECT key, count(*) AS n_rows FROM panel GROUP BY key ORDER BY n_rows DESC, key LIMIT {INDEX_SIZE})"


@query("d3_top_keys", with_sql(PANEL, TOP) + "SELECT key, n_rows FROM top")
def d3(spark: SparkSession, sf: str) -> DataFrame:
    return cross.top_keys(panels.panel_orders(spark, sf), INDEX_SIZE)


INDEX = TOP + ", idx AS (SELECT date, avg(rate) AS fx_index FROM panel WHERE key IN (SELECT key FROM top) GROUP BY date)"


@query("d4_fx_index", with_sql(PANEL, INDEX) + f"SELECT date, {rs(['fx_index'])} FROM idx")
def d4(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cross.fx_index(panels.panel_orders(spark, sf), n=INDEX_SIZE))


MERGED = """merged AS (
  SELECT key, date, rate, last_value(fx_index IGNORE NULLS) OVER (PARTITION BY key ORDER BY date ROWS UNBOUNDED PRECEDING) AS fx_index
  FROM panel LEFT JOIN idx USING (date)
)"""


def with_index(spark: SparkSession, sf: str) -> DataFrame:
    df = panels.panel_orders(spark, sf)
    return cross.merge_index(df, cross.fx_index(df, n=INDEX_SIZE))


@query("d5_merge_index", with_sql(PANEL, INDEX, MERGED) + f"SELECT key, date, {rs(['fx_index'])} FROM merged")
def d5(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(with_index(spark, sf).select("key", "date", "fx_index"))


@query(
    "d6_rate_vs_index",
    with_sql(PANEL, INDEX, MERGED) + f"SELECT key, date, {r('rate / (fx_index + 1e-10)', 'rate_vs_index')} FROM merged",
)
def d6(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(with_index(spark, sf).select("key", "date", "rate_vs_index"))


CORR_NAME = f"corr_vs_{BASE_KEY}_30d"
CORR = f"""pairs AS (
  SELECT c.key, c.date, c.idx, c.rate, c.ret AS x, b.ret AS y FROM cal c JOIN cal b ON b.key = '{BASE_KEY}' AND b.date = c.date
), corrs AS (
  SELECT key, date, rate, CASE WHEN key = '{BASE_KEY}' OR idx < 9 THEN 0 ELSE coalesce(
    covar_samp(x, y) OVER w / nullif(stddev_samp(x) OVER w * stddev_samp(y) OVER w, 0), 0) END AS corr
  FROM pairs WINDOW w AS (PARTITION BY key ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
)"""


@query(
    "d7_rolling_corr",
    with_sql(PANEL, GRID, CORR) + f"SELECT key, date, round(corr, 6) + 0.0 AS \"{CORR_NAME}\" FROM corrs WHERE rate IS NOT NULL",
)
def d7(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cross.rolling_corr(panels.panel_orders(spark, sf), BASE_KEY))


@query(
    "d7_rolling_corr_supplier",
    with_sql(SUPPLIERS, GRID, CORR.replace(BASE_KEY, "1"))
    + f"SELECT key, date, {r('corr')} FROM corrs WHERE rate IS NOT NULL",
)
def d7_supplier(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cross.rolling_corr(panels.panel_supplier(spark, sf), "1", out="corr"))


@query(
    "d8_cross_features",
    with_sql(PANEL, GRID, CORR, INDEX, MERGED)
    + f"""SELECT m.key, m.date, {r('m.rate', 'rate')}, {r('fx_index')}, {r('m.rate / (fx_index + 1e-10)', 'rate_vs_index')},
    round(corr, 6) + 0.0 AS "{CORR_NAME}" FROM merged m JOIN corrs c ON c.key = m.key AND c.date = m.date""",
)
def d8(spark: SparkSession, sf: str) -> DataFrame:
    cfg = {"enabled": True, "base_currency": BASE_KEY, "corr_window": 30, "index_currencies": [], "index_size": INDEX_SIZE}
    return rounded(cross.add_cross(panels.panel_orders(spark, sf), cfg))
