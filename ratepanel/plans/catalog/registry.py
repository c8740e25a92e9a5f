"""Registry of queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratepanel.operators import features
from ratepanel.operators.layout import with_position
from ratepanel.operators.models import BASELINES, baseline_predictions
from ratepanel.plans import panels

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6
# Below SMALL units a product with the unit is off by less than the distance from OFF_TIE to a half.
SMALL = 1e11
OFF_TIE = 0.4999
MANY = 4
ROUNDED = "_rounded"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to the digits at which two engines agree."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    if len(numbers) <= MANY:
        return df.withColumns({c: to_digits(F.col(c), digits) for c in numbers}) if numbers else df
    # written out for every one of many columns, the generated method is too long for Java to compile
    whole = F.transform(F.array(*numbers), lambda x: to_digits(x, digits))
    found = {c: F.col(ROUNDED)[i].alias(c) for i, c in enumerate(numbers)}
    return df.withColumn(ROUNDED, whole).select(*[found.get(c, F.col(c)) for c in df.columns])


def to_digits(x: Column, digits: int = DIGITS) -> Column:
    """``round(x, digits)``, which goes through decimal text, only where it is needed: near a tie, for large
    values, and for those that are not numbers. Elsewhere the nearest whole number of units is the same."""
    unit = 10.0**digits
    whole = F.rint(x * unit)
    plain = (F.abs(x) < SMALL / unit) & (F.abs(x * unit - whole) < OFF_TIE)
    return F.when(plain, whole / unit + 0.0).otherwise(F.round(x, digits))


# --- SQL building blocks ----------------------------------------------------


def r(expression: str, name: str | None = None, digits: int = DIGITS) -> str:
    """Rounded SQL column; adding zero turns -0.0 into 0.0."""
    return f"round({expression}, {digits}) + 0.0 AS {name or expression}"


def rs(names: Sequence[str], digits: int = DIGITS) -> str:
    return ", ".join(r(n, digits=digits) for n in names)


RAW = """raw AS (
  SELECT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS date, o_totalprice / 100003e0 AS rate FROM orders
)"""
PANEL = RAW + """, panel AS (
  SELECT key, date, avg(rate) AS rate FROM raw GROUP BY key, date
)"""
W0 = "(PARTITION BY key ORDER BY date)"


def last(n: int, partition: str = "key", order: str = "date") -> str:
    return f"(PARTITION BY {partition} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def ema_sql(source: str, value: str, spans: dict[str, int], out: str = "ema", keep: Sequence[str] = ()) -> str:
    """CTEs with the averages by recursion, one step per row."""
    kept = "".join(f", n.{c}" for c in keep)
    start = ", ".join(f"n.{value} AS {n}" for n in spans)
    step = ", ".join(
        f"(2e0/{s + 1}) * n.{value} + (1 - 2e0/{s + 1}) * e.{n}" for n, s in spans.items()
    )
    return f"""{out}_rows AS (
  SELECT *, row_number() OVER {W0} AS rn FROM {source}
), {out} AS (
  SELECT n.key, n.date, n.{value}, n.rn{kept}, {start} FROM {out}_rows n WHERE n.rn = 1
  UNION ALL
  SELECT n.key, n.date, n.{value}, n.rn{kept}, {step}
  FROM {out} e JOIN {out}_rows n ON n.key = e.key AND n.rn = e.rn + 1
)"""


def with_sql(*ctes: str) -> str:
    recursive = "RECURSIVE " if any("UNION ALL" in c for c in ctes) else ""
    return f"WITH {recursive}" + ", ".join(ctes) + "\n"


# --- shared inputs ----------------------------------------------------------

BASE_KEY = panels.BASE_KEY
BASE_CONFIG = features.only(
    "moving_averages", "lags", moving_averages={"sma_windows": [5, 20], "ema_windows": [12]}, lags={"periods": [1]}
)


def base_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Panel rows with the baseline forecasts; the first row of a key has none."""
    df = features.add_features(panels.panel_orders(spark, sf), BASE_CONFIG)
    return features.drop_warm_up(df)


def placed_rows(spark: SparkSession, sf: str) -> DataFrame:
    return with_position(base_rows(spark, sf), in_key="key_pos")


def base_preds(spark: SparkSession, sf: str) -> DataFrame:
    return baseline_predictions(placed_rows(spark, sf), ["key", "date", "pos", "key_pos"])


BASE = (
    PANEL
    + ", "
    + ema_sql("panel", "rate", {"EMA_12": 12})
    + f""", base AS (
  SELECT key, date, rate, EMA_12,
    lag(rate) OVER {W0} AS lag_1,
    avg(rate) OVER {last(5)} AS SMA_5,
    avg(rate) OVER {last(20)} AS SMA_20
  FROM ema
), placed AS (
  SELECT *, row_number() OVER (ORDER BY key, date) - 1 AS pos,
    row_number() OVER {W0} - 1 AS key_pos, count(*) OVER () AS n
  FROM base WHERE lag_1 IS NOT NULL
), preds AS ("""
    + " UNION ALL ".join(
        f"SELECT key, date, pos, key_pos, n, rate AS y, '{m}' AS model, {m} AS pred FROM placed" for m in BASELINES
    )
    + ")"
)
