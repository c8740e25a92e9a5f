"""Targets, scaling, encoding, splits and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratepanel.operators import features, prep
from ratepanel.operators.layout import with_position
from ratepanel.plans import panels
from ratepanel.plans.catalog.feature_set import KEYS
from ratepanel.plans.catalog.registry import BASE, PANEL, W0, base_rows, query, r, rounded, rs, with_sql


def target_of(spark: SparkSession, sf: str, mode: str, n: int = 1, **options: bool) -> DataFrame:
    return rounded(prep.add_target(panels.panel_orders(spark, sf), mode, n, **options))


def target_sql(expression: str, where: str = "") -> str:
    found = f"found AS (SELECT key, date, rate, {expression} AS target FROM panel)"
    return with_sql(PANEL, found) + f"SELECT key, date, {rs(['rate', 'target'])} FROM found {where}"


@query("e1_target_raw_rate", target_sql("rate"))
def e1(spark: SparkSession, sf: str) -> DataFrame:
    return target_of(spark, sf, "raw_rate")


@query("e2_target_log_return", target_sql(f"ln(rate / lag(rate) OVER {W0})"))
def e2(spark: SparkSession, sf: str) -> DataFrame:
    return target_of(spark, sf, "log_return", keep_null=True)


@query("e3_target_pct_change", target_sql(f"rate / lag(rate) OVER {W0} - 1"))
def e3(spark: SparkSession, sf: str) -> DataFrame:
    return target_of(spark, sf, "pct_change", keep_null=True)


@query("e4_target_n_step", target_sql(f"lead(rate, 3) OVER {W0}"))
def e4(spark: SparkSession, sf: str) -> DataFrame:
    return target_of(spark, sf, "n_step_ahead", 3, keep_null=True)


@query("e5_drop_null_target", target_sql(f"lead(rate, 1) OVER {W0}", "WHERE target IS NOT NULL"))
def e5(spark: SparkSession, sf: str) -> DataFrame:
    return target_of(spark, sf, "n_step_ahead")


SCALED = ("lag_1", "SMA_5", "SMA_20", "EMA_12")


def _robust_params(by: str) -> str:
    group = f"GROUP BY {by}" if by else ""
    pick = by or "NULL"
    each = " UNION ALL ".join(
        f"""SELECT {pick} AS key, '{c}' AS feature, quantile_cont({c}, 0.5) AS center,
        CASE WHEN quantile_cont({c}, 0.75) = quantile_cont({c}, 0.25) THEN 1
        ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS scale FROM placed {group}"""
        for c in SCALED
    )
    return f"params AS ({each})"


@query(
    "e6_robust_fit",
    with_sql(BASE, _robust_params("key")) + f"SELECT key, feature, {rs(['center', 'scale'])} FROM params",
)
def e6(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(prep.fit_robust(base_rows(spark, sf), SCALED))


def _scaled_sql(joined: bool) -> str:
    out = []
    for c in SCALED:
        match = "AND q.key = p.key" if joined else ""
        pick = "(SELECT {f} FROM params q WHERE q.feature = '" + c + f"' {match})"
        out.append(r(f"coalesce((p.{c} - {pick.format(f='center')}) / {pick.format(f='scale')}, p.{c})", c))
    return ", ".join(out)


# the key '5-LOW' has no stored parameters here, so its rows stay raw
@query(
    "e7_robust_apply",
    with_sql(BASE, _robust_params("key").replace("FROM placed", "FROM placed WHERE key <> '5-LOW'"))
    + f"SELECT p.key, p.date, {_scaled_sql(True)} FROM placed p",
)
def e7(spark: SparkSession, sf: str) -> DataFrame:
    rows = base_rows(spark, sf)
    params = prep.fit_robust(rows.where(F.col("key") != "5-LOW"), SCALED)
    return rounded(prep.apply_robust(rows, params, SCALED).select("key", "date", *SCALED))


@query("e8_robust_global", with_sql(BASE, _robust_params("")) + f"SELECT p.key, p.date, {_scaled_sql(False)} FROM placed p")
def e8(spark: SparkSession, sf: str) -> DataFrame:
    rows = base_rows(spark, sf)
    params = prep.fit_robust(rows, SCALED, by_key=False)
    return rounded(prep.apply_robust(rows, params, SCALED, by_key=False).select("key", "date", *SCALED))


MINMAX = [f"({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0)" for c in ("rate", *SCALED)]


@query(
    "e9_minmax",
    with_sql(BASE)
    + "SELECT key, date, "
    + ", ".join(r(f"coalesce({e}, 0)", c) for c, e in zip(("rate", *SCALED), MINMAX))
    + " FROM placed",
)
def e9(spark: SparkSession, sf: str) -> DataFrame:
    rows = base_rows(spark, sf)
    columns = ["rate", *SCALED]
    return rounded(prep.apply_minmax(rows, prep.fit_minmax(rows, columns), columns).select("key", "date", *columns))


# SMA_5 taken as a scaled prediction of the rate, brought back to rate units
@query(
    "e10_minmax_inverse",
    with_sql(BASE)
    + f"""SELECT key, date, {r('SMA_5 / 10 * (max(rate) OVER () - min(rate) OVER ()) + min(rate) OVER ()', 'predicted_rate')} FROM placed""",
)
def e10(spark: SparkSession, sf: str) -> DataFrame:
    rows = base_rows(spark, sf).withColumn("pred", F.col("SMA_5") / 10)
    back = prep.invert_minmax(rows, prep.fit_minmax(rows, ["rate"]), "pred", "rate", "predicted_rate")
    return rounded(back.select("key", "date", "predicted_rate"))


@query(
    "e11_one_hot",
    with_sql(PANEL)
    + "SELECT key, date, "
    + ", ".join(f"CAST(key = '{k}' AS INTEGER) AS \"key_{k}\"" for k in KEYS[1:])
    + " FROM panel",
)
def e11(spark: SparkSession, sf: str) -> DataFrame:
    df = panels.panel_orders(spark, sf)
    return prep.one_hot(df, prep.categories(df)).drop("rate")


@query(
    "e11_category_index",
    "SELECT CAST(l_suppkey AS VARCHAR) AS key, row_number() OVER (ORDER BY CAST(l_suppkey AS VARCHAR)) - 1 AS key_index FROM (SELECT DISTINCT l_suppkey FROM lineitem)",
)
def e11_index(spark: SparkSession, sf: str) -> DataFrame:
    return prep.category_index(panels.panel_supplier(spark, sf))


@query(
    "e12_split_positional",
    with_sql(PANEL)
    + f"SELECT key, date, {r('rate')}, row_number() OVER (ORDER BY key, date) - 1 < floor(count(*) OVER () * 0.8e0) AS is_train FROM panel",
)
def e12(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(prep.split(panels.panel_orders(spark, sf), 0.8, "positional"))


@query(
    "e12_split_per_key",
    with_sql(PANEL)
    + f"""SELECT key, date, {r('rate')}, row_number() OVER {W0} - 1 < floor(count(*) OVER (PARTITION BY key) * 0.8e0) AS is_train
    FROM panel""",
)
def e12_key(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(prep.split(panels.panel_orders(spark, sf), 0.8, "per_key_time"))


STEPS = 15


def _windows(partition: str, order: str) -> str:
    """Every window as rows (step, x)."""
    return f"""numbered AS (
  SELECT key, date, rate, row_number() OVER ({partition} ORDER BY {order}) AS i, row_number() OVER (ORDER BY key, date) AS g FROM panel
), windows AS (
  SELECT b.key, b.date, CAST(s.step AS INTEGER) AS step, a.rate AS x, b.rate AS y
  FROM numbered b, range(0, {STEPS}) AS s(step), numbered a
  WHERE b.i > {STEPS} AND a.g = b.g - {STEPS} + s.step
)"""


def sequence_rows(df: DataFrame) -> DataFrame:
    each = F.posexplode("x").alias("step", "row")
    return rounded(df.select("key", "date", "y", each).select("key", "date", "step", F.col("row")[0].alias("x"), "y"))


@query(
    "e13_sequences",
    with_sql(PANEL, _windows("PARTITION BY key", "date")) + f"SELECT key, date, step, {rs(['x', 'y'])} FROM windows",
)
def e13(spark: SparkSession, sf: str) -> DataFrame:
    return sequence_rows(prep.sequences(panels.panel_orders(spark, sf), ["rate"], STEPS, "rate"))


@query(
    "e13_sequences_cross_key",
    with_sql(PANEL, _windows("", "key, date")) + f"SELECT key, date, step, {rs(['x', 'y'])} FROM windows",
)
def e13_cross(spark: SparkSession, sf: str) -> DataFrame:
    return sequence_rows(prep.sequences(panels.panel_orders(spark, sf), ["rate"], STEPS, "rate", cross_key=True))


@query(
    "e14_restore_order",
    with_sql(PANEL)
    + f"SELECT * FROM (SELECT row_number() OVER (ORDER BY key, date) - 1 AS input_pos, key, date, {r(f'lag(rate) OVER {W0}', 'lag_1')} FROM panel) ORDER BY input_pos",
)
def e14(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_position(panels.panel_orders(spark, sf), position="input_pos")
    cfg = features.only("lags", lags={"periods": [1]})
    return prep.restore_order(rounded(features.add_features(rows, cfg).select("input_pos", "key", "date", "lag_1")))
