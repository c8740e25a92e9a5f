"""Folds, blending, stacking and forecast metrics on the baseline forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratepanel.operators import metrics, models, prep, stack
from ratepanel.operators.layout import with_position
from ratepanel.operators.models import BASELINES
from ratepanel.plans.catalog.inputs import METRICS_SQL
from ratepanel.plans.catalog.registry import BASE, base_preds, placed_rows, query, r, rounded, rs, with_sql
from ratepanel.session import settle

K = 5

FOLDS = f"""folded AS (
  SELECT *, CASE WHEN pos >= n - {K} * (n // {K + 1}) THEN CAST((pos - (n - {K} * (n // {K + 1}))) // (n // {K + 1}) AS INTEGER) END AS fold
  FROM placed
), oof AS ("""
FOLDS += (
    " UNION ALL ".join(
        f"SELECT pos, fold, '{m}' AS model, rate AS y, {m} AS pred FROM folded WHERE fold IS NOT NULL" for m in BASELINES
    )
    + ")"
)


@query("g1_time_folds", with_sql(BASE, FOLDS) + "SELECT key, date, pos, fold FROM folded")
def g1(spark: SparkSession, sf: str) -> DataFrame:
    return stack.folds(placed_rows(spark, sf), K).select("key", "date", "pos", "fold")


def oof_baselines(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = settle(placed_rows(spark, sf))
    trainers = {m: models.column_trainer(m) for m in BASELINES}
    return rows, stack.oof(rows, trainers, K, y="rate")


def oof_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The same predictions by the long form: a baseline needs no refit."""
    rows = stack.folds(placed_rows(spark, sf), K)
    preds = models.baseline_predictions(rows.where(F.col("fold").isNotNull()), ["pos", "fold"])
    return rows, preds


@query("g2_out_of_fold", with_sql(BASE, FOLDS) + f"SELECT pos, fold, model, {rs(['y', 'pred'])} FROM oof")
def g2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(oof_baselines(spark, sf)[1])


FOLD_MAE = """fold_mae AS (
  SELECT model, avg(m) AS mae FROM (SELECT model, fold, avg(abs(y - pred)) AS m FROM oof GROUP BY model, fold) GROUP BY model
)"""


@query("g3_fold_mae", with_sql(BASE, FOLDS, FOLD_MAE) + f"SELECT model, {rs(['mae'])} FROM fold_mae")
def g3(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stack.fold_mae(oof_rows(spark, sf)[1]))


@query(
    "g4_fill_oof",
    with_sql(BASE, FOLDS)
    + "SELECT pos, "
    + ", ".join(
        r(f"CASE WHEN fold IS NULL THEN avg(CASE WHEN fold IS NOT NULL THEN {m} END) OVER () ELSE {m} END", f"oof_{m}")
        for m in BASELINES
    )
    + " FROM folded",
)
def g4(spark: SparkSession, sf: str) -> DataFrame:
    rows, preds = oof_rows(spark, sf)
    filled = stack.fill_oof(rows.select("pos"), preds, BASELINES)
    return rounded(filled.withColumnsRenamed({m: f"oof_{m}" for m in BASELINES}))


OFFSET = 15


@query(
    "g5_align_sequences",
    with_sql(BASE)
    + f"""SELECT a.pos, {r('a.rate', 'rate')}, {r('b.rate', 'first_x')} FROM placed a JOIN placed b ON b.pos = a.pos - {OFFSET}""",
)
def g5(spark: SparkSession, sf: str) -> DataFrame:
    rows = placed_rows(spark, sf).select("key", "date", "rate", "pos")
    windows = prep.sequences(rows.select("key", "date", "rate"), ["rate"], OFFSET, "rate", cross_key=True)
    seq = with_position(windows, position="seq_pos").select("seq_pos", F.col("x")[0][0].alias("first_x"))
    return rounded(stack.align(rows.select("pos", "rate"), seq, OFFSET).select("pos", "rate", "first_x"))


WEIGHTS = "weights AS (SELECT model, 1 / (mae + 1e-6) / sum(1 / (mae + 1e-6)) OVER () AS weight FROM fold_mae)"


@query("g6_inverse_mae_weights", with_sql(BASE, FOLDS, FOLD_MAE, WEIGHTS) + f"SELECT model, {rs(['weight'])} FROM weights")
def g6(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stack.inverse_mae_weights(stack.fold_mae(oof_rows(spark, sf)[1])))


@query(
    "g7_weighted_blend",
    with_sql(BASE, FOLDS, FOLD_MAE, WEIGHTS)
    + f"SELECT pos, {r('sum(weight * pred)', 'pred')}, {r('any_value(y)', 'y')} FROM oof JOIN weights USING (model) GROUP BY pos",
)
def g7(spark: SparkSession, sf: str) -> DataFrame:
    preds = oof_rows(spark, sf)[1]
    return rounded(stack.blend(preds, stack.inverse_mae_weights(stack.fold_mae(preds)), y="y"))


META = ("SMA_20", "EMA_12")


def ridge_sql(source: str, name: str = "ridge") -> str:
    """Ridge of two columns, penalty 1, by Cramer's rule."""
    x1, x2 = META
    return f"""{name}_sums AS (
  SELECT count(*) * var_pop({x1}) + 1 AS a, count(*) * covar_pop({x1}, {x2}) AS b, count(*) * var_pop({x2}) + 1 AS c,
    count(*) * covar_pop({x1}, rate) AS t1, count(*) * covar_pop({x2}, rate) AS t2,
    avg({x1}) AS m1, avg({x2}) AS m2, avg(rate) AS my FROM {source}
), {name} AS (
  SELECT w1, w2, my - w1 * m1 - w2 * m2 AS w0, m1, m2 FROM (
    SELECT *, (c * t1 - b * t2) / (a * c - b * b) AS w1, (a * t2 - b * t1) / (a * c - b * b) AS w2 FROM {name}_sums)
)"""


@query(
    "g8_ridge",
    with_sql(BASE, ridge_sql("placed"))
    + " UNION ALL ".join(
        f"SELECT '{name}' AS term, {r(w, 'weight')} FROM ridge"
        for name, w in ((META[0], "w1"), (META[1], "w2"), ("(intercept)", "w0"))
    ),
)
def g8(spark: SparkSession, sf: str) -> DataFrame:
    fitted = stack.ridge(placed_rows(spark, sf), META, "rate")
    return rounded(spark.createDataFrame(fitted.rows(), "term string, weight double"))


@query(
    "g9_meta_holdout",
    with_sql(BASE, "first_half AS (SELECT * FROM placed WHERE pos < floor(n * 0.5e0))", ridge_sql("first_half"))
    + f"""SELECT pos, {r('rate')}, {r(f'w0 + w1 * {META[0]} + w2 * {META[1]}', 'pred')}
    FROM placed, ridge WHERE pos >= floor(n * 0.5e0)""",
)
def g9(spark: SparkSession, sf: str) -> DataFrame:
    rows = prep.split(placed_rows(spark, sf), 0.5, "positional", out="is_fit")
    fitted = stack.ridge(rows.where("is_fit"), META, "rate")
    return rounded(fitted.predict(rows.where(~F.col("is_fit"))).select("pos", "rate", "pred"))


@query(
    "g10_meta_strategies",
    with_sql(
        BASE,
        FOLDS,
        FOLD_MAE,
        f"two AS (SELECT model, 1 / (mae + 1e-6) / sum(1 / (mae + 1e-6)) OVER () AS weight FROM fold_mae WHERE model IN {META})",
        ridge_sql("placed"),
    )
    + f"""SELECT pos, {r(f'w0 + w1 * {META[0]} + w2 * {META[1]}', 'ridge')},
    {r(f"{META[0]} * (SELECT weight FROM two WHERE model = '{META[0]}') + {META[1]} * (SELECT weight FROM two WHERE model = '{META[1]}')", 'weighted')}
    FROM placed, ridge""",
)
def g10(spark: SparkSession, sf: str) -> DataFrame:
    rows, preds = oof_rows(spark, sf)
    mae = stack.fold_mae(preds).where(F.col("model").isin(list(META)))
    out = rows
    for strategy in stack.STRATEGIES:
        out = stack.fit_meta(rows, META, strategy, "rate", mae=mae).predict(out, strategy)
    return rounded(out.select("pos", *stack.STRATEGIES))


# --- metrics ----------------------------------------------------------------


@query("h1_errors", with_sql(METRICS_SQL) + f"SELECT model, {rs(['MSE', 'MAE', 'RMSE'])} FROM metrics")
def h1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.regression(base_preds(spark, sf)).select("model", "MSE", "MAE", "RMSE"))


@query("h2_mape", with_sql(METRICS_SQL) + f"SELECT model, {rs(['MAPE'])} FROM metrics")
def h2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.regression(base_preds(spark, sf)).select("model", "MAPE"))


@query("h3_r2", with_sql(METRICS_SQL) + f"SELECT model, {rs(['R2'])} FROM metrics")
def h3(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.regression(base_preds(spark, sf)).select("model", "R2"))


@query("h4_directional_accuracy", with_sql(METRICS_SQL) + f"SELECT model, {rs(['DA'])} FROM metrics")
def h4(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.directional(base_preds(spark, sf)))


@query("h5_model_comparison", with_sql(METRICS_SQL) + f"SELECT model, {rs(metrics.METRICS)} FROM metrics")
def h5(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.compare(base_preds(spark, sf)))


@query(
    "h6_best_model",
    with_sql(METRICS_SQL) + f"SELECT model, {rs(metrics.METRICS)} FROM metrics ORDER BY metrics.MAE, model LIMIT 1",
)
def h6(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.best(metrics.compare(base_preds(spark, sf))))


SHOWN = ("MAE", "RMSE", "MAPE", "R2", "DA")


@query(
    "h7_normalised_metrics",
    with_sql(METRICS_SQL)
    + "SELECT model, "
    + ", ".join(r(f"(m.{c} - min(m.{c}) OVER ()) / (max(m.{c}) OVER () - min(m.{c}) OVER () + 1e-10)", c) for c in SHOWN)
    + " FROM metrics m",
)
def h7(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.normalise(metrics.compare(base_preds(spark, sf))))


@query("h8_actual_vs_predicted", with_sql(BASE) + f"SELECT key, date, pos, model, {rs(['y', 'pred'])} FROM preds WHERE pos < 300")
def h8(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.sample(base_preds(spark, sf), 300).drop("key_pos"))


@query(
    "h9_within_tolerance",
    with_sql(BASE)
    + f"SELECT model, {r('100 * avg(CASE WHEN abs(y - pred) <= 0.05e0 * abs(y) THEN 1e0 ELSE 0e0 END)', 'within_pct')} FROM preds GROUP BY model",
)
def h9(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.within(base_preds(spark, sf), 0.05))


KEY_METRICS = (
    METRICS_SQL.replace("PARTITION BY model ORDER BY pos", "PARTITION BY model, key ORDER BY key_pos")
    .replace("SELECT model, avg(", "SELECT model, key, avg(")
    .replace("FROM steps GROUP BY model", "FROM steps GROUP BY model, key")
)


@query("h10_metrics_by_key", with_sql(KEY_METRICS) + f"SELECT model, key, {rs(metrics.METRICS)} FROM metrics")
def h10(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.compare(base_preds(spark, sf), ("model", "key"), "key_pos"))
