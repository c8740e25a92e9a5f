"""Base models, search, ranking and spread.

Trained models have no SQL counterpart; their queries return predictions or
errors over the whole panel. Round counts are kept small here, the presets hold
the full ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratepanel.operators import intervals, metrics, models, prep, stack
from ratepanel.operators.layout import with_position
from ratepanel.plans import panels
from ratepanel.plans.catalog.evaluation import META, ridge_sql
from ratepanel.plans.catalog.registry import BASE, W0, base_preds, base_rows, placed_rows, query, r, rounded, rs, with_sql
from ratepanel.session import settle

INPUTS = ["lag_1", "SMA_5", "SMA_20", "EMA_12"]
ROUNDS = 5


def learning_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Features of a day and the rate of the next one, split by time."""
    rows = prep.add_target(base_rows(spark, sf), "n_step_ahead")
    rows = prep.split(rows, 0.8, "per_key_time")
    return settle(models.assemble(rows, INPUTS).select("key", "date", "target", "is_train", "features"))


def forecast_errors(model: object, rows: DataFrame) -> DataFrame:
    test = with_position(rows.where(~F.col("is_train")))
    scored = model.transform(test).select(F.lit("model").alias("model"), "pos", F.col("target").alias("y"), "pred")
    return metrics.compare(scored)


@query("f1_boosted_a")
def f1(spark: SparkSession, sf: str) -> DataFrame:
    rows = learning_rows(spark, sf)
    return forecast_errors(models.train(rows.where("is_train"), models.preset("boosted_a", {"maxIter": ROUNDS})), rows)


@query("f2_boosted_b")
def f2(spark: SparkSession, sf: str) -> DataFrame:
    rows = learning_rows(spark, sf)
    return forecast_errors(models.train(rows.where("is_train"), models.preset("boosted_b", {"maxIter": ROUNDS})), rows)


@query("f3_forest")
def f3(spark: SparkSession, sf: str) -> DataFrame:
    rows = learning_rows(spark, sf)
    return forecast_errors(models.train(rows.where("is_train"), models.preset("forest", {"numTrees": ROUNDS})), rows)


@query("f4_early_stop")
def f4(spark: SparkSession, sf: str) -> DataFrame:
    """Rounds used of those allowed, with the latest training rows watching."""
    rows = learning_rows(spark, sf)
    fit_rows = settle(models.mark_validation(rows.where("is_train"), 0.9))
    model = models.train(fit_rows, models.preset("boosted_b", {"maxIter": 2 * ROUNDS}), "is_val")
    return forecast_errors(model, rows).withColumn("rounds", F.lit(model.getNumTrees))


@query("f5_search")
def f5(spark: SparkSession, sf: str) -> DataFrame:
    rows = learning_rows(spark, sf)
    fit_rows = settle(models.mark_validation(rows.where("is_train"), 0.9))
    space = {"stepSize": (1e-3, 0.3, "log"), "maxDepth": (3, 5, "int"), "minInstancesPerNode": (1, 10, "int")}
    estimator = models.preset("boosted_a", {"maxIter": 2})
    return models.search(fit_rows, estimator, space, n=3)[2]


@query("f6_sequence_regressor")
def f6(spark: SparkSession, sf: str) -> DataFrame:
    df = panels.panel_orders(spark, sf)
    windows = prep.sequences(df, ["rate"], 15, "rate")
    rows = prep.split(prep.flatten_sequence(windows, 15, 1), 0.8, "per_key_time").withColumnRenamed("y", "target")
    rows = settle(rows.select("key", "date", "target", "is_train", "features"))
    return forecast_errors(models.train(rows.where("is_train"), models.preset("linear")), rows)


@query("f7_baselines", with_sql(BASE) + f"SELECT key, date, pos, model, {rs(['y', 'pred'])} FROM preds")
def f7(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(base_preds(spark, sf).drop("key_pos"))


SCORES = (
    "scores AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg(abs({w} * ({c} - {m}))) AS score FROM placed, ridge"
        for c, w, m in ((META[0], "w1", "m1"), (META[1], "w2", "m2"))
    )
    + "), ranked AS (SELECT feature, score, CAST(row_number() OVER (ORDER BY score DESC, feature) AS INTEGER) AS rank FROM scores)"
)


@query("f8_feature_ranking", with_sql(BASE, ridge_sql("placed"), SCORES) + f"SELECT feature, {r('score')}, rank FROM ranked")
def f8(spark: SparkSession, sf: str) -> DataFrame:
    rows = placed_rows(spark, sf)
    fitted = stack.ridge(rows, META, "rate")
    scores = models.linear_contributions(rows, dict(zip(fitted.columns, fitted.weights)))
    return rounded(models.rank_scores(scores))


@query("f8_tree_importance")
def f8_tree(spark: SparkSession, sf: str) -> DataFrame:
    rows = learning_rows(spark, sf)
    model = models.train(rows.where("is_train"), models.preset("forest", {"numTrees": ROUNDS}))
    return models.rank_features(model, rows, INPUTS)


# Weights of a linear forecast whose features are ranked.
FORECAST = {"lag_1": 0.1, "SMA_5": 0.4, "SMA_20": 0.2, "EMA_12": 0.3}


@query(
    "f9_low_importance",
    with_sql(
        BASE,
        "scores AS ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, avg(abs({w}e0 * ({c} - m))) AS score FROM placed, (SELECT avg({c}) AS m FROM placed)"
            for c, w in FORECAST.items()
        )
        + "), ranked AS (SELECT feature, score, CAST(row_number() OVER (ORDER BY score DESC, feature) AS INTEGER) AS rank FROM scores)",
    )
    + f"SELECT feature, {r('score')}, rank FROM ranked WHERE score <= (SELECT quantile_cont(score, 0.2) FROM ranked)",
)
def f9(spark: SparkSession, sf: str) -> DataFrame:
    ranking = models.rank_scores(models.linear_contributions(base_rows(spark, sf), FORECAST))
    return rounded(models.low_importance(ranking, 0.2))


@query(
    "f10_prediction_spread",
    with_sql(BASE) + f"SELECT pos, {r('avg(pred)', 'mean')}, {r('stddev_pop(pred)', 'std')} FROM preds GROUP BY pos",
)
def f10(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(models.spread(base_preds(spark, sf), ["pos"]))


@query("f10_bagged_spread")
def f10_bagged(spark: SparkSession, sf: str) -> DataFrame:
    rows = learning_rows(spark, sf)
    estimator = models.preset("forest", {"numTrees": 3, "maxDepth": 4})
    fitted = models.bagged(rows.where("is_train"), estimator, 3)
    return models.spread(models.sample_predictions(rows, fitted, ["key", "date"]), ["key", "date"])


# residuals of the first half of each key's days; the second half is answered
INTERVAL = (
    f"""ahead AS (
  SELECT *, lead(rate) OVER {W0} AS target FROM placed
), halves AS (
  SELECT *, row_number() OVER {W0} - 1 < floor(count(*) OVER (PARTITION BY key) * 0.5e0) AS early FROM ahead WHERE target IS NOT NULL
), guesses AS ("""
    + " UNION ALL ".join(f"SELECT key, date, early, target AS y, '{m}' AS model, {m} AS pred FROM halves" for m in models.BASELINES)
    + f"""), by_key AS (
  SELECT model, key, quantile_cont(abs(y - pred), {intervals.LEVEL}) AS own FROM guesses WHERE early
  GROUP BY model, key HAVING count(*) >= {intervals.LEAST}
), by_model AS (
  SELECT model, quantile_cont(abs(y - pred), {intervals.LEVEL}) AS whole FROM guesses WHERE early GROUP BY model
), answers AS (
  SELECT g.key, g.date, g.model, g.y, g.pred, coalesce(own, whole) AS half_width FROM guesses g
  JOIN by_model ON by_model.model = g.model LEFT JOIN by_key ON by_key.model = g.model AND by_key.key = g.key WHERE NOT early
)"""
)


def interval_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts of the next day's rate in the second half of each key's days, with half widths from the first."""
    rows = prep.split(prep.add_target(base_rows(spark, sf), "n_step_ahead"), 0.5, "per_key_time", out="early")
    preds = settle(models.baseline_predictions(rows, ["key", "date", "early"], "target"))
    return intervals.attach(preds.where(~F.col("early")), intervals.calibrate(preds.where("early"))).drop("early")


@query(
    "f10_calibrated_intervals",
    with_sql(BASE, INTERVAL) + f"SELECT key, date, model, {r('pred - half_width', 'low')}, {r('pred + half_width', 'high')} FROM answers",
)
def f10_intervals(spark: SparkSession, sf: str) -> DataFrame:
    low, high = F.col("pred") - F.col("half_width"), F.col("pred") + F.col("half_width")
    return rounded(interval_rows(spark, sf).select("key", "date", "model", low.alias("low"), high.alias("high")))


@query(
    "f10_interval_coverage",
    with_sql(BASE, INTERVAL)
    + f"""SELECT model, count(*) AS n, {r('avg(CASE WHEN abs(y - pred) <= half_width THEN 1e0 ELSE 0e0 END)', 'coverage')},
    {r('avg(2 * half_width)', 'width')} FROM answers GROUP BY model""",
)
def f10_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(intervals.coverage(interval_rows(spark, sf)))


# least squares on two inputs, refitted before each fold
REFIT = """shifted AS (
  SELECT *, lead(rate) OVER (PARTITION BY key ORDER BY date) AS target FROM base WHERE lag_1 IS NOT NULL
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY key, date) - 1 AS place, count(*) OVER () AS m FROM shifted WHERE target IS NOT NULL
), marked AS (
  SELECT *, CASE WHEN place >= m - 5 * (m // 6) THEN CAST((place - (m - 5 * (m // 6))) // (m // 6) AS INTEGER) END AS fold FROM numbered
), sums AS (
  SELECT f.fold, var_pop(lag_1) AS a, covar_pop(lag_1, SMA_5) AS b, var_pop(SMA_5) AS c, covar_pop(lag_1, target) AS t1,
    covar_pop(SMA_5, target) AS t2, avg(lag_1) AS m1, avg(SMA_5) AS m2, avg(target) AS my
  FROM range(0, 5) AS f(fold) JOIN marked ON coalesce(marked.fold, -1) < f.fold GROUP BY f.fold
), fitted AS (
  SELECT fold, w1, w2, my - w1 * m1 - w2 * m2 AS w0 FROM (
    SELECT *, (c * t1 - b * t2) / (a * c - b * b) AS w1, (a * t2 - b * t1) / (a * c - b * b) AS w2 FROM sums)
)"""


@query(
    "g2_out_of_fold_linear",
    with_sql(BASE, REFIT)
    + f"""SELECT place AS pos, key, date, marked.fold, 'linear' AS model, {r('target', 'y')}, {r('w0 + w1 * lag_1 + w2 * SMA_5', 'pred')}
    FROM marked JOIN fitted ON fitted.fold = marked.fold""",
)
def g2_linear(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold predictions with a refit per fold."""
    rows = prep.add_target(base_rows(spark, sf), "n_step_ahead")
    rows = settle(with_position(models.assemble(rows, ["lag_1", "SMA_5"]).select("key", "date", "target", "features")))
    trainers = {"linear": models.mllib_trainer(models.preset("linear"))}
    return rounded(stack.oof(rows, trainers, 5, ids=["key", "date"]))
