import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratepanel.operators import metrics, models, stack


def preds(spark, y, p, model="m"):
    rows = [(model, i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "model string, pos long, y double, pred double")


def test_perfect_prediction(spark):
    row = metrics.compare(preds(spark, [1, 2, 3, 4, 5], [1, 2, 3, 4, 5])).first()
    assert row["MAE"] == row["MSE"] == row["RMSE"] == 0.0
    assert row["R2"] == pytest.approx(1.0) and row["DA"] == 100.0 and row["model"] == "m"


def test_direction(spark):
    up = [1, 2, 3, 4, 5]
    assert metrics.directional(preds(spark, up, [1.1, 2.1, 3.1, 4.1, 5.1])).first()["DA"] == 100.0
    assert metrics.directional(preds(spark, up, up[::-1])).first()["DA"] == 0.0
    assert metrics.directional(preds(spark, [1], [1])).first()["DA"] == 0.0
    # equal neighbours count as the same direction
    assert metrics.directional(preds(spark, [1, 1], [2, 2])).first()["DA"] == 100.0


@pytest.mark.parametrize("rows_per_block", [3, 1000])
def test_direction_in_blocks(spark, rows_per_block):
    rng = np.random.default_rng(0)
    y, p = rng.normal(size=50), rng.normal(size=50)
    want = np.mean(np.sign(np.diff(y)) == np.sign(np.diff(p))) * 100
    df = preds(spark, y, p)
    assert metrics.directional(df, rows_per_block=rows_per_block).first()["DA"] == pytest.approx(want)
    row = metrics.compare(df, rows_per_block=rows_per_block).first()
    assert row["DA"] == pytest.approx(want) and row["MAE"] == pytest.approx(np.abs(y - p).mean())
    assert row["R2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_mape_leaves_out_zeros(spark):
    assert metrics.regression(preds(spark, [0, 1, 2], [5, 1, 2])).first()["MAPE"] == 0.0
    assert metrics.regression(preds(spark, [0], [5])).first()["MAPE"] is None


def test_reports(spark):
    table = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 1.0)], "model string, MAE double")
    assert metrics.best(table).first()["model"] == "b"
    scaled = {r["model"]: r["MAE"] for r in metrics.normalise(table, ["MAE"]).collect()}
    assert scaled["a"] == pytest.approx(1.0) and scaled["b"] == 0.0
    assert metrics.sample(preds(spark, range(9), range(9)), 4).count() == 4
    assert metrics.within(preds(spark, [100, 100], [104, 106]), 0.05).first()["within_pct"] == 50.0


def split_by_rule(n, k):
    """Expanding folds by their definition: the last k blocks of n // (k + 1)."""
    size = n // (k + 1)
    out = [None] * n
    for f in range(k):
        start = n - (k - f) * size
        for i in range(start, start + size):
            out[i] = f
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 60), st.integers(2, 7))
def test_folds(spark, n, k):
    got = [r["fold"] for r in stack.folds(spark.range(n).withColumnRenamed("id", "pos"), k).orderBy("pos").collect()]
    assert got == split_by_rule(n, k)


def test_failed_jobs_are_raised(spark):
    df = spark.range(24).selectExpr("id AS pos", "id * 1.0D AS target", "id * 1.0D AS x")

    def lost(fit_rows, val_rows):
        raise MemoryError("no room")

    with pytest.raises(MemoryError):
        stack.oof(df, {"x": models.column_trainer("x"), "lost": lost}, 5)


def test_out_of_fold_and_failures(spark):
    n = 24
    df = spark.range(n).select(F.col("id").alias("pos"), F.col("id").cast("double").alias("target"), (F.col("id") + 1.0).alias("x"))

    def broken(fit_rows, val_rows):
        raise RuntimeError("no")

    def mean_of_past(fit_rows, val_rows):
        return val_rows.crossJoin(fit_rows.agg(F.avg("target").alias("pred")))

    trainers = {"x": models.column_trainer("x"), "mean": mean_of_past, "broken": broken}
    out = stack.oof(df, trainers, 5)
    first = out.where("model = 'mean' AND fold = 0").first()
    # fold 0 holds rows 4..7 and is fitted on rows 0..3
    assert first["pred"] == 1.5 and out.where("model = 'x'").count() == 20
    mae = {r["model"]: r["mae"] for r in stack.fold_mae(out, list(trainers)).collect()}
    assert mae["x"] == 1.0 and mae["broken"] == float("inf")
    weights = {r["model"]: r["weight"] for r in stack.inverse_mae_weights(stack.fold_mae(out, list(trainers))).collect()}
    assert weights["broken"] == 0.0 and sum(weights.values()) == pytest.approx(1.0)
    filled = stack.fill_oof(df.select("pos"), out, ["x", "mean"])
    head = filled.where("pos = 0").first()
    assert head["x"] == pytest.approx(np.mean(np.arange(4, 24) + 1)) and filled.count() == n
    assert stack.fill_oof(df.select("pos"), out, ["x"], drop_head=True).count() == 20


def test_ridge_matches_normal_equations(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(0, 0.1, 80)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    fitted = stack.ridge(df, ["a", "b", "c"], alpha=2.0)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(3), xc.T @ yc)
    np.testing.assert_allclose(fitted.weights, want, rtol=1e-9)
    assert fitted.intercept == pytest.approx(y.mean() - x.mean(0) @ want)


def test_meta_strategies(spark):
    df = spark.createDataFrame([(1.0, 3.0, 2.0), (2.0, 4.0, 3.0), (4.0, 5.0, 4.5)], "a double, b double, y double")
    mae = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "model string, mae double")
    weighted = stack.fit_meta(df, ["a", "b"], "weighted", mae=mae)
    assert weighted.weights == pytest.approx((0.75, 0.25), rel=1e-5)
    assert stack.fit_meta(df, ["a", "b"], "ridge").columns == ("a", "b")
    with pytest.raises(ValueError):
        stack.fit_meta(df, ["a", "b"], "weighted")
    with pytest.raises(ValueError):
        stack.fit_meta(df, ["a", "b"], "vote")


def test_presets_and_trials():
    assert models.preset("boosted_a").getMaxIter() == 800
    assert models.preset("boosted_a", {"maxIter": 3}).getMaxIter() == 3
    with pytest.raises(ValueError):
        models.preset("net")
    assert models.draw_trials(models.SEARCH_SPACE, 4) == models.draw_trials(models.SEARCH_SPACE, 4)


def test_low_importance_and_ranking(spark):
    scores = spark.createDataFrame([(c, float(i)) for i, c in enumerate("abcdef")], "feature string, score double")
    ranking = models.rank_scores(scores)
    assert [r["feature"] for r in ranking.orderBy("rank").collect()] == list("fedcba")
    assert sorted(r["feature"] for r in models.low_importance(ranking).collect()) == ["a", "b"]
