import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratepanel.operators import cross, prep


def gappy(spark, seed=5):
    """Three keys with calendars of their own; the base key misses days too."""
    rng = np.random.default_rng(seed)
    days = pd.date_range("2023-01-01", periods=120)
    frames = [
        pd.DataFrame({"key": k, "date": days.date, "rate": 10 + rng.normal(0, 0.2, 120).cumsum()})[rng.random(120) > 0.2]
        for k in ("X", "Y", "BASE")
    ]
    pdf = pd.concat(frames)
    return spark.createDataFrame(pdf, "key string, date date, rate double"), pdf


@pytest.mark.parametrize("rows_per_block", [40, 10**6])
def test_rolling_corr_matches_pandas(spark, rows_per_block):
    df, pdf = gappy(spark)
    wide = pdf.pivot_table(index="date", columns="key", values="rate")
    ret = np.log(wide / wide.shift(1)).fillna(0)
    out = cross.rolling_corr(df, "BASE", 30, rows_per_block=rows_per_block, out="c").toPandas()
    for k in ("X", "Y"):
        want = ret[k].rolling(30, min_periods=10).corr(ret["BASE"]).fillna(0)
        got = out[out["key"] == k].set_index("date")["c"].sort_index()
        np.testing.assert_allclose(got, want.reindex(got.index), atol=1e-9)
    assert (out[out["key"] == "BASE"]["c"] == 0).all()
    dense = cross.calendar_returns(df, dense=True, rows_per_block=rows_per_block).toPandas()
    np.testing.assert_allclose(dense.pivot(index="date", columns="key", values="cal_return"), ret, atol=1e-12)


def test_missing_base_and_flat_series_give_zero(panel):
    df = panel({"A": [2] * 40, "B": np.linspace(1, 2, 40)})
    assert {r["c"] for r in cross.rolling_corr(df, "NONE", out="c").collect()} == {0.0}
    assert {r["c"] for r in cross.rolling_corr(df, "B", out="c").where("key = 'A'").collect()} == {0.0}


def test_index_and_relative_rate(panel):
    df = panel({"A": [1, 2, 3], "B": [3, 4], "C": [100]})
    cfg = {"enabled": True, "base_currency": "A", "corr_window": 30, "index_currencies": ["A", "B"]}
    out = cross.add_cross(df, cfg).toPandas().sort_values(["key", "date"])
    assert list(out[out["key"] == "A"]["fx_index"]) == [2.0, 3.0, 3.0]
    np.testing.assert_allclose(out[out["key"] == "C"]["rate_vs_index"], [50.0])
    assert [r["key"] for r in cross.top_keys(df, 2).collect()] == ["A", "B"]
    assert cross.add_cross(df, {"enabled": False}) is df


def test_targets(panel):
    df = panel({"A": [1, 2, 4]})
    got = lambda mode, n=1: sorted(round(r["target"], 6) for r in prep.add_target(df, mode, n).collect())
    assert got("raw_rate") == [1, 2, 4]
    assert got("log_return") == [round(np.log(2), 6)] * 2
    assert got("pct_change") == [1, 1]
    assert got("n_step_ahead", 2) == [4]
    with pytest.raises(ValueError):
        prep.add_target(df, "tomorrow")


def test_robust_scaling_and_unseen_keys(panel):
    df = panel({"A": [1, 2, 3, 4, 5], "FLAT": [7, 7, 7]})
    params = prep.fit_robust(df, ["rate"])
    by_key = {r["key"]: (r["center"], r["scale"]) for r in params.collect()}
    assert by_key == {"A": (3.0, 2.0), "FLAT": (7.0, 1.0)}
    out = prep.apply_robust(panel({"A": [3, 5], "NEW": [9]}), params, ["rate"])
    assert sorted((r["key"], r["rate"]) for r in out.collect()) == [("A", 0.0), ("A", 1.0), ("NEW", 9.0)]


def test_minmax_round_trip(panel):
    df = panel({"A": [2, 4, 6]}).withColumn("flat", F.lit(3.0)).withColumn("seen", F.col("rate"))
    params = prep.fit_minmax(df, ["rate", "flat"])
    out = prep.apply_minmax(df, params, ["rate", "flat"])
    assert sorted(r["rate"] for r in out.collect()) == [0.0, 0.5, 1.0]
    assert {r["flat"] for r in out.collect()} == {0.0}
    back = prep.invert_minmax(out, params, "rate")
    assert all(r["rate"] == r["seen"] for r in back.collect())


def test_one_hot_forms_agree(panel):
    df = panel({"C": [1], "A": [2], "B": [3]})
    keys = prep.categories(df)
    dense = {r["key"]: (r["key_B"], r["key_C"]) for r in prep.one_hot(df, keys).collect()}
    assert keys == ["A", "B", "C"] and dense == {"A": (0, 0), "B": (1, 0), "C": (0, 1)}
    with pytest.raises(ValueError):
        prep.categories(df, limit=2)
    dimension = prep.category_index(df)
    assert {r["key"]: r["key_index"] for r in dimension.collect()} == {"A": 0, "B": 1, "C": 2}
    vectors = {r["key"]: list(r["key_vec"]) for r in prep.one_hot_vector(panel({"A": [1], "B": [1], "C": [1], "?": [1]}), dimension).collect()}
    assert vectors["A"] == vectors["?"] == [0.0, 0.0]
    assert sorted([vectors["B"], vectors["C"]]) == [[0.0, 1.0], [1.0, 0.0]]


def test_splits(panel):
    df = panel({"A": range(10), "B": range(10)})
    first = prep.split(df, 0.8, "positional")
    assert first.where("is_train AND key = 'A'").count() == 10 and first.where("is_train AND key = 'B'").count() == 6
    timed = prep.split(df, 0.8)
    assert timed.where("is_train AND key = 'A'").count() == 8
    late = timed.where("NOT is_train AND key = 'B'").agg(F.min("date")).first()[0]
    assert late > timed.where("is_train AND key = 'B'").agg(F.max("date")).first()[0]
    with pytest.raises(ValueError):
        prep.split(df, 0.8, "random")


def test_split_of_timestamps(hourly):
    df, _ = hourly
    out = prep.split(df, 0.8)
    assert out.where("is_train AND key = 'A'").count() == 2400 and out.where("is_train AND key = 'B'").count() == 32


def test_sequences_stay_in_the_key(panel):
    out = prep.sequences(panel({"A": range(6), "B": range(10, 13)}), ["rate"], 3, "rate").collect()
    got = sorted(([v[0] for v in r["x"]], r["y"]) for r in out)
    assert got == [([0, 1, 2], 3), ([1, 2, 3], 4), ([2, 3, 4], 5)]
