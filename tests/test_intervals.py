"""Widths against sorted residuals, coverage on later rows, uncertainty of scored rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratepanel.operators import intervals


def noise(n, scale, key, seed):
    rng = random.Random(seed)
    return [(key, "m", i, rng.gauss(0, scale), 0.0) for i in range(n)]


@pytest.fixture(scope="module")
def preds(spark):
    rows = noise(4000, 1.0, "a", 1) + noise(4000, 5.0, "b", 2) + noise(99, 0.1, "few", 3)
    rows += [("a", "m", -1, None, 0.0), (None, "m", -2, 2.0, 0.0)]
    return spark.createDataFrame(rows, "key string, model string, pos long, y double, pred double")


def test_half_widths_are_quantiles_of_residuals(preds):
    found = {r["key"]: r for r in intervals.calibrate(preds, 0.8).collect()}
    rows = [(r["key"], abs(r["y"] - r["pred"])) for r in preds.where("y IS NOT NULL").collect()]
    assert set(found) == {"a", "b", None}
    for key, row in found.items():
        own = [x for k, x in rows if key is None or k == key]
        assert row["n"] == len(own)
        assert row["half_width"] == pytest.approx(np.quantile(own, 0.8), abs=1e-12)
    with pytest.raises(ValueError):
        intervals.calibrate(preds, 1.0)


def test_small_and_unknown_keys_take_the_models_width(spark, preds):
    widths = intervals.calibrate(preds)
    whole = widths.where("key IS NULL").first()["half_width"]
    asked = [("few", "m"), ("new", "m"), (None, "m"), ("a", "m"), ("a", "other")]
    got = intervals.attach(spark.createDataFrame(asked, "key string, model string"), widths).collect()
    by = {(r["key"], r["model"]): r["half_width"] for r in got}
    assert len(got) == len(asked)
    assert by["few", "m"] == by["new", "m"] == by[None, "m"] == whole
    assert by["a", "m"] < whole and by["a", "other"] is None


@pytest.mark.parametrize("level", [0.5, 0.9])
def test_coverage_of_later_rows(preds, level):
    known = preds.where("key IN ('a', 'b')")
    widths = intervals.calibrate(known.where("pos < 2000"), level)
    later = intervals.attach(known.where("pos >= 2000"), widths)
    inside = {}
    for key in "ab":
        rows = known.where(F.col("key") == key).orderBy("pos").collect()
        found = np.abs([r["y"] for r in rows if r["y"] is not None])
        inside[key] = (found[2000:] <= np.quantile(found[:2000], level)).mean()
    # four standard deviations of a share of 2000 rows against one learnt from 2000
    assert all(abs(x - level) < 4 * np.sqrt(2 * level * (1 - level) / 2000) for x in inside.values())
    for row in intervals.coverage(later, ("model", "key")).collect():
        assert row["n"] == 2000 and abs(row["coverage"] - inside[row["key"]]) < 1e-9


def test_nothing_to_learn_from(preds):
    widths = intervals.calibrate(preds.where("false"))
    assert widths.count() == 0
    assert intervals.attach(preds, widths).where(F.col("half_width").isNotNull()).count() == 0
