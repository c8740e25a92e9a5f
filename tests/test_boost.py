import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratepanel.operators import boost


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 1, (600, 4)), 2)
    y = 2 * x[:, 0] - np.abs(x[:, 1]) + (x[:, 2] > 0.3) * x[:, 0] + rng.normal(0, 0.1, 600)
    rows = [([float(v) for v in a], float(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "x array<double>, target double").repartition(5).cache()
    return df, x, y


CUTS = [[round(-1.5 + 0.25 * i, 2) for i in range(13)]] * 4


def thresholded(g, l1):
    return math.copysign(max(abs(g) - l1, 0.0), g)


def plain_tree(x, g, s, step):
    """A tree over all cuts, grown node by node; returns a function of rows."""

    def score(rows):
        return thresholded(g[rows].sum() / step, s.l1) ** 2 / (len(rows) + s.l2)

    def cuts(rows):
        for f in range(x.shape[1]):
            for cut in CUTS[f]:
                low = rows[x[rows, f] <= cut]
                high = rows[x[rows, f] > cut]
                if min(len(low), len(high)) >= s.min_rows:
                    yield score(low) + score(high) - score(rows), f, cut, low, high

    def value(rows):
        return -thresholded(g[rows].sum() / step, s.l1) / (len(rows) + s.l2) * s.rate

    out = np.zeros(len(x))
    leaves = [(np.arange(len(x)), 0)]
    if s.shape == "symmetric":
        for _ in range(s.depth):
            totals = {}
            for rows, _ in leaves:
                for gain, f, cut, low, high in cuts(rows):
                    totals[f, cut] = totals.get((f, cut), 0.0) + round(gain, 9)
            f, cut = min(totals, key=lambda k: (-totals[k], k))
            parts = []
            for rows, _ in leaves:
                low, high = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                parts += [(low, 0), (high, 0)] if min(len(low), len(high)) >= s.min_rows else [(rows, 0)]
            leaves = parts
    else:
        done = []
        while leaves:
            best = []
            for rows, depth in leaves:
                found = max(cuts(rows), key=lambda c: (c[0], -c[1], -c[2]), default=None) if depth < s.depth else None
                best.append((found[0] if found else -1, rows, depth, found))
            at = max(range(len(best)), key=lambda i: best[i][0])
            gain, rows, depth, found = best[at]
            if gain <= 0 or (s.shape == "leaves" and len(leaves) >= s.leaves):
                done, leaves = leaves, []
                continue
            leaves = leaves[:at] + [(found[3], depth + 1), (found[4], depth + 1)] + leaves[at + 1 :]
        leaves = done
    for rows, _ in leaves:
        out[rows] = value(rows)
    return out


@pytest.mark.parametrize(
    "settings",
    [
        boost.Settings(rounds=12, rate=0.3, depth=3, l1=0.5, l2=2.0, min_rows=5),
        boost.Settings(rounds=12, rate=0.3, depth=4, shape="leaves", leaves=5, l1=0.1, min_rows=8),
        boost.Settings(rounds=3, rate=0.5, depth=3, shape="symmetric", l2=3.0, min_rows=1),
        boost.Settings(rounds=20, rate=0.2, depth=1, l2=0.0),
    ],
)
def test_equals_growing_node_by_node(data, settings):
    df, x, y = data
    model = boost.fit(df, settings, CUTS)
    step = 2.0 ** (math.frexp(boost.STEPS / np.abs(y).max())[1] - 1)
    pred = np.full(len(y), model.base)
    for _ in range(settings.rounds):
        pred = pred + plain_tree(x, np.rint((pred - y) * step), settings, step)
    want = {tuple(a): p for a, p in zip(x.tolist(), pred)}
    for r in model.predict(df).collect():
        assert r["pred"] == pytest.approx(want[tuple(r["x"])], abs=1e-6)


def test_same_model_on_any_layout_and_from_text(data, spark):
    df = data[0]
    s = boost.boosted("a", rounds=4, depth=3)
    one = boost.fit(df, s, CUTS)
    other = boost.fit(df.repartition(2, "target").sortWithinPartitions("target"), s, CUTS)
    assert one.to_json() == other.to_json() == boost.Boosted.from_json(one.to_json()).to_json()
    assert sum(t.cover[0] for t in one.trees) / 4 == pytest.approx(480, abs=60)


def test_presets_and_errors(spark, data):
    assert boost.boosted("b").leaves == 63 and boost.boosted("c").shape == "symmetric"
    with pytest.raises(ValueError):
        boost.boosted("d")
    with pytest.raises(ValueError):
        boost.fit(data[0], boost.Settings(shape="round"))
    with pytest.raises(ValueError):
        boost.fit(data[0].limit(0), boost.Settings(rounds=1))


def test_leaves_are_counted_and_columns_drawn(data):
    model = boost.fit(data[0], boost.Settings(rounds=3, depth=5, shape="leaves", leaves=6, column_share=0.5), CUTS)
    for i, tree in enumerate(model.trees):
        assert tree.feature.count(-1) <= 6
        assert {f for f in tree.feature if f >= 0} <= set(boost.columns_of(4, model.settings, i))


def test_staged_loss_and_patience(spark, data):
    df, x, y = data
    marked = df.withColumn("is_val", F.pmod(F.xxhash64("x"), F.lit(4)) == 0)
    model, losses = boost.fit_until(marked, boost.Settings(rounds=60, rate=0.9, depth=4, l2=0.0), patience=5, ahead=10)
    table = [r["mse"] for r in losses.orderBy("round").collect()]
    best = min(range(len(table)), key=lambda i: table[i])
    assert len(model.trees) == best and len(table) - 1 - best >= 5
    val = marked.where("is_val")
    mse = model.predict(val).agg(F.avg((F.col("pred") - F.col("target")) ** 2)).first()[0]
    assert mse == pytest.approx(table[best])
    whole = boost.fit(marked.where("NOT is_val"), boost.Settings(rounds=best, rate=0.9, depth=4, l2=0.0))
    assert [t.feature for t in whole.trees] == [t.feature for t in model.trees]


@pytest.mark.parametrize("losses,patience,want", [([5, 4, 3, 3, 3.5, 2], 2, (2, 3, 4)), ([5, 4, 3, 3, 3.5, 2], 9, (5, 2, 5)), ([1], 3, (0, 1, 0))])
def test_early_stop(spark, losses, patience, want):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(losses)], "round long, mse double")
    r = boost.early_stop(df, patience).first()
    assert (r["best_round"], r["mse"], r["stopped_at"]) == want


def all_subsets(tree, x):
    """Shapley values by their definition; an unknown feature follows both children by cover."""

    def value(known, node=0):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        left, right = tree.left[node], tree.right[node]
        if f in known:
            return value(known, left if x[f] <= tree.cut[node] else right)
        return (tree.cover[left] * value(known, left) + tree.cover[right] * value(known, right)) / tree.cover[node]

    n, out = len(x), []
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        total = 0.0
        for k in range(n):
            for known in itertools.combinations(rest, k):
                weight = math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
                total += weight * (value({*known, i}) - value(set(known)))
        out.append(total)
    return out


def test_contributions_equal_all_subsets_and_add_up(data):
    df = data[0]
    model = boost.fit(df, boost.Settings(rounds=5, rate=0.3, depth=4, min_rows=3), CUTS)
    rows = boost.contributions(model.predict(df), model).limit(60).collect()
    for r in rows:
        want = np.sum([all_subsets(t, r["x"]) for t in model.trees], axis=0)
        np.testing.assert_allclose(r["contributions"], want, atol=1e-9)
        assert sum(r["contributions"]) + boost.expected(model) == pytest.approx(r["pred"], abs=1e-9)


def test_empty_partitions_and_constant_targets(spark):
    df = spark.createDataFrame([([1.0, 2.0], 3.0)] * 4, "x array<double>, target double").repartition(9)
    model = boost.fit(df, boost.Settings(rounds=2))
    assert [r["pred"] for r in model.predict(df).collect()] == pytest.approx([3.0] * 4)
