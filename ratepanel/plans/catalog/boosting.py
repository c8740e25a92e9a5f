"""Boosting over histograms: trees, loss by round, contributions.

A single cut has SQL, and so have the loss table and the contributions of models whose trees are
fixed values. Grown models of several rounds are compared with plain code in the tests.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratepanel.operators import boost, prep
from ratepanel.plans.catalog.registry import BASE, base_rows, query, r, rounded, with_sql
from ratepanel.session import settle

INPUTS = ["lag_1", "SMA_5", "SMA_20", "EMA_12"]
# Where rates are cut.
CUTS = [1.0, 1.2, 1.3, 1.4, 1.45, 1.5, 1.55, 1.6, 1.7, 1.8, 2.0]
STUMP = boost.Settings(rounds=1, rate=0.3, depth=1, l1=0.1, l2=1.0, min_rows=3)
GROWN = {"rounds": 5, "rate": 0.3, "depth": 4}

SHIFTED = "shifted AS (SELECT *, lead(rate) OVER (PARTITION BY key ORDER BY date) AS target FROM base), " + (
    "learnt AS (SELECT * FROM shifted WHERE lag_1 IS NOT NULL AND target IS NOT NULL)"
)


def forecast_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Inputs of a day as an array, and the rate of the next day."""
    rows = prep.add_target(base_rows(spark, sf), "n_step_ahead")
    x = F.array(*[F.col(c).cast("double") for c in INPUTS]).alias("x")
    return rows.select("key", "date", x, "target", F.year("date").alias("year"))


LONG = " UNION ALL ".join(f"SELECT {i} AS feature, {c} AS x, target FROM learnt" for i, c in enumerate(INPUTS))
SIDE = "greatest(abs({g}) - 0.1, 0) ** 2 / ({h} + 1)"
VALUE = "-sign({g}) * greatest(abs({g}) - 0.1, 0) / ({h} + 1) * 0.3"


@query(
    "f1_boost_stump",
    with_sql(
        BASE,
        SHIFTED,
        "mean AS (SELECT avg(target) AS base FROM learnt)",
        f"long AS ({LONG})",
        f"cuts AS (SELECT unnest([{', '.join(map(str, CUTS))}]::DOUBLE[]) AS cut)",
        """sides AS (
  SELECT feature, cut, sum(base - target) FILTER (x <= cut) AS gl, count(*) FILTER (x <= cut) AS hl,
    sum(base - target) FILTER (x > cut) AS gr, count(*) FILTER (x > cut) AS hr
  FROM long, cuts, mean GROUP BY feature, cut
)""",
        f"""best AS (
  SELECT * FROM sides WHERE hl >= 3 AND hr >= 3
  ORDER BY {SIDE.format(g='gl', h='hl')} + {SIDE.format(g='gr', h='hr')} - {SIDE.format(g='(gl + gr)', h='(hl + hr)')} DESC, feature, cut
  LIMIT 1
)""",
    )
    + f"""SELECT key, date, feature, cut, {r(
        f"base + CASE WHEN [{', '.join(INPUTS)}][feature + 1] <= cut THEN {VALUE.format(g='gl', h='hl')} ELSE {VALUE.format(g='gr', h='hr')} END",
        'pred',
    )} FROM learnt, best, mean""",
)
def f1_stump(spark: SparkSession, sf: str) -> DataFrame:
    """One round of one cut with both penalties, applied to the rows it was learnt from."""
    rows = settle(forecast_rows(spark, sf))
    model = boost.fit(rows, STUMP, [CUTS] * len(INPUTS))
    tree = model.trees[0]
    out = model.predict(rows).select("key", "date", F.lit(tree.feature[0]).alias("feature"), F.lit(tree.cut[0]).alias("cut"), "pred")
    return rounded(out)


def grown_errors(spark: SparkSession, sf: str, preset: str) -> DataFrame:
    """Errors by key on the newest year of a model grown on the years before it."""
    rows = forecast_rows(spark, sf)
    newest = rows.agg(F.max("year").alias("newest"))
    rows = settle(rows.join(F.broadcast(newest)).withColumn("is_test", F.col("year") == F.col("newest")))
    settings = replace(boost.boosted(preset), **GROWN, leaves=8 if preset == "b" else 0)
    model = boost.fit(rows.where(~F.col("is_test")), settings)
    error = F.abs(F.col("pred") - F.col("target"))
    scored = model.predict(rows.where("is_test"))
    return scored.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("mae"), F.lit(len(model.trees)).alias("rounds"))


@query("f2_boost_leaf_wise")
def f2_leaf_wise(spark: SparkSession, sf: str) -> DataFrame:
    return grown_errors(spark, sf, "b")


@query("f3_boost_symmetric")
def f3_symmetric(spark: SparkSession, sf: str) -> DataFrame:
    return grown_errors(spark, sf, "c")


# Cuts of the second input and the outputs on both sides, round by round.
ROUNDS = [(1.5, -0.10, 0.12), (1.3, -0.05, 0.02), (1.7, 0.01, 0.04), (1.4, 0.30, -0.30), (1.6, -0.25, 0.25), (1.5, -0.02, 0.02)]
START = 1.45
PATIENCE = 2


def stump(feature: int, cut: float, low: float, high: float) -> boost.Tree:
    return boost.Tree([feature, -1, -1], [cut, 0.0, 0.0], [1, -1, -1], [2, -1, -1], [0.0, low, high], [2.0, 1.0, 1.0], [0.0] * 3)


@query(
    "f4_staged_loss",
    with_sql(
        BASE,
        SHIFTED,
        "losses AS ("
        + " UNION ALL ".join(
            f"SELECT {n} AS round, avg((target - {START}"
            + "".join(f" - CASE WHEN SMA_5 <= {c} THEN {low} ELSE {high} END" for c, low, high in ROUNDS[:n])
            + ") ** 2) AS mse FROM learnt"
            for n in range(len(ROUNDS) + 1)
        )
        + ")",
        "marked AS (SELECT *, coalesce(mse < min(mse) OVER (ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS gains FROM losses)",
        "waits AS (SELECT *, round - max(CASE WHEN gains THEN round END) OVER (ORDER BY round) AS waited FROM marked)",
        f"ends AS (SELECT coalesce(min(round) FILTER (waited >= {PATIENCE}), max(round)) AS stopped_at FROM waits)",
    )
    + f"""SELECT CAST(round AS BIGINT) AS round, {r('mse')}, CAST(stopped_at AS BIGINT) AS stopped_at,
    CAST((SELECT max(round) FROM marked WHERE gains AND round <= stopped_at) AS BIGINT) AS best_round FROM losses, ends""",
)
def f4_losses(spark: SparkSession, sf: str) -> DataFrame:
    """The loss after every round from one pass, and where patience ends."""
    model = boost.Boosted(START, [stump(1, *row) for row in ROUNDS])
    losses = settle(boost.staged_loss(forecast_rows(spark, sf), model))
    stop = boost.early_stop(losses, PATIENCE).select("stopped_at", "best_round")
    return rounded(losses.join(F.broadcast(stop)))


# Two cuts on the first two inputs, leaf values, rows that reached the nodes.
FIRST, SECOND = 1.4, 1.6
LEAVES = (0.9, 1.3, 1.8)
COVERS = (100.0, 40.0, 60.0, 45.0, 15.0)
FIXED = boost.Tree([0, -1, 1, -1, -1], [FIRST, 0.0, SECOND, 0.0, 0.0], [1, -1, 3, -1, -1], [2, -1, 4, -1, -1],
    [0.0, LEAVES[0], 0.0, *LEAVES[1:]], list(COVERS), [0.0] * 5)
LOW = COVERS[1] / COVERS[0]
RIGHT = f"({COVERS[3] / COVERS[2]} * {LEAVES[1]} + {COVERS[4] / COVERS[2]} * {LEAVES[2]})"
KNOWN_SECOND = f"(CASE WHEN SMA_5 <= {SECOND} THEN {LEAVES[1]} ELSE {LEAVES[2]} END)"


@query(
    "f8_tree_contributions",
    with_sql(
        BASE,
        SHIFTED,
        f"""worth AS (
  SELECT key, date, {LOW} * {LEAVES[0]} + (1 - {LOW}) * {RIGHT} AS none,
    CASE WHEN lag_1 <= {FIRST} THEN {LEAVES[0]} ELSE {RIGHT} END AS one,
    {LOW} * {LEAVES[0]} + (1 - {LOW}) * {KNOWN_SECOND} AS two,
    CASE WHEN lag_1 <= {FIRST} THEN {LEAVES[0]} ELSE {KNOWN_SECOND} END AS both_known
  FROM learnt
)""",
    )
    + f"""SELECT key, date, {r('(one - none + both_known - two) / 2e0', 'lag_1')}, {r('(two - none + both_known - one) / 2e0', 'SMA_5')},
    {r('CAST(none AS DOUBLE)', 'expected')}, {r('CAST(both_known AS DOUBLE)', 'pred')} FROM worth""",
)
def f8_contributions(spark: SparkSession, sf: str) -> DataFrame:
    """Shapley values of a fixed tree for every row."""
    model = boost.Boosted(0.0, [FIXED])
    rows = forecast_rows(spark, sf).where(F.col("target").isNotNull())
    out = boost.contributions(model.predict(rows), model)
    parts = [F.col("contributions")[i].alias(c) for i, c in enumerate(INPUTS[:2])]
    return rounded(out.select("key", "date", *parts, F.lit(boost.expected(model)).alias("expected"), "pred"))


@query("f8_boosted_ranking")
def f8_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Mean absolute contributions of a grown model's inputs over all rows."""
    rows = settle(forecast_rows(spark, sf).where(F.col("target").isNotNull()))
    model = boost.fit(rows, replace(boost.boosted("a"), **GROWN))
    return boost.mean_contributions(boost.contributions(rows, model), INPUTS)
