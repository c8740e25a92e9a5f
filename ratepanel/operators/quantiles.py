"""Exact quantiles (linear interpolation) for groups of any size.

``percentile`` keeps every distinct value of a group in one buffer, so it is
used only when the largest group was counted and is small. Larger groups are
solved by selection: a mergeable sketch brackets the wanted order statistics,
the rows below each bracket are counted, and only the few rows strictly inside
a bracket are ranked. The answer is exact either way.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# values of a group that ``percentile`` may hold, over all columns
MAX_GROUP_VALUES = 4_000_000
ACCURACY = 10_000
# outputs that one selection pass works on; each needs a dozen aggregates
OUTPUTS_PER_PASS = 12


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")) if by else df.agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def quantiles(
    df: DataFrame,
    outputs: Mapping[str, tuple[str, float]],
    by: Sequence[str] = (),
    max_group_values: int = MAX_GROUP_VALUES,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per group; ``outputs`` maps a name to (column, probability)."""
    columns: dict[str, list[tuple[str, float]]] = {}
    for name, (column, prob) in outputs.items():
        columns.setdefault(column, []).append((name, prob))
    if largest_group(df, by) * len(columns) <= max_group_values:
        # one buffer per column, whatever the number of its probabilities
        exact = [
            F.percentile(column, F.array(*[F.lit(prob) for _, prob in wanted])).alias(f"_p{i}")
            for i, (column, wanted) in enumerate(columns.items())
        ]
        solved = df.groupBy(*by).agg(*exact) if by else df.agg(*exact)
        picked = [
            F.col(f"_p{i}")[k].alias(name)
            for i, wanted in enumerate(columns.values())
            for k, (name, _) in enumerate(wanted)
        ]
        return solved.select(*by, *picked)
    names = list(outputs)
    passes = [names[i : i + OUTPUTS_PER_PASS] for i in range(0, len(names), OUTPUTS_PER_PASS)]
    found = [select_quantiles(df, {name: outputs[name] for name in part}, by, accuracy) for part in passes]
    return functools.reduce(lambda a, b: _attach(a, b, by), found)


def _attach(df: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    # without keys the group side is a single aggregate row
    return df.join(groups, list(by), "left") if by else df.join(F.broadcast(groups))


def select_quantiles(
    df: DataFrame,
    outputs: Mapping[str, tuple[str, float]],
    by: Sequence[str] = (),
    accuracy: int = ACCURACY,
) -> DataFrame:
    names = list(outputs)
    slack = 2.0 / accuracy

    def bracket(column: str, prob: float) -> list[Column]:
        # a sketch quantile is off by at most 1/accuracy of the group; below
        # accuracy rows that is less than one row, and the whole group is taken
        few = F.count(column) <= accuracy

        def edge(p: float, end: Column) -> Column:
            if not 0.0 < p < 1.0:
                return end
            return F.when(few, end).otherwise(F.percentile_approx(column, F.lit(p), F.lit(accuracy)))

        return [edge(prob - slack, F.min(column)), edge(prob + slack, F.max(column))]

    sketch: list[Column] = []
    for i, name in enumerate(names):
        column, prob = outputs[name]
        low, high = bracket(column, prob)
        sketch += [low.alias(f"_lo{i}"), high.alias(f"_hi{i}")]
    source = df.select(*by, *sorted({column for column, _ in outputs.values()}))
    edges = source.groupBy(*by).agg(*sketch) if by else source.agg(*sketch)
    rows = _attach(source, edges, by)

    counts: list[Column] = []
    for i, name in enumerate(names):
        x = F.col(outputs[name][0])
        counts += [
            F.count(x).alias(f"_n{i}"),
            F.count_if(x < F.col(f"_lo{i}")).alias(f"_below{i}"),
            F.count_if(x == F.col(f"_lo{i}")).alias(f"_at_lo{i}"),
            F.count_if((x > F.col(f"_lo{i}")) & (x < F.col(f"_hi{i}"))).alias(f"_in{i}"),
        ]
    counted = rows.groupBy(*by).agg(*counts) if by else rows.agg(*counts)

    inside = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.col(outputs[name][0]).cast("double").alias("x"),
                F.col(f"_lo{i}").cast("double").alias("lo"),
                F.col(f"_hi{i}").cast("double").alias("hi"),
            )
            for i, name in enumerate(names)
        ]
    )
    order = Window.partitionBy(*by, "i").orderBy("x")
    ranked = (
        rows.select(*by, F.inline(F.filter(inside, lambda e: (e.x > e.lo) & (e.x < e.hi))))
        .select(*by, "i", "x", F.row_number().over(order).alias("_rank"))
    )

    # per group and output: which ranks are wanted, and where they fall
    wanted = _attach(counted, edges, by).select(
        *by,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("i"),
                        ((F.col(f"_n{i}") - 1) * F.lit(outputs[name][1])).alias("_at"),
                        F.col(f"_below{i}").alias("_below"),
                        F.col(f"_at_lo{i}").alias("_at_lo"),
                        F.col(f"_in{i}").alias("_in"),
                        F.col(f"_lo{i}").cast("double").alias("_lo"),
                        F.col(f"_hi{i}").cast("double").alias("_hi"),
                    )
                    for i, name in enumerate(names)
                ]
            )
        ),
    )
    wanted = wanted.withColumn("_floor", F.floor("_at")).withColumn("_ceil", F.ceil("_at"))
    first_in = F.col("_below") + F.col("_at_lo")
    ends = (
        wanted.withColumn("_end", F.explode(F.array(F.lit("f"), F.lit("c"))))
        .withColumn("_target", F.when(F.col("_end") == "f", F.col("_floor")).otherwise(F.col("_ceil")))
        .withColumn("_rank", F.col("_target") - first_in + 1)
    )
    hit = ends.join(ranked, [*by, "i", "_rank"], "left")
    value = (
        F.when(F.col("_target") < F.col("_below"), F.raise_error(F.lit("quantile bracket missed")))
        .when(F.col("_rank") < 1, F.col("_lo"))
        .when(F.col("_rank") <= F.col("_in"), F.col("x"))
        .otherwise(F.col("_hi"))
    )
    part = F.col("_at") - F.col("_floor")
    solved = (
        hit.withColumn("_v", value)
        .groupBy(*by, "i")
        .agg(
            F.max(F.when(F.col("_end") == "f", F.col("_v"))).alias("_vf"),
            F.max(F.when(F.col("_end") == "c", F.col("_v"))).alias("_vc"),
            F.first(part).alias("_part"),
        )
        .withColumn("_q", F.col("_vf") + (F.col("_vc") - F.col("_vf")) * F.col("_part"))
    )
    final = [F.max(F.when(F.col("i") == i, F.col("_q"))).alias(name) for i, name in enumerate(names)]
    return solved.groupBy(*by).agg(*final) if by else solved.agg(*final)
