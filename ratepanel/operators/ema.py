"""Exponential moving averages as ordinary windows.

With ``q = 1 - alpha`` the average started at the first row of a run of rows
has the closed form ``q^j * sum(u_i * q^-i)``, a running sum. The run is kept
so short that ``q^-i`` stays in range, and so long that ``q`` to its length is
below double precision: then all that matters from earlier runs is the value at
the end of the run before. So one running sum per run plus one fill-forward
give the recursive average for a series of any length, and a split series needs
a halo of one run only.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratepanel.operators.layout import Series, open_series

# Weight below which older rows cannot change a double.
NEGLIGIBLE = 1e-18
# exp() of this is still a finite double with room to spare for the values.
MAX_EXPONENT = 600.0

ROW = "_rn"


def decay(span: int) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def memory(span: int) -> int:
    """Rows after which a starting value no longer counts."""
    q = decay(span)
    return 1 if q <= 0 else math.ceil(math.log(NEGLIGIBLE) / math.log(q))


def run_lengths(spans: Iterable[int]) -> dict[int, int]:
    """Run length per span; spans share one as far as doubles allow, since
    every length of its own costs a sort."""
    lengths: dict[int, int] = {}
    length = 0
    for span in sorted({s for s in spans if s > 1}, reverse=True):
        if not length or length * -math.log(decay(span)) > MAX_EXPONENT:
            length = memory(span)
        lengths[span] = length
    return lengths


def number_rows(df: DataFrame, s: Series) -> DataFrame:
    return df.withColumn(ROW, F.row_number().over(s.ordered()) - 1)


def ema_columns(
    df: DataFrame,
    s: Series,
    value: str,
    spans: Mapping[str, int],
    lengths: Mapping[int, int] | None = None,
    seeds: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add one average per entry of ``spans`` (output name -> span).

    Needs ``number_rows`` first. ``lengths`` carries the run lengths over from
    an earlier call, so that both share a sort. ``seeds`` maps an output name
    to a column with the average reached before the first row, for series that
    are continued.
    """
    lengths = lengths or run_lengths(spans.values())
    seeds = seeds or {}
    p = F.col(value)
    df = df.withColumns({name: p for name, span in spans.items() if span == 1})
    for length in sorted({lengths[span] for span in spans.values() if span > 1}, reverse=True):
        names = [name for name, span in spans.items() if span > 1 and lengths[span] == length]
        run = f"_run{length}"
        if run not in df.columns:
            df = df.withColumn(run, F.floor(F.col(ROW) / length))
        j = F.col(ROW) % length
        in_run = (
            Window.partitionBy(*s.parts, run)
            .orderBy(s.date)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        # (run, date) order is date order; written so, both windows share a sort
        earlier = (
            Window.partitionBy(*s.parts)
            .orderBy(run, s.date)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        local: dict[str, Column] = {}
        for name in names:
            q = decay(spans[name])
            start = F.col(ROW) == 0
            if name in seeds:
                start = start & F.col(seeds[name]).isNull()
            u = F.when(start, p).otherwise(p * (1.0 - q))
            local[f"_loc_{name}"] = F.pow(F.lit(q), j) * F.sum(u * F.pow(F.lit(q), -j)).over(in_run)
        df = df.withColumns(local)
        ends = {
            f"_end_{name}": F.last(F.when(j == length - 1, F.col(f"_loc_{name}")), ignorenulls=True).over(earlier)
            for name in names
        }
        df = df.withColumns(ends)
        out: dict[str, Column] = {}
        for name in names:
            q = decay(spans[name])
            carry = F.coalesce(f"_end_{name}", F.lit(0.0)) * F.pow(F.lit(q), j + 1)
            out[name] = F.col(f"_loc_{name}") + carry
            if name in seeds:
                seed = F.coalesce(seeds[name], F.lit(0.0)) * F.pow(F.lit(q), F.col(ROW) + 1)
                out[name] = out[name] + seed
        df = df.withColumns(out).drop(*local, *ends)
    return df


def ema(
    df: DataFrame,
    value: str,
    spans: Mapping[str, int],
    key: str = "key",
    date: str = "date",
    rows_per_block: int | None = None,
) -> DataFrame:
    """Exponential averages of ``value`` for every series."""
    halo = max(memory(span) for span in spans.values())
    columns = df.columns
    s, df = open_series(df, halo, key, date, rows_per_block)
    df = ema_columns(number_rows(df, s), s, value, spans)
    return s.close(df).select(*columns, *spans)
