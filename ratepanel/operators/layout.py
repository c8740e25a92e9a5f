"""How a panel is laid out for windows.

A *series* is the rows of one key in date order. Two layouts exist:

* whole series: one window partition per key. Used when the date column is a
  calendar date, because a panel holds one row per key and date, so a series
  cannot outgrow the calendar.
* split series: keys with more than ``rows_per_block`` rows are cut into
  date-contiguous blocks, and each block also receives the ``halo`` rows before
  it. Windows with a bounded reach then give the same values in every block;
  the halo rows are dropped at the end. Keys below the limit stay whole.

Which slices of time go to which block is worked out from a histogram of
(key, slice) counts, so the rows themselves are shuffled once, by
(key, block).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from ratepanel.session import settle

ROWS_PER_BLOCK = 1_000_000
# A slice of one key is bounded by the time units it holds, and so is the number
# of slices of a key: a century has 0.6 million slices of days and 53 million
# of minutes.
SLICE_DAYS = 64
SLICE_SECONDS = 60

BLOCK = "_block"
OWN = "_own"
SLICE = "_slice"


def is_calendar(df: DataFrame, date: str) -> bool:
    return isinstance(df.schema[date].dataType, T.DateType)


def time_slice(df: DataFrame, date: str) -> Column:
    """Order-preserving slice number; free of the session time zone."""
    days = F.unix_date(F.col(date).cast("date")).cast("long")
    if is_calendar(df, date):
        return F.floor(days / SLICE_DAYS)
    clock = F.hour(date) * 3600 + F.minute(date) * 60 + F.floor(F.second(date))
    return F.floor((days * 86400 + clock) / SLICE_SECONDS)


@dataclass(frozen=True)
class Series:
    """Window specs over the laid-out frame."""

    key: str
    date: str
    split: bool = False

    @property
    def parts(self) -> list[str]:
        return [self.key, BLOCK] if self.split else [self.key]

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.parts).orderBy(self.date)

    def last(self, n: int) -> WindowSpec:
        """The current row and the ``n - 1`` rows before it."""
        return self.ordered().rowsBetween(-(n - 1), Window.currentRow)

    def so_far(self) -> WindowSpec:
        return self.ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def own(self) -> Column:
        return F.col(OWN) if self.split else F.lit(True)

    def close(self, df: DataFrame) -> DataFrame:
        """Drop halo rows and helper columns."""
        if self.split:
            df = df.where(F.col(OWN)).drop(BLOCK, OWN)
        return df


def open_series(
    df: DataFrame,
    halo: int,
    key: str = "key",
    date: str = "date",
    rows_per_block: int | None = None,
) -> tuple[Series, DataFrame]:
    """Lay ``df`` out for windows that look back at most ``halo`` rows.

    ``rows_per_block`` forces a split; left out, calendar-date panels stay
    whole and all others are split at ``ROWS_PER_BLOCK``.
    """
    if rows_per_block is None:
        if is_calendar(df, date):
            return Series(key, date), df
        rows_per_block = ROWS_PER_BLOCK
    df = df.withColumn(SLICE, time_slice(df, date))
    per_key = Window.partitionBy(key)
    earlier = per_key.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    hot = (
        df.groupBy(key, SLICE)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(key, SLICE, "_n", first.alias("_first"), F.sum("_n").over(per_key).alias("_key_rows"))
        .where(F.col("_key_rows") > rows_per_block)
        .select(
            key,
            SLICE,
            F.floor(F.col("_first") / rows_per_block).alias("_home"),
            F.floor((F.col("_first") + F.col("_n") - 1 + halo) / rows_per_block).alias("_reach"),
        )
    )
    blocks = F.coalesce(F.sequence("_home", "_reach"), F.array(F.lit(0).cast("long")))
    df = (
        df.join(hot, [key, SLICE], "left")
        .withColumn(BLOCK, F.explode(blocks))
        .withColumn(OWN, F.coalesce(F.col(BLOCK) == F.col("_home"), F.lit(True)))
        .drop(SLICE, "_home", "_reach")
    )
    return Series(key, date, split=True), df


def running_sum(s: Series, df: DataFrame, value: str, out: str) -> DataFrame:
    """Sum from the start of the series; block totals carry across blocks."""
    df = df.withColumn(out, F.sum(F.when(s.own(), F.col(value))).over(s.so_far()))
    if not s.split:
        return df
    totals = df.where(OWN).groupBy(s.key, BLOCK).agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(s.key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(s.key, BLOCK, F.sum("_total").over(earlier).alias("_carry"))
    return (
        df.join(carry, [s.key, BLOCK], "left")
        .withColumn(out, F.col(out) + F.coalesce("_carry", F.lit(0.0)))
        .drop("_carry")
    )


def fill_forward(s: Series, df: DataFrame, columns: Sequence[str], head: bool = False) -> DataFrame:
    """Last non-null value of the series up to this row.

    ``head`` gives the rows before the first value that first value.
    """
    seen = {c: F.last(c, ignorenulls=True).over(s.so_far()) for c in columns}
    if not s.split:
        if head:
            whole = s.ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            seen = {c: F.coalesce(v, F.first(c, ignorenulls=True).over(whole)) for c, v in seen.items()}
        return df.withColumns(seen)
    # the newest and oldest value of every block, then of the blocks around it
    when = {c: F.when(F.col(c).isNotNull(), F.col(s.date)) for c in columns}
    ends = [F.max_by(c, when[c]).alias(f"_new_{c}") for c in columns]
    ends += [F.min_by(c, when[c]).alias(f"_old_{c}") for c in columns] if head else []
    per_key = Window.partitionBy(s.key).orderBy(BLOCK)
    earlier = per_key.rowsBetween(Window.unboundedPreceding, -1)
    whole = per_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = {c: F.last(f"_new_{c}", ignorenulls=True).over(earlier) for c in columns}
    if head:
        carried = {c: F.coalesce(v, F.first(f"_old_{c}", ignorenulls=True).over(whole)) for c, v in carried.items()}
    blocks = df.where(OWN).groupBy(s.key, BLOCK).agg(*ends)
    carry = blocks.select(s.key, BLOCK, *[v.alias(f"_carry_{c}") for c, v in carried.items()])
    df = df.withColumns(seen).join(carry, [s.key, BLOCK], "left")
    df = df.withColumns({c: F.coalesce(c, f"_carry_{c}") for c in columns})
    return df.drop(*[f"_carry_{c}" for c in columns])


# --- positions in a total order --------------------------------------------


def with_rank(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Zero-based row number in the total order of ``order``.

    Rows are range-partitioned, so no task sees all of them and no key is too
    large; a row's number is its place in its range plus the sizes of the
    ranges before. The ranged frame is settled first, because both are taken
    from it and must see the same ranges.
    """
    row = F.monotonically_increasing_id()
    ranged = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", row))
    # the id holds the partition above bit 33 and the place in it below
    ranged = ranged.withColumn("_part", F.shiftright("_row", 33)).withColumn("_at", F.col("_row") % (1 << 33))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range partition
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    placed = ranged.join(F.broadcast(base), "_part")
    return placed.withColumn(out, F.col("_base") + F.col("_at")).select(*df.columns, out)


def with_position(
    df: DataFrame,
    key: str = "key",
    date: str = "date",
    position: str = "pos",
    in_key: str | None = None,
) -> DataFrame:
    """Zero-based position in (key, date) order over all rows.

    ``in_key`` names a second column for the position inside the key.
    """
    placed = with_rank(df, [key, date], position)
    if in_key is None:
        return placed
    starts = placed.groupBy(key).agg(F.min(position).alias("_start"))
    return placed.join(starts, key).withColumn(in_key, F.col(position) - F.col("_start")).drop("_start")


def position_blocks(df: DataFrame, position: str, halo: int, rows_per_block: int) -> DataFrame:
    """Cut a positioned frame into blocks; the last ``halo`` rows of a block
    are copied into the block after it and marked as not its own there."""
    home = F.floor(F.col(position) / rows_per_block)
    reach = F.floor((F.col(position) + halo) / rows_per_block)
    return df.withColumn(BLOCK, F.explode(F.sequence(home, reach))).withColumn(OWN, F.col(BLOCK) == home)
