"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions.

Every document of a source has the same expected number of copies, target over source
size. Its whole part is taken outright. The fraction is rounded in pairs: words move at
random from one document's expectation to the other's until one of them is a whole
document or none, so the words a source takes stay what they were while each
expectation is kept. Documents are rounded in buckets of about ``BUCKET``; what a bucket
leaves undecided, one document at most, goes into the next level's buckets, and so on
to one document a source, which is rounded to the nearer side. A source hence misses its
target by half of one document at most.

All randomness is a hash of the documents' ids and texts and a seed, and buckets are
sorted, so reruns agree whatever the partitions.

Defined results: null texts have size 0; documents of size 0 take no words and are
kept out of the rounding; a null source is a source, the last one; rows equal in doc_id,
text and source are rounded as one and their copies dealt among them. The list of
sources with their totals passes through one task, no rows do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratepanel.llm.common import WORD, text_key, unused
from ratepanel.session import settle

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BUCKET = 128
SEED = 17

KEY = ("doc_id", "text_hash", "source")


def n_words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, n, source_size, target`` from ``source, size, n``.

    Sources in code point order take the weights by turns. The target is ``level *
    weight``, but ``most`` times the source's size where that is less; the level is
    such that the targets add up to ``share`` of all sizes.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = totals.withColumn(
        "weight",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1),
    ).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    room = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    leveled = weighed.withColumn("level", rest / room)
    # Sources stop in the order of the level at which they stop, so those above it come first.
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    level = F.first(free, ignorenulls=True).over(whole)
    return leveled.withColumn("common", level).select(
        "source",
        "n",
        "source_size",
        F.coalesce(F.least(F.col("common") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"),
    )


def _chance(*keys: Column, seed: int) -> Column:
    return (F.xxhash64(*keys, F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1).cast("long")) + F.lit(0.5)) / F.lit(float(1 << 52))


def _sequential(items: Column, seed: int) -> Column:
    """Rounds a bucket's items one after the other: those decided, and the one left over."""

    def decided(item: Column, taken: bool) -> Column:
        return F.struct(*[item[c].alias(c) for c in (*KEY, "size", "rows", "copies")], F.lit(taken).alias("taken"))

    def moved(item: Column, mass: Column) -> Column:
        return item.withField("mass", mass)

    def pair(state: Column, other: Column) -> Column:
        held = state["held"]
        lacks, other_lacks = held["size"] - held["mass"], other["size"] - other["mass"]
        up, down = F.least(lacks, other["mass"]), F.least(held["mass"], other_lacks)
        chance = _chance(*[held[c] for c in KEY], *[other[c] for c in KEY], seed=seed)
        rises = chance * (up + down) < down
        case = (
            F.when(rises & (lacks <= other["mass"]), F.lit(0))
            .when(rises, F.lit(1))
            .when(held["mass"] <= other_lacks, F.lit(2))
            .otherwise(F.lit(3))
        )
        out = (
            F.when(case == 0, decided(held, True))
            .when(case == 1, decided(other, False))
            .when(case == 2, decided(held, False))
            .otherwise(decided(other, True))
        )
        stays = (
            F.when(case == 0, moved(other, other["mass"] - lacks))
            .when(case == 1, moved(held, held["mass"] + other["mass"]))
            .when(case == 2, moved(other, other["mass"] + held["mass"]))
            .otherwise(moved(held, held["mass"] - other_lacks))
        )
        return F.struct(F.concat(state["done"], F.array(out)).alias("done"), stays.alias("held"))

    first = items[0]
    start = F.struct(F.slice(F.array(decided(first, False)), 1, 0).alias("done"), first.alias("held"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, pair)


def rounded(items: DataFrame, bucket: int = BUCKET, seed: int = SEED) -> DataFrame:
    """``*KEY, size, rows, copies``: the copies all rows of an item get together.

    ``items`` has the key, ``size``, ``rows``, ``expected`` (copies of each row) and ``n``,
    the items of the source.
    """
    total = F.col("rows") * F.col("expected")
    items = items.withColumn("copies", F.floor(total)).withColumn("mass", (total - F.col("copies")) * F.col("size"))
    open_ = (F.col("size") > 0) & (F.col("mass") > 0)
    result = [*KEY, "size", "rows", "copies"]
    done = items.where(~open_).select(*result)
    buckets = F.ceil(F.col("n") / F.lit(bucket))
    level = items.where(open_).withColumn("bucket", F.pmod(F.xxhash64(F.col("doc_id"), F.col("text_hash"), F.lit(seed)), buckets))
    element = F.struct(
        (-F.col("size")).alias("order"),
        F.xxhash64(F.col("doc_id"), F.col("text_hash"), F.lit(seed + 1)).alias("tie"),
        *[F.col(c) for c in (*KEY, "size", "rows", "copies", "mass")],
    )
    depth = 0
    while True:
        # Large documents are rounded first, so that what is left over tends to be small.
        state = (
            level.groupBy("source", "bucket")
            .agg(F.array_sort(F.collect_list(element)).alias("items"))
            .select("bucket", _sequential(F.col("items"), seed + 2 + depth).alias("state"))
        )
        state = settle(state)
        decided = state.select(F.explode("state.done").alias("d")).select(
            *[F.col(f"d.{c}") for c in (*KEY, "size", "rows")],
            (F.col("d.copies") + F.col("d.taken").cast("long")).alias("copies"),
        )
        done = done.unionByName(decided)
        left = state.select("bucket", "state.held.*")
        last = left.agg(F.max("bucket")).first()[0]
        if not last:
            taken = (F.col("mass") * 2 >= F.col("size")).cast("long")
            return done.unionByName(left.withColumn("copies", F.col("copies") + taken).select(*result))
        level = left.withColumn("bucket", F.floor(F.col("bucket") / F.lit(bucket)))
        depth += 1


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    bucket: int = BUCKET,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """Items with their copies, and the sources with their targets."""
    rows = docs.select("doc_id", text_key().alias("text_hash"), "source", n_words().alias("size"))
    items = settle(rows.groupBy(*KEY, "size").agg(F.count(F.lit(1)).alias("rows")))
    goals = settle(
        targets(items.select("source", (F.col("size") * F.col("rows")).alias("size"), F.lit(1).alias("n")), weights, share, most)
    )
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shares = goals.select(F.col("source").alias("_source"), "n", expected.alias("expected"))
    joined = items.join(shares, items["source"].eqNullSafe(shares["_source"])).drop("_source")
    return rounded(joined, bucket, seed), goals


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for each row of ``docs``."""
    items, goals = mix(docs, **options)
    shares = goals.select(F.col("source").alias("_source"), "source_size", "target")
    joined = items.join(shares, items["source"].eqNullSafe(shares["_source"]))
    place = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("place")
    dealt = F.floor(F.col("copies") / F.col("rows")) + (F.col("place") <= F.col("copies") % F.col("rows")).cast("long")
    return joined.select("*", place).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * dealt).alias("taken"), dealt.alias("copies")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    items, _ = mix(docs, **options)
    # Documents without words count neither for nor against a target, and stay as they are.
    chosen = items.select(
        F.col("doc_id").alias("_id"),
        F.col("text_hash").alias("_hash"),
        F.col("source").alias("_source"),
        F.col("rows").alias("_rows"),
        F.when(F.col("size") > 0, F.col("copies")).otherwise(F.col("rows")).alias("_copies"),
    ).where(F.col("_copies") > 0)
    chosen = settle(chosen)
    same = (
        docs["doc_id"].eqNullSafe(chosen["_id"])
        & (F.xxhash64(docs["text"]) == chosen["_hash"])
        & docs["source"].eqNullSafe(chosen["_source"])
    )
    found = docs.join(chosen, same)
    copies = F.col("_copies")
    if not chosen.where(F.col("_rows") > 1).isEmpty():
        place = unused(docs, "_place")
        repeats = Window.partitionBy("_id", "_hash", "_source").orderBy(*[docs[c] for c in docs.columns])
        found = found.withColumn(place, F.row_number().over(repeats))
        copies = F.floor(copies / F.col("_rows")) + (F.col(place) <= copies % F.col("_rows")).cast("long")
    again = F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)).otherwise(F.array().cast("array<bigint>")))
    return found.select(*[docs[c] for c in docs.columns], again.alias(unused(docs, "_copy"))).select(*docs.columns)
