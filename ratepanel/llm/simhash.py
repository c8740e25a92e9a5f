"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into segments. If two fingerprints differ in at most
``distance`` bits, one of ``m`` segments differs in at most ``distance // m`` bits.
Each distinct fingerprint stands in the table of each segment under its own value
and looks up every value in a small Hamming ball around it; fingerprints that meet
under a value are compared over all 64 bits. Two segments with balls of one bit
(33 look-ups each) keep chance meetings rare up to billions of fingerprints.

Work is done on distinct fingerprints, so copies never multiply. Within a meeting
place linked sets are emitted as stars, never as all pairs; places with
more than ``crowd`` fingerprints are divided by parts of the other bits, one of
which must be equal. Components are found by star contraction, written out each round.

Defined results: null and empty texts have fingerprint zero and are linked like any
other; a component's id is its smallest doc_id, null if it has none; repeated rows
get the same values each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratepanel.llm.common import byte_texts, chunks, identified, without
from ratepanel.session import settle

BITS = 64
SEED = 42
PIECE = 50_000
CROWD = 50_000


def _hashes(words: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, in pieces of bounded length."""
    if not words:
        return
    if len(words) < shingle:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
        return
    digest, total = xxhash.xxh64_intdigest, len(words) - shingle + 1
    for start in range(0, total, PIECE):
        part = words[start : min(start + PIECE, total) + shingle - 1]
        rows = map(b" ".join, zip(*(part[i:] for i in range(shingle))))
        yield np.fromiter((digest(x, SEED) for x in rows), dtype=np.uint64, count=len(part) - shingle + 1)


def _bit_sums(hashes: np.ndarray, starts: list[int]) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def fingerprints(texts: Iterator[bytes], shingle: int) -> np.ndarray:
    """One unsigned 64-bit fingerprint for each text."""
    sums: list[np.ndarray] = []
    totals: list[int] = []
    waiting: list[np.ndarray] = []
    owners: list[int] = []

    def flush() -> None:
        if waiting:
            starts = np.cumsum([0] + [len(h) for h in waiting[:-1]])
            for owner, row in zip(owners, _bit_sums(np.concatenate(waiting), starts)):
                sums[owner] += row
            waiting.clear()
            owners.clear()

    held = 0
    for text in texts:
        sums.append(np.zeros(BITS, dtype=np.int64))
        totals.append(0)
        for hashes in _hashes(text.lower().split(), shingle):
            waiting.append(hashes)
            owners.append(len(sums) - 1)
            totals[-1] += len(hashes)
            held += len(hashes)
            if held >= PIECE:
                flush()
                held = 0
    flush()
    if not sums:
        return np.zeros(0, dtype=np.uint64)
    ones = np.array(sums) * 2 > np.array(totals)[:, None]
    return np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()


def with_fingerprint(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, text_hash, fp`` for each row of ``docs``; ``fp`` is signed."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        batch = pa.record_batch([texts], ["text"])
        found = [fingerprints(byte_texts(c.column(0)), shingle) for c in chunks(batch)]
        return pa.array(np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64), pa.int64())

    return identified(docs, run(F.col("text")).alias("fp"))


def hexadecimal(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def _balls(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(width), k)]


def _cut(value: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _spans(low: int, high: int, parts: int) -> list[tuple[int, int]]:
    edges = [low + (high - low) * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _looked_up(fps: DataFrame, distance: int, segments: int, crowd: int) -> DataFrame:
    """``key, home, fp``: each fingerprint at its own values and at those around them."""
    fp = F.col("fp")
    tables, homes = [], []
    for number, (low, width) in enumerate(_spans(0, BITS, segments)):
        masks = F.array(*[F.lit(m).cast("long") for m in _balls(width, distance // segments)])
        value = _cut(fp, low, width)
        seen = F.transform(masks, value.bitwiseXOR)
        tables.append(
            fps.select(F.lit(number).alias("segment"), "fp", F.posexplode(seen).alias("probe", "value")).select(
                "segment", "value", (F.col("probe") == 0).alias("home"), "fp"
            )
        )
        homes.append(fps.select(F.lit(number).alias("segment"), value.alias("value")))
    entries, own = tables[0], homes[0]
    for table, home in zip(tables[1:], homes[1:]):
        entries, own = entries.unionByName(table), own.unionByName(home)
    crowded = settle(own.groupBy("segment", "value").count().where(F.col("count") > crowd).drop("count"))
    plain = F.array(F.lit(-1).cast("long"))
    if crowded.isEmpty():
        entries = entries.withColumn("part", F.lit(-1).cast("long"))
    else:
        # The other bits differ in at most ``distance``, so one of distance + 1 parts of them is equal.
        other = F.lit(None)
        for number, (low, width) in enumerate(_spans(0, BITS, segments)):
            outside = [s for s in (_spans(0, low, 1) if low else []) + (_spans(low + width, BITS, 1) if low + width < BITS else [])]
            parts = [p for a, w in outside for p in _spans(a, a + w, distance + 1)]
            values = F.array(*[F.xxhash64(F.lit(i), _cut(fp, a, w)) for i, (a, w) in enumerate(parts)])
            other = F.when(F.col("segment") == number, values).otherwise(other)
        entries = (
            entries.join(crowded.withColumn("crowded", F.lit(True)), ["segment", "value"], "left")
            .withColumn("part", F.explode(F.when(F.col("crowded"), other).otherwise(plain)))
            .drop("crowded")
        )
    return entries.select(F.xxhash64("segment", "value", "part").alias("key"), "home", "fp")


def stars(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """For each set that links of at most ``distance`` bits connect, its smallest member with every other."""
    pairs = []
    left = np.unique(fps)
    while left.size > 1:
        low, left = left[0], left[1:]
        reached = [low]
        while reached and left.size:
            near = np.bitwise_count(left ^ reached.pop()) <= distance
            if near.any():
                found = left[near]
                pairs.extend((low, member) for member in found)
                reached.extend(found)
                left = left[~near]
    return pairs


def find_links(fps: DataFrame, distance: int = 3, segments: int = 2, crowd: int = CROWD) -> DataFrame:
    """``a, b``: pairs that connect what links of at most ``distance`` bits between the distinct ``fp`` connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(keys: np.ndarray, home: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            pairs: list[tuple[int, int]] = []
            for at in np.flatnonzero((sizes > 1) & np.logical_or.reduceat(home, starts)):
                pairs += stars(fp[starts[at] : starts[at] + sizes[at]], distance)
            ends = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.record_batch([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = (
                batch.column(0).to_numpy(),
                batch.column(1).to_numpy(zero_copy_only=False),
                batch.column(2).to_numpy().view(np.uint64),
            )
            first = int(np.searchsorted(now[0], now[0][-1]))  # where the last key begins
            if first:
                whole = [np.concatenate(p) for p in zip(*held, tuple(x[:first] for x in now))]
                yield linked(*whole)
                held = []
            elif held and held[-1][0][-1] != now[0][0]:
                yield linked(*[np.concatenate(p) for p in zip(*held)])
                held = []
            held.append(tuple(x[first:] for x in now))
        if held:
            yield linked(*[np.concatenate(p) for p in zip(*held)])

    entries = _looked_up(fps, distance, segments, crowd)
    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``; the root is the smallest reached.

    Large-star and small-star contraction by turns: edges move to the smallest
    neighbour until every component is a star. The edges are written each round.
    """
    a, b = F.col("a"), F.col("b")
    edges = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(a != b).distinct())
    mark = None
    while True:
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 999_983)).first()
        if tuple(found) == mark or not found[0]:
            return edges.select(a.alias("node"), b.alias("root")).unionByName(
                edges.select(b.alias("node"), b.alias("root")).distinct()
            )
        mark = tuple(found)
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where(b != F.col("low")).select(b.alias("a"), F.col("low").alias("b"))
        edges = settle(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, crowd: int = CROWD) -> DataFrame:
    """``doc_id, text_hash, fp, component_id`` for each row of ``docs``."""
    marked = settle(with_fingerprint(docs, shingle))
    classes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = settle(components(find_links(classes.select("fp"), distance, crowd=crowd)))
    joined = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    lows = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = joined.join(lows, "root").select("fp", "component_id", "root")
    return marked.join(labels, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """The document of each group with the smallest doc_id; of its repeats, one row."""
    found = settle(near_duplicates(docs, shingle, distance))
    named = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    rows = found.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    first = found.groupBy("root").agg(F.min(named).alias("first"))
    ranked = settle(rows.join(first, "root").withColumn("wins", named.eqNullSafe(F.col("first"))))
    repeated = ranked.where(F.col("wins") & (F.col("n") > 1))
    if repeated.isEmpty():
        return without(docs, ranked.where(~F.col("wins")))
    once = without(docs, repeated, "left_semi").dropDuplicates(["doc_id", "text"])
    return without(docs, ranked.where(~F.col("wins") | (F.col("n") > 1))).unionByName(once)
