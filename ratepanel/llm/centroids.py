"""Centroid clustering by Shallot search.

Lloyd's rounds over integer vectors, exact in every assignment. A vector remembers its
nearest and second-nearest centroid and bounds on its distance to the nearest and to all others.
In a round the bounds are loosened by how far centroids moved; while the upper one stays under the lower
one, or under half the way to the next centroid, nothing is computed. Otherwise the
search starts from the closer one of the two remembered centroids and walks through that one's
neighbours in order of distance. No centroid beyond the distance to the start plus the second-best
distance so far can be among the two nearest, so the ball shrinks as better ones turn up. What
is left is compared by integer squared distances, ties to the smaller number.

Bounds are doubles with a margin far above their rounding, so they only ever spare work.
Each round's vectors with their bounds are a table in the shared folder. Sums per
centroid and component are added in the tasks, then by Spark; the driver holds centroids, never
vectors. No row is shuffled, so repeated vectors cannot crowd a task.

Defined results: vectors that are null, of another width, or hold nulls or non-finite
components take no part. Repeated rows count, and are answered, each; a row without an id is
clustered, and starts a centroid only if too few others can. Starts with equal hashes are taken in the order of
their components. With fewer vectors than centroids there are as many centroids as vectors.
Components, distances and inertias beyond 64 bits stop at the limit; further columns are left out.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratepanel.llm.topk import integers, usable
from ratepanel.session import settle

MOST = 2**63 - 1
# Up to this size a squared difference of 64 components stays within 64 bits.
SMALL = 2**27
MARGIN = 1e-9


@dataclass
class Search:
    """Centroids with what a search needs: their neighbours in order and how far they moved."""

    centroids: list[list[int]]
    moved: np.ndarray

    def __post_init__(self) -> None:
        k = len(self.centroids)
        self.apart = np.array([[_distance(a, b) for b in self.centroids] for a in self.centroids]).reshape(k, k)
        self.order = np.argsort(self.apart, axis=1, kind="stable")
        others = self.apart + np.where(np.eye(k, dtype=bool), np.inf, 0.0)
        self.half = others.min(axis=1) / 2 if k > 1 else np.full(k, np.inf)
        # the farthest move of any other centroid
        self.others = np.array([max((m for j, m in enumerate(self.moved) if j != i), default=0.0) for i in range(k)])
        self.large = [max((abs(x) for x in c), default=0) > SMALL for c in self.centroids]

    def squared(self, rows: np.ndarray, number: int) -> np.ndarray:
        """Exact squared distances of ``rows`` to a centroid."""
        if rows.dtype == object or self.large[number]:
            gap = rows.astype(object) - np.array(self.centroids[number], dtype=object)
        else:
            gap = rows - np.array(self.centroids[number], dtype=np.int64)
        return (gap * gap).sum(axis=1) if rows.shape[1] else np.zeros(len(rows), dtype=np.int64)

    def to_each(self, rows: np.ndarray, numbers: np.ndarray, kind: type) -> np.ndarray:
        out = np.zeros(len(rows), dtype=kind)
        for number in np.unique(numbers):
            mine = numbers == number
            out[mine] = self.squared(rows[mine], number)
        return out

    def assign(
        self, rows: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The new nearest and second-nearest centroids, and bounds."""
        near, second = near.copy(), second.copy()
        upper, lower = upper + self.moved[near], lower - self.others[near]
        safe = np.maximum(lower, self.half[near])
        at = np.flatnonzero(~(upper * (1 + MARGIN) < safe * (1 - MARGIN)))
        kind = object if rows.dtype == object or any(self.large) else np.int64
        own = self.to_each(rows[at], near[at], kind)
        upper[at] = _roots(own)
        far = ~(upper[at] * (1 + MARGIN) < safe[at] * (1 - MARGIN))
        at, own = at[far], own[far]
        if not len(at):
            return near, second, upper, lower
        if len(self.centroids) == 1:
            lower[at] = np.inf
            return near, second, upper, lower
        part, first, other = rows[at], near[at], second[at]
        rest = self.to_each(part, other, kind)
        closer = (rest < own) | ((rest == own) & (other < first))
        start, runner = np.where(closer, other, first), np.where(closer, first, other)
        best, next_best = np.where(closer, rest, own), np.where(closer, own, rest)
        reach, found, then = _roots(best), start.copy(), runner.copy()
        active = np.ones(len(at), dtype=bool)
        for place in range(1, len(self.centroids)):
            number = self.order[start, place]
            ball = (reach + _roots(next_best)) * (1 + MARGIN)
            active &= self.apart[start, number] <= ball
            todo = np.flatnonzero(active & (number != runner))
            if not active.any():
                break
            value = self.to_each(part[todo], number[todo], kind)
            new = number[todo]
            wins = (value < best[todo]) | ((value == best[todo]) & (new < found[todo]))
            lead, behind = todo[wins], todo[~wins & (value < next_best[todo])]
            next_best[lead], then[lead] = best[lead], found[lead]
            best[lead], found[lead] = value[wins], new[wins]
            between = ~wins & (value < next_best[todo])
            next_best[behind], then[behind] = value[between], new[between]
        near[at], second[at] = found, then
        upper[at], lower[at] = _roots(best), _roots(next_best)
        return near, second, upper, lower


def _distance(a: list[int], b: list[int]) -> float:
    return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    # the least long has no absolute value
    return rows.astype(object) if rows.size and max(int(rows.max()), -int(rows.min())) > SMALL else rows


def kept(vectors: DataFrame, width: int, scale: int) -> DataFrame:
    right = usable(F.col("embedding")) & (F.size("embedding") == width)
    return vectors.where(right).select("vec_id", integers(F.col("embedding"), scale).alias("ints"))


def starts(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["ints"]) for r in rows.orderBy(drawn.asc_nulls_last(), "ints").limit(k).collect()]


def _state(vec_id: T.DataType, *more: T.StructField) -> T.StructType:
    fields = [T.StructField("vec_id", vec_id), T.StructField("ints", T.ArrayType(T.LongType()))]
    kinds = [("cluster", T.IntegerType()), ("second", T.IntegerType()), ("upper", T.DoubleType()), ("lower", T.DoubleType())]
    return T.StructType(fields + [T.StructField(n, t) for n, t in kinds] + list(more))


def assigned(rows: DataFrame, search: Search, width: int, distances: bool = False) -> DataFrame:
    """``rows`` with their nearest centroids; vectors without bounds yet start from centroid 0."""
    fresh = "cluster" not in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ints = _matrix(batch.column("ints"), width)
            n = len(ints)
            if fresh:
                near, second = np.zeros(n, np.int32), np.full(n, min(1, len(search.centroids) - 1), np.int32)
                upper, lower = np.full(n, np.inf), np.full(n, -np.inf)
            else:
                near, second, upper, lower = (batch.column(c).to_numpy() for c in ("cluster", "second", "upper", "lower"))
            near, second, upper, lower = search.assign(ints, near, second, upper, lower)
            out = [batch.column("vec_id"), batch.column("ints")]
            out += [pa.array(near.astype(np.int32)), pa.array(second.astype(np.int32)), pa.array(upper), pa.array(lower)]
            names = ["vec_id", "ints", "cluster", "second", "upper", "lower"]
            if distances:
                kind = object if ints.dtype == object or any(search.large) else np.int64
                out.append(pa.array([min(int(x), MOST) for x in search.to_each(ints, near, kind)], pa.int64()))
                names.append("distance")
            yield pa.record_batch(out, names)

    more = [T.StructField("distance", T.LongType())] if distances else []
    return rows.mapInArrow(run, _state(rows.schema["vec_id"].dataType, *more))


def means(rows: DataFrame, centroids: list[list[int]], width: int) -> list[list[int]]:
    """Floors of the exact means of each centroid's vectors; one without vectors stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[0] * width for _ in centroids]
        counts = [0] * len(centroids)
        for batch in batches:
            ints, near = _matrix(batch.column("ints"), width), batch.column("cluster").to_numpy()
            for number in np.unique(near):
                mine = ints[near == number]
                counts[number] += len(mine)
                sums[number] = [a + int(b) for a, b in zip(sums[number], mine.sum(axis=0))]
        have = [i for i, n in enumerate(counts) if n]
        yield pa.record_batch(
            [
                pa.array([i for i in have for _ in range(width)], pa.int32()),
                pa.array([j for _ in have for j in range(width)], pa.int32()),
                pa.array([str(sums[i][j]) for i in have for j in range(width)], pa.string()),
                pa.array([counts[i] for i in have for _ in range(width)], pa.int64()),
            ],
            ["cluster", "place", "total", "n"],
        )

    parts = rows.select("ints", "cluster").mapInArrow(run, "cluster int, place int, total string, n long")
    total = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    out = [list(c) for c in centroids]
    for r in parts.groupBy("cluster", "place").agg(total, F.sum("n").alias("n")).collect():
        out[r["cluster"]][r["place"]] = int(r["total"]) // r["n"]
    return out


def clustered(
    vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, width: int = 64, scale: int = 64
) -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, ints, cluster, second, upper, lower, distance`` of the vectors kept, and the centroids."""
    rows = kept(vectors, width, scale)
    centroids = starts(rows, k, seed)
    moved = np.zeros(len(centroids))
    for number in range(rounds + 1):
        rows = settle(assigned(rows, Search(centroids, moved), width, number == rounds)) if centroids else rows
        if number < rounds and centroids:
            after = means(rows, centroids, width)
            moved = np.array([_distance(a, b) for a, b in zip(centroids, after)])
            centroids = after
    return rows, centroids


def digest(vectors: DataFrame) -> DataFrame:
    """``vec_id, cluster, distance``, the inertias and the hash of the vector's centroid."""
    rows, centroids = clustered(vectors)
    if not centroids:
        none = F.lit(None)
        empty = [none.cast("int").alias("cluster"), none.cast("long").alias("distance"), none.cast("long").alias("cluster_inertia")]
        return rows.select("vec_id", *empty, none.cast("long").alias("inertia"), none.cast("string").alias("centroid_sha256"))
    spark = vectors.sparkSession
    hashes = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    named = spark.createDataFrame(hashes, "cluster int, centroid_sha256 string")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part"))

    def limited(total: Column) -> Column:
        return F.least(total, F.lit(MOST).cast("decimal(38,0)")).cast("long")

    # one row a centroid
    whole = sums.agg(F.sum("part").cast("decimal(38,0)").alias("whole"))
    facts = sums.join(named, "cluster").crossJoin(F.broadcast(whole))
    return rows.join(F.broadcast(facts), "cluster").select(
        "vec_id",
        "cluster",
        "distance",
        limited(F.col("part")).alias("cluster_inertia"),
        limited(F.col("whole")).alias("inertia"),
        "centroid_sha256",
    )
