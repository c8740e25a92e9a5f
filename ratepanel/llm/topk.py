"""Exact top-k search by inner product: three-phase uniform threshold.

Vectors become integers and are cut into ``SLICES`` slices of their components; each
slice gives every (query, vector) a local score, and a score is the sum of its slices.

1. Gather: each slice's best local scores per query, their vectors' full scores, and
   from these the k-th best, a score the answer cannot fall below.
2. Broadcast that cutoff with the queries. A vector that reaches it has at least one
   slice with a ``SLICES``-th of it, so each slice collects the entries from there on.
   Full scores now known may raise the cutoff; an entry whose known part, with the
   uniform threshold for each missing slice, stays below it is dropped.
3. Resolve: the missing slices of what is left are looked up in the vectors.

The query set meets all vectors in blocks: packed blocks of queries are joined with packed
blocks of vectors by block number. Equal vectors are searched once, as a class; a
class answers with its ``k + 1`` smallest ids, enough for any query.

Defined results: vectors that are null or hold nulls or non-finite components, and rows
without an id, take no part. Vectors of different lengths are compared over their common
components, an empty one scores 0. Components and scores outside 64 bits stop at
the limits; where components are so large that sums of slices could, the cutoff stays off
and every entry is resolved. A row repeated with its id is another row: it answers, and
asks, on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratepanel.operators.layout import with_rank
from ratepanel.session import settle

SLICES = 2
QUERY_BLOCK = 512
ROW_BLOCK = 1024
SALTS = 16
LOWEST, HIGHEST = -(2**63), 2**63 - 1
EXACT = 2**53


def integers(embedding: Column, scale: int = 256) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embedding.isNotNull() & finite


# --- blocks -----------------------------------------------------------------


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of integers, filled up with zeros to one width."""
    sizes = column.value_lengths().to_numpy()
    width = int(sizes.max()) if len(sizes) else 0
    flat = column.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _packed(rows: np.ndarray) -> bytes:
    small = not rows.size or (rows.min() >= -(2**15) and rows.max() < 2**15)
    return rows.astype(np.int16 if small else np.int64).tobytes()


def _unpacked(data: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int16 if len(data) == 2 * n * width else np.int64).reshape(n, width).astype(np.int64)


BLOCK_SCHEMA = "n int, width int, ids binary, rows binary, cutoffs binary"


def _block(ids: np.ndarray, rows: np.ndarray, cutoffs: np.ndarray) -> pa.RecordBatch:
    values = [[len(ids)], [rows.shape[1]], [ids.tobytes()], [_packed(rows)], [cutoffs.tobytes()]]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds)], ["n", "width", "ids", "rows", "cutoffs"])


def row_blocks(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(start, ROW_BLOCK)
                yield _block(part.column("cls").to_numpy(), matrix(part.column("ints")), np.zeros(0, np.int64))

    return classes.select("cls", "ints").mapInArrow(run, BLOCK_SCHEMA)


def query_blocks(queries: DataFrame, blocks: int) -> DataFrame:
    """``block`` and the packed queries ``cls, ints, cutoff`` of each block."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.column("ints").combine_chunks()
        block = _block(table.column("cls").to_numpy(), matrix(rows), table.column("cutoff").to_numpy())
        return pa.Table.from_batches([block]).append_column("block", table.column("block").slice(0, 1))

    dealt = queries.select("cls", "ints", "cutoff", F.pmod(F.xxhash64("cls"), F.lit(blocks)).alias("block"))
    return dealt.groupBy("block").applyInArrow(run, BLOCK_SCHEMA + ", block long")


def met(rows: DataFrame, queries: DataFrame, blocks: int) -> DataFrame:
    """Every block of rows with every block of queries, spread by a salt."""
    named = [F.col(c).alias(f"q_{c}") for c in queries.columns if c != "block"]
    asked = queries.select(*named, "block", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    salt = F.pmod(F.xxhash64("ids"), F.lit(SALTS)).cast("int").alias("salt")
    dealt = rows.select("n", "width", "ids", "rows", salt, F.explode(numbers).alias("block"))
    return dealt.join(asked, ["block", "salt"])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of integers, exact; beyond 64 bits the limits."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    bound = int(np.abs(a.astype(float)).max()) * int(np.abs(b.astype(float)).max()) * a.shape[1]
    if bound < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, LOWEST, HIGHEST).astype(np.int64)


def slice_edges(width: int) -> list[int]:
    return [width * i // SLICES for i in range(SLICES + 1)]


def local_scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, Iterator[np.ndarray]]:
    """Ids and cutoffs of a pair of blocks, and each slice's scores, queries by rows."""
    ids, asked = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
    rows, queries = _unpacked(row["rows"], row["n"], row["width"]), _unpacked(row["q_rows"], row["q_n"], row["q_width"])
    width = min(row["width"], row["q_width"])
    edges = slice_edges(max(row["width"], row["q_width"]))
    scores = (products(queries[:, min(a, width) : min(b, width)], rows[:, min(a, width) : min(b, width)]) for a, b in zip(edges, edges[1:]))
    return ids, asked, np.frombuffer(row["q_cutoffs"], np.int64), scores


# --- phases -----------------------------------------------------------------

ENTRY = "query long, cls long, slice int, score long"


def _entries(query: np.ndarray, cls: np.ndarray, number: int, score: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(query), pa.array(cls), pa.array(np.full(len(query), number, np.int32)), pa.array(score)]
    return pa.record_batch(columns, ["query", "cls", "slice", "score"])


def gathered(pairs: DataFrame, k: int) -> DataFrame:
    """Phase 1: the ``k`` best entries of each pair of blocks, query and slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, asked, _, scores = local_scores(batch.slice(i, 1).to_pylist()[0])
                for number, score in enumerate(scores):
                    most = min(k, len(ids))
                    best = np.argpartition(-score, most - 1, axis=1)[:, :most]
                    yield _entries(np.repeat(asked, most), ids[best].ravel(), number, np.take_along_axis(score, best, axis=1).ravel())

    best = Window.partitionBy("query", "slice").orderBy(F.col("score").desc(), "cls")
    return pairs.mapInArrow(run, ENTRY).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def collected(pairs: DataFrame) -> DataFrame:
    """Phase 2: the entries with a ``SLICES``-th of their query's cutoff or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, asked, cutoffs, scores = local_scores(batch.slice(i, 1).to_pylist()[0])
                least = -((-cutoffs) // SLICES)  # rounded up
                least[cutoffs == LOWEST] = LOWEST
                for number, score in enumerate(scores):
                    at, of = np.nonzero(score >= least[:, None])
                    yield _entries(asked[at], ids[of], number, score[at, of])

    return pairs.mapInArrow(run, ENTRY)


def resolved(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``query, cls, total``: the full scores of ``query, cls``, looked up in the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(start, ROW_BLOCK)
                a, b = matrix(part.column("ints")), matrix(part.column("q_ints"))
                width = min(a.shape[1], b.shape[1])
                a, b = a[:, :width], b[:, :width]
                top = max(int(np.abs(x.astype(float)).max()) if x.size else 0 for x in (a, b))
                if top * top * max(1, width) < EXACT:
                    total = (a * b).sum(axis=1, dtype=np.int64)
                else:
                    total = np.clip((a.astype(object) * b.astype(object)).sum(axis=1), LOWEST, HIGHEST).astype(np.int64)
                yield pa.record_batch([part.column("query"), part.column("cls"), pa.array(total)], ["query", "cls", "total"])

    asked = classes.select(F.col("cls").alias("query"), F.col("ints").alias("q_ints"))
    return pairs.join(classes.select("cls", "ints"), "cls").join(asked, "query").mapInArrow(run, "query long, cls long, total long")


def kth_best(totals: DataFrame, k: int) -> DataFrame:
    """``query, kth``: the k-th best total, null where there are fewer."""
    best = Window.partitionBy("query").orderBy(F.col("total").desc(), "cls")
    top = totals.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    return top.groupBy("query").agg(F.when(F.count(F.lit(1)) == k, F.min("total")).alias("kth"))


def best_classes(classes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query, cls, total``: for each of ``queries`` (``cls, ints``) the ``k`` best of ``classes``, ties to smaller ``cls``."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    rows = settle(row_blocks(classes))
    none, safe = F.lit(LOWEST).cast("long"), fits(classes)

    lists = gathered(met(rows, query_blocks(queries.withColumn("cutoff", none), blocks), blocks), k)
    seen = settle(resolved(lists.select("query", "cls").distinct(), classes))
    cutoffs = settle(kth_best(seen if safe else seen.limit(0), k))

    asked = queries.join(cutoffs, queries["cls"] == cutoffs["query"], "left")
    asked = asked.select("cls", "ints", F.coalesce("kth", none).alias("cutoff"))
    entries = collected(met(rows, query_blocks(asked, blocks), blocks))
    if not safe:
        return best_totals(resolved(entries.select("query", "cls").distinct(), classes), k)
    known = settle(
        entries.groupBy("query", "cls").agg(F.sum("score").alias("known"), F.count(F.lit(1)).alias("slices"))
    )
    whole = known.where(F.col("slices") == SLICES).select("query", "cls", F.col("known").alias("total"))
    raised = kth_best(whole, k).withColumnRenamed("kth", "raised")
    bound = known.join(cutoffs, "query", "left").join(raised, "query", "left")
    # Without a cutoff all slices are known.
    most = F.col("known") * SLICES + (SLICES - F.col("slices")) * F.col("kth")
    left = bound.where((F.col("slices") < SLICES) & (most >= F.greatest("kth", "raised") * SLICES))
    return best_totals(whole.unionByName(resolved(left.select("query", "cls"), classes)), k)


def best_totals(totals: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.col("total").desc(), "cls")
    return totals.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")


def fits(classes: DataFrame) -> bool:
    """Whether scores and their bounds stay within 64 bits."""
    low, high, width = classes.agg(
        F.min(F.array_min("ints")).cast("double"), F.max(F.array_max("ints")).cast("double"), F.max(F.size("ints"))
    ).first()
    top = max(abs(low or 0.0), abs(high or 0.0))
    return top * top * (width or 0) * (2 * SLICES + 2) < 2.0**63


def named(classes: DataFrame) -> DataFrame:
    """``classes`` with ``cls``, a number in the order of their smallest ids: that id, unless rows
    with one id and different vectors share it. Then it is the place in a range partitioning."""
    repeated = classes.groupBy("low").count().where(F.col("count") > 1)
    if repeated.isEmpty():
        return classes.withColumn("cls", F.col("low"))
    return settle(with_rank(classes.withColumn("_hash", F.xxhash64("ints")), ["low", "_hash"], "cls").drop("_hash"))


def top_k(vectors: DataFrame, asks: Column, k: int = 5, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows where ``asks`` holds."""
    usual = vectors.where(F.col(id).isNotNull() & usable(F.col(embedding)))
    rows = settle(
        usual.select(
            F.col(id).cast("long").alias("vec_id"),
            integers(F.col(embedding)).alias("ints"),
            F.coalesce(asks, F.lit(False)).alias("asks"),
        )
    )
    classes = settle(
        rows.groupBy("ints").agg(F.min("vec_id").alias("low"), F.max("asks").alias("asks"), F.count(F.lit(1)).alias("n"))
    )
    classes = named(classes)
    best = settle(best_classes(classes, classes.where("asks").select("cls", "ints"), k + 1))

    crowded = classes.where(F.col("n") > 1)
    inside = rows.join(crowded.select("ints", "cls"), "ints").select("cls", "vec_id", "asks")
    inside = inside.unionByName(classes.where(F.col("n") == 1).select("cls", F.col("low").alias("vec_id"), "asks"))
    inside = settle(inside)
    smallest = Window.partitionBy("cls").orderBy("vec_id")
    members = inside.select("cls", "vec_id").withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") <= k + 1)
    members = members.withColumn("copy", F.row_number().over(Window.partitionBy("cls", "vec_id").orderBy("nth"))).drop("nth")
    askers = inside.where("asks").groupBy(F.col("vec_id").alias("query_id"), F.col("cls").alias("own")).agg(F.count(F.lit(1)).alias("rows"))
    answers = askers.join(best, askers["own"] == best["query"]).join(members, "cls")
    answers = answers.where(~((F.col("cls") == F.col("own")) & (F.col("vec_id") == F.col("query_id")) & (F.col("copy") == 1)))
    ranks = Window.partitionBy("query_id", "own").orderBy(F.col("total").desc(), "vec_id", "cls", "copy")
    ranked = answers.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))
    return ranked.select("query_id", "rank", "vec_id", F.col("total").alias("score"), again.alias("_row")).drop("_row")
