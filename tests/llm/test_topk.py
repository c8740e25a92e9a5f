import math

import numpy as np
import pytest
from ratepanel.llm import topk
from pyspark.sql import functions as F


def brute(rows, k=5, every=50):
    good = []
    for at, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((at, i, [max(-(2**63), min(2**63 - 1, math.floor(256 * x))) for x in v]))
    out = []
    for at, i, q in good:
        if i % every == 0:
            scored = [
                (-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j) for other, j, v in good if other != at
            ]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(scored)[:k], start=1)]
    return sorted(out)


def answers(df, k=5):
    found = topk.top_k(df, F.col("vec_id") % 50 == 0, k)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, label int, cls int, rank int")


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert answers(df) == brute([(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    vector = lambda: [float(np.float32(x)) for x in rng.normal(0, 1, 8)]
    common = vector()
    rows = [(i, common if i % 3 == 0 else vector()) for i in range(400)]
    rows += [(100, common), (100, common), (7, vector()), (50, vector())]
    rows += [(1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 8), (1150, [float("inf")] + [0.0] * 7), (None, vector())]
    rows += [(1200, []), (1250, [0.5, 0.25]), (1300, vector() + [1.0])]
    assert answers(frame(spark, rows)) == brute(rows)


def test_large_components(spark):
    rows = [(i, [float(np.float32(x)) for x in (1e15 * i, -3e12, 1.5)]) for i in range(60)] + [(100, [3e38, 3e38, 0.0]), (150, [-3e38, 1.0, 1.0])]
    assert answers(frame(spark, rows)) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    rows = [(50 * i, [1.0, float(i)]) for i in range(n)]
    assert answers(frame(spark, rows)) == brute(rows)


def test_few_entries_are_collected(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-256, 256, 32).tolist()) for i in range(3000)]
    classes = spark.createDataFrame(rows, "cls long, ints array<long>").cache()
    queries = classes.where("cls % 50 = 0")
    best = {(r["query"], r["cls"], r["total"]) for r in topk.best_classes(classes, queries, 6).collect()}
    m = np.array([v for _, v in rows])
    for q in range(0, 3000, 50):
        s = m @ m[q]
        order = sorted(range(3000), key=lambda j: (-s[j], j))[:6]
        assert {(q, j, int(s[j])) for j in order} <= best
    assert len(best) == 60 * 6


def test_classes_of_one_id_are_numbered_in_ranges(spark, monkeypatch):
    """No task sorts all vectors, also if an id is repeated."""
    sizes = []

    def seen(df):
        sizes.extend(r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect())
        return spark.createDataFrame(df.collect(), df.schema)

    rows = [(i // 2 if i < 10 else i, [i, i % 7], True, 1) for i in range(4000)]
    classes = spark.createDataFrame(rows, "low long, ints array<long>, asks boolean, n long")
    monkeypatch.setattr(topk, "settle", seen)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = topk.named(classes).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r["cls"] for r in found}) == 4000 and max(sizes) < 2000
    assert [r["low"] for r in sorted(found, key=lambda r: r["cls"])] == sorted(r[0] for r in rows)
