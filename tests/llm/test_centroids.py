import hashlib
import math

import numpy as np
import pytest
from ratepanel.llm import centroids

LIMIT = 2**63 - 1
SCHEMA = "vec_id long, embedding array<float>, cluster int, distance long, ints string, inertia double"


def whole(x, scale):
    return max(-(2**63), min(LIMIT, math.floor(float(np.float32(x)) * scale)))


def lloyd(rows, k=16, rounds=3, seed=1, width=64, scale=64):
    """Every vector against every centroid, in Python's integers."""
    good = [(i, v) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    vectors = [(i, [whole(x, scale) for x in v]) for i, v in good]
    drawn = sorted(vectors, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    points = [list(v) for _, v in drawn[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(points))

    for _ in range(rounds):
        groups = {}
        for _, v in vectors:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, members in groups.items():
            points[n] = [sum(c) // len(members) for c in zip(*members)]
    found = [(i, *nearest(v)) for i, v in vectors]
    parts = {}
    for _, d, n in found:
        parts[n] = parts.get(n, 0) + min(d, LIMIT)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in points]
    total = min(sum(parts.values()), LIMIT)
    return sorted(((i, n, min(d, LIMIT), min(parts[n], LIMIT), total, hashes[n]) for i, d, n in found), key=str)


def odd_vectors(n=300, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 64) / 64]) for i in range(n)]
    same = [0.25] * 64
    rows += [(1000 + i, same) for i in range(200)] + [(7, same), (7, [0.5] * 64), (None, same), (None, [-0.5] * 64)]
    rows += [(2001, None), (2002, []), (2003, [0.1] * 63), (2004, [0.1] * 65), (2005, [None] + [0.1] * 63)]
    return rows + [(2006, [float("nan")] + [0.1] * 63), (2007, [float("inf")] * 64), (2008, [-0.0] * 64)]


def digest(spark, rows):
    df = spark.createDataFrame([r + (1, 2, "x", 0.5) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in centroids.digest(df).collect()), key=str)


@pytest.mark.parametrize("n", [300, 3, 1])
def test_odd_rows(spark, n):
    rows = odd_vectors(n)[:n] if n < 16 else odd_vectors(n)
    assert digest(spark, rows) == lloyd(rows)


def test_huge_components(spark):
    rows = odd_vectors(60, 2) + [(3000, [1e30] * 64), (3001, [-1e30] * 64), (3002, [3e9] * 64), (3003, [2.5e6] * 64)]
    assert digest(spark, rows) == lloyd(rows)


def test_given_rows(spark, sf):
    given = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r[0], list(r[1])) for r in given.collect()]
    assert sorted((tuple(r) for r in centroids.digest(given).collect()), key=str) == lloyd(rows)


def test_bounds_never_change_an_assignment():
    rng = np.random.default_rng(1)
    for k, spread in ((1, 5), (2, 3), (12, 4), (12, 100)):
        rows = rng.integers(-spread, spread + 1, (400, 6))
        points = [list(map(int, r)) for r in rows[:k]]
        near, second = np.zeros(400, np.int32), np.full(400, min(1, k - 1), np.int32)
        upper, lower, moved = np.full(400, np.inf), np.full(400, -np.inf), np.zeros(k)
        for _ in range(6):
            search = centroids.Search(points, moved)
            near, second, upper, lower = search.assign(rows, near, second, upper, lower)
            gaps = ((rows[:, None, :] - np.array(points)[None]) ** 2).sum(axis=2)
            assert (near == gaps.argmin(axis=1)).all()
            own = np.sqrt(gaps[np.arange(400), near])
            others = np.where(np.arange(k) == near[:, None], np.inf, np.sqrt(gaps)).min(axis=1)
            assert (own <= upper + 1e-6).all() and (others >= lower - 1e-6).all()
            after = [[int(x) for x in rows[near == n].sum(axis=0) // max(1, (near == n).sum())] if (near == n).any() else p for n, p in enumerate(points)]
            moved = np.array([math.dist(a, b) for a, b in zip(points, after)])
            points = after


def test_other_settings(spark):
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found, points = centroids.clustered(df, k=4, rounds=5, seed=9, width=2, scale=10)
    expected = lloyd(rows, 4, 5, 9, 2, 10)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()), key=str) == [e[:3] for e in expected]
    assert len(points) == 4


def test_no_rows(spark):
    assert digest(spark, []) == []
    assert digest(spark, [(1, None), (2, [0.5])]) == []
