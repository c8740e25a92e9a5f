import numpy as np
import pytest
import xxhash
from ratepanel.llm import simhash
from pyspark.sql import functions as F


def fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    found = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    sums = [0] * 64
    for shingle in found:
        value = xxhash.xxh64_intdigest(shingle, 42)
        for i in range(64):
            sums[i] += value >> i & 1
    return sum(1 << i for i in range(64) if sums[i] * 2 > len(found))


def groups(points, distance):
    """Smallest index reachable, over all pairs."""
    low = list(range(len(points)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(points):
            for j, b in enumerate(points):
                if (a ^ b).bit_count() <= distance and low[j] < low[i]:
                    low[i], changed = low[j], True
    return low


@pytest.mark.parametrize("which", ["odd", "some"])
def test_against_all_pairs(which, odd_docs, odd_rows, some_docs, some_rows):
    docs, rows = (odd_docs, odd_rows) if which == "odd" else (some_docs, some_rows)
    found = simhash.near_duplicates(docs).withColumn("fingerprint", simhash.hexadecimal())
    prints = {}
    for row in rows:
        prints.setdefault(fingerprint(row[1]), []).append(row[0])
    values = list(prints)
    low = groups(values, 3)
    members = {}
    for value, root in zip(values, low):
        members.setdefault(root, []).extend(i for i in prints[value] if i is not None)
    expected = sorted(
        ((i, f"{v:016x}", min(members[root], default=None)) for v, root in zip(values, low) for i in prints[v]), key=str
    )
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found.collect()), key=str) == expected


@pytest.mark.parametrize("segments,distance,crowd", [(2, 3, 50_000), (3, 5, 4), (2, 3, 4), (4, 3, 50_000)])
def test_links_connect_everything(spark, segments, distance, crowd):
    rng = np.random.default_rng(5)
    points = []
    for centre in rng.integers(0, 2**63, 12, dtype=np.uint64):
        for _ in range(25):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            points.append(int(centre) ^ sum(1 << int(b) for b in flips))
    points = sorted(set(points))
    signed = [p - 2**64 if p >= 2**63 else p for p in points]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = simhash.find_links(df, distance, segments, crowd)
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    found = [roots.get(p, p) for p in signed]
    low = groups(points, distance)
    assert all((found[i] == found[j]) == (low[i] == low[j]) for i in range(len(points)) for j in range(i))
    # stars, not all pairs of a meeting place
    assert links.count() < len(points) * segments * 4


def test_few_meet_by_chance(spark):
    """Each fingerprint stands at its own values and at those one bit off, and nowhere else."""
    rng = np.random.default_rng(9)
    points = [int(p) for p in rng.integers(0, 2**63, 300, dtype=np.int64)]
    seen = simhash._looked_up(spark.createDataFrame([(p,) for p in points], "fp long"), 3, 2, 50_000)
    assert seen.count() == 300 * 66 and seen.where("home").count() == 600
    assert seen.select("key").distinct().count() == 300 * 66
    values = [(n, (p >> 32 * n & 0xFFFFFFFF) ^ m) for p in points for n in (0, 1) for m in [0, *(1 << b for b in range(32))]]
    keys = spark.createDataFrame(values, "segment int, value long").select(
        F.xxhash64("segment", "value", F.lit(-1).cast("long")).alias("key")
    )
    assert seen.join(keys, "key", "left_anti").isEmpty()


def test_keep_one(odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    labels = {r["component_id"] for r in simhash.near_duplicates(odd_docs).collect()}
    assert ids == sorted(labels, key=str)
    assert simhash.keep_one(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0


def test_chain_has_one_root(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}
