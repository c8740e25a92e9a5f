import zlib
from collections import defaultdict

import numpy as np
from ratepanel.llm import sharding


def test_shards(odd_docs, odd_rows, some_docs, some_rows, no_docs):
    for docs, rows in ((odd_docs, odd_rows), (some_docs, some_rows)):
        found = sharding.shard_rows(docs).collect()
        expected = sorted((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
        assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in found) == expected
        places = defaultdict(list)
        for r in found:
            assert 0 <= r["shard"] < 8 and r["law"] == "bytes" and r["grown_shard"] is None
            places[r["shard"]].append(r["slot"])
        assert all(sorted(p) == list(range(len(p))) for p in places.values())
    load = defaultdict(int)
    for r in found:
        load[r["shard"]] += r["size"]
    largest = max(r["size"] for r in found)
    assert len(load) == 8 and max(load.values()) - min(load.values()) <= largest
    assert sharding.shard_rows(no_docs).count() == 0
    whole = sharding.sharded(odd_docs)
    assert whole.columns == [*odd_docs.columns, "shard_", "slot_"] and whole.count() == len(odd_rows)


def test_versions_move_little():
    rng = np.random.default_rng(1)
    sizes = rng.lognormal(3, 1, 4096).round()
    slot_map = sharding.SlotMap.even(4096, 8)
    slot_map.rebalance(sizes, 8)
    slot_map.grow(sizes, 9)
    even, balanced, grown = slot_map.versions
    load = np.bincount(balanced, weights=sizes)
    assert load.max() - load.min() <= sizes.max() and (even != balanced).mean() < 0.1
    moved = grown != balanced
    assert set(grown[moved]) == {8} and abs(sizes[moved].sum() / sizes.sum() - 1 / 9) < 0.02
    load = np.bincount(grown, weights=sizes)
    assert load.max() / load.min() < 1.1


def test_stored_map(spark):
    slot_map = sharding.SlotMap.even(16, 4)
    slot_map.rebalance(np.arange(16.0), 4)
    stored = slot_map.table(spark, np.ones(16, dtype=int)).toPandas()
    assert len(stored) == 32 and set(stored.version) == {0, 1}


def test_runs_edit_the_stored_map(spark, some_docs, tmp_path):
    folder = str(tmp_path / "map")
    small = some_docs.where("doc_id % 3 = 0")
    runs = [sharding.shard_rows(d, n, 64, folder).collect() for d, n in ((small, 4), (small, 4), (some_docs, 4), (some_docs, 5))]
    assert [{r["map_version"] for r in found} for found in runs] == [{1}, {2}, {3}, {5}]
    stored = spark.read.parquet(folder).toPandas().sort_values(["version", "virtual_slot"])
    owner = [stored[stored.version == v].shard.to_numpy() for v in range(6)]
    assert all(len(o) == 64 for o in owner) and (owner[1] == owner[2]).all()
    sizes, _ = sharding.slot_sums(some_docs.select(sharding.slot_of(64).alias("virtual_slot"), sharding.record_size().alias("bytes")), 64)
    edited = sharding.SlotMap([owner[2]])
    edited.rebalance(sizes, 4)
    assert (edited.latest == owner[3]).all() and set(owner[4][owner[4] != owner[3]]) == {4}
    for found, of in zip(runs, (1, 2, 3, 5)):
        assert all(r["shard"] == owner[of][r["virtual_slot"]] for r in found)
