import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from ratepanel.llm import setjoin
from ratepanel.llm.common import byte_texts, chunks
from pyspark.sql import functions as F


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows):
    """Components over all pairs: ``doc_id, n_shingles, component_id`` of each row."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            low[find(i)] = min(low.get(find(i), row[0]), row[0])
    return sorted(((r[0], len(s), low.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def edited(words, rng, edits):
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[at] = f"e{rng.random()}"
        elif kind < 0.7:
            del out[at]
        else:
            out.insert(at, f"i{rng.random()}")
    return out


def families(seed=0):
    """Texts around the threshold: edited copies, extensions, templates with little of their own."""
    rng = random.Random(seed)
    rows, number = [], 0
    for size in (5, 6, 9, 14, 30, 70, 150, 400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(8):
            rows.append((number, " ".join(edited(base, rng, rng.randint(0, max(1, size // 25))))))
            number += 1
            more = [f"m{rng.randrange(10**6)}" for _ in range(rng.randint(0, size // 3))]
            rows.append((number, " ".join(base + more).upper()))
            number += 1
    template = [f"t{i}" for i in range(90)]
    for i in range(60):
        own = [f"o{i}_{j}" for j in range(rng.choice([8, 16, 24]))]
        rows.append((number, " ".join(template + own)))
        number += 1
    return rows


def joined(df, **settings):
    return sorted((tuple(r) for r in setjoin.join_documents(df, **settings).collect()), key=str)


def test_odd_rows(odd_docs, odd_rows):
    assert joined(odd_docs) == brute(odd_rows)


@pytest.mark.parametrize("settings", [{}, {"few": 2, "levels": 0}, {"few": 2, "levels": 2}])
def test_families_around_the_threshold(spark, settings):
    rows = families()
    assert joined(spark.createDataFrame(rows, "doc_id long, text string"), **settings) == brute(rows)


def test_no_rows(no_docs):
    assert joined(no_docs) == []


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(0)
    for _ in range(1500):
        size = int(rng.integers(1, 40)) if rng.random() < 0.5 else int(rng.integers(40, 700))
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        gone = int(rng.integers(0, setjoin.differ(size, size) + 1))
        more = rng.integers(0, 2**64, setjoin.differ(size, size) - gone, dtype=np.uint64)
        b = np.unique(np.r_[rng.choice(a, max(1, len(a) - gone), replace=False), more])
        both = len(np.intersect1d(a, b))
        if both == len(a) == len(b) or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        for seed in (0, 1):
            assert len(np.intersect1d(setjoin.signatures(a, seed), setjoin.signatures(b, seed)))


def test_unlike_sets_share_none():
    rng = np.random.default_rng(1)
    sets = [setjoin.signatures(np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64))) for _ in range(60)]
    whole = np.concatenate([np.unique(s) for s in sets])
    assert len(np.unique(whole)) == len(whole)


@pytest.mark.parametrize("held", [65_536, 50])
def test_lists_of_classes(spark, monkeypatch, held):
    monkeypatch.setattr(setjoin, "HELD", held)
    lists = {i: [i * 1000 + j for j in range(i % 3 + 1)] for i in range(40)} | {99: list(range(500)), 98: [0, 1000]}
    rows = [(k, c) for k, v in lists.items() for c in v for _ in range(2)]
    found = setjoin.met(spark.createDataFrame(rows, "key long, cls long").repartition(3)).collect()
    pairs = {(r["centre"], r["cls"]) for r in found if r["centre"] != r["cls"]}
    assert pairs == {(v[0], c) for v in lists.values() for c in v[1:]}
    named = {}
    for r in found:
        if r["key"] is not None:
            named.setdefault(r["key"], set()).add(r["cls"])
    assert sorted(map(sorted, named.values())) == sorted(v for v in lists.values() if len(v) > 2)


def test_repeated_lists_are_told_once_a_task(spark):
    rows = [(k, c) for k in range(1000) for c in (1, 2, 3)]
    found = setjoin.met(spark.createDataFrame(rows, "key long, cls long"))
    assert found.distinct().count() == 3
    assert found.agg(F.count("cls")).first()[0] <= 3 * 8


def test_cells_never_hide_a_link():
    rng = np.random.default_rng(2)
    for size in (1, 4, 5, 8, 9, 60, 64, 65, 500, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            b = np.unique(np.r_[a[rng.random(len(a)) < 0.9], rng.integers(0, 2**64, int(rng.integers(0, size // 8 + 1)), dtype=np.uint64)])
            if len(b):
                both = len(np.intersect1d(a, b))
                found = setjoin.gap(setjoin.counts_in(setjoin.cells_of(a)), setjoin.counts_in(setjoin.cells_of(b)))
                assert found <= len(a) + len(b) - 2 * both


def test_a_batch_of_texts_is_held_in_small_pieces():
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(500)) for _ in range(2000)]
    batch = pa.record_batch([pa.array(texts)], ["text"])
    tracemalloc.start()
    try:
        for part in chunks(batch, limit=setjoin.CHUNK):
            setjoin.shingle_sets(list(byte_texts(part.column("text"))))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 100e6


def test_sets_are_read_with_one_python_worker_a_task(spark, monkeypatch):
    texts = [f"a b c d e{i} f g" for i in range(40)] + [None, "", "x y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = setjoin.with_sets(docs).where("n > 0").select("cls", "text_hash")
    some = sorted(r["cls"] for r in classes.collect())[::6]
    wanted = classes.where(F.col("cls").isin(some)).select("cls")
    monkeypatch.setattr(setjoin, "settle", lambda df: df)
    found = setjoin.sets_of(docs, classes, wanted)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
    sets = {setjoin.class_of(s): sorted(s.view(np.int64).tolist()) for s in setjoin.shingle_sets([(t or "").encode() for t in texts])}
    rows = {r["cls"]: sorted(r["shingles"]) for r in found.collect()}
    assert set(some) <= set(rows)
    assert all(rows[c] == sets[c] for c in rows)
