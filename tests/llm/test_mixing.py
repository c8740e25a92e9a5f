from collections import defaultdict

import pytest
from ratepanel.llm import mixing


def levels(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, left, free = {}, share * sum(sizes.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return goal | {s: level * weight[s] for s in free}
        for s in over:
            goal[s] = most * sizes[s]
            left -= goal[s]
        free -= over


@pytest.mark.parametrize("which", ["odd", "some"])
def test_mix(which, odd_docs, odd_rows, some_docs, some_rows):
    docs, rows = (odd_docs, odd_rows) if which == "odd" else (some_docs, some_rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    goal = levels(dict(sizes))
    source = {(r[0], len((r[1] or "").encode().split())): r[3] for r in rows}
    found = mixing.mixed_sizes(docs).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in found) == sorted((str(r[0]), len((r[1] or "").encode().split())) for r in rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in found:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(goal[s])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - goal[s]) <= largest[s] * 0.51 + 1 for s in sizes)
    again = mixing.mixed_sizes(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_small_buckets_keep_expectations(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "s" if i % 3 else "t") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mixed_sizes(docs, bucket=4).toPandas()
    for _, own in found.groupby("target"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 4
    seeds = [mixing.mixed_sizes(docs, bucket=4, seed=s).toPandas().sort_values("doc_id").copies.to_numpy() for s in (1, 2, 3)]
    assert any((a != b).any() for a, b in zip(seeds, seeds[1:]))


def test_documents_follow_the_decisions(odd_docs, some_docs, no_docs):
    for docs in (odd_docs, some_docs):
        copies = {(str(r["doc_id"]), r["size"]): 0 for r in mixing.mixed_sizes(docs).collect()}
        for r in mixing.mixed_sizes(docs).collect():
            copies[str(r["doc_id"]), r["size"]] += r["copies"] if r["size"] else 1
        out = mixing.mixed_documents(docs)
        assert out.columns == docs.columns
        got = dict.fromkeys(copies, 0)
        for r in out.collect():
            got[str(r["doc_id"]), len((r["text"] or "").encode().split())] += 1
        assert got == copies
    assert mixing.mixed_documents(no_docs).count() == 0
    assert mixing.mixed_sizes(no_docs).count() == 0
