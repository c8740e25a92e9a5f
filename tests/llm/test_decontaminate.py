import math
from collections import Counter

import pytest
from ratepanel.llm import decontaminate as dc

from llm.conftest import prose


def brute(docs, items, threshold=dc.THRESHOLD, overlap=dc.OVERLAP):
    """Scores every passage against every piece."""
    pieces = []
    for item_id, text in sorted({(i, t) for i, t in items if t}, key=str):
        words = dc.plain_words(text)
        if len(words) >= dc.LEAST:
            pieces += [(item_id, text, p) for p in dc.cut_pieces(words)]
    df = Counter(w for _, _, p in pieces for w in set(p))
    mean = sum(len(p) for _, _, p in pieces) / max(1, len(pieces))
    scored = []
    for item_id, text, piece in pieces:
        weight = {}
        for word, tf in Counter(piece).items():
            idf = math.log1p((len(pieces) - df[word] + 0.5) / (df[word] + 0.5))
            weight[word] = idf * tf * (dc.K1 + 1) / (tf + dc.K1 * (1 - dc.B + dc.B * len(piece) / mean))
        whole = sum(weight.values())
        scored.append((item_id, text, {w: x / whole for w, x in weight.items()}))
    out = set()
    for doc_id, text in docs:
        words = dc.plain_words(text or "")
        for start in range(0, max(1, len(words) - dc.PIECE), dc.PIECE):
            passage = set(words[start : start + 2 * dc.PIECE])
            for item_id, item, weight in scored:
                if sum(weight.get(w, 0) for w in passage) < threshold:
                    continue
                question, answer = dc.question_and_answer(item)
                length = len(question) + len(answer)
                around = words[max(0, start - length) : start + 2 * dc.PIECE + length]
                parts = [dc.shingles(question, 5), dc.shingles(answer, 3)]
                if all(not p or len(p & dc.shingles_of(around, p)) / len(p) >= overlap for p in parts):
                    out.add((doc_id, item_id))
    return out


@pytest.mark.parametrize("postings", [2_000_000, 300])
def test_against_all_pairs(spark, sf, some_docs, some_rows, postings, monkeypatch):
    monkeypatch.setattr(dc, "POSTINGS", postings)
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = dc.find_leaks(some_docs, items).collect()
    expected = brute([(r[0], r[1]) for r in some_rows], [tuple(r) for r in items.collect()])
    assert {(r["doc_id"], r["item_id"]) for r in found} == expected and expected
    assert len(found) == len(expected)


@pytest.mark.parametrize("cells", [4_000_000, 0])
def test_search_matches_scores(cells, monkeypatch):
    import numpy as np

    monkeypatch.setattr(dc, "CELLS", cells)

    rng = np.random.default_rng(4)
    rows, share = [], {}
    for piece in range(60):
        for word in rng.choice(80, 12, replace=False):
            share[piece, int(word)] = float(rng.random() / 4)
            rows.append({"item": piece, "piece": 0, "word": b"%d" % word, "share": share[piece, int(word)]})
    index = dc.Index.build(rows, {p: (p, f"w{p} a b c d e f") for p in range(60)})
    for _ in range(50):
        asked = rng.choice(80, 30, replace=False)
        terms = np.array(sorted(index.words[b"%d" % w] for w in asked if b"%d" % w in index.words))
        exact = {p: sum(share.get((p, int(w)), 0) for w in asked) for p in range(60)}
        got = dict(index.search(terms, 0.7))
        assert set(got) == {p for p, s in exact.items() if s >= 0.7}
        assert all(got[p] == pytest.approx(exact[p]) for p in got)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    item = prose(2, 70)
    items = spark.createDataFrame(
        [(1, item, 0), (1, item, 0), (2, None, 1), (3, "", 1), (4, "the of", 1), (None, prose(4, 25), 2), (6, "What is it? " + prose(9, 9), 1), (7, prose(8, 400), 3)],
        "item_id long, text string, score int",
    )
    found = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(odd_docs, items).collect()}
    assert found == brute([(r[0], r[1]) for r in odd_rows], [(r[0], r[1]) for r in items.collect()])
    assert {(8, 1), (9, 1), (10, 1)} <= found
    kept = dc.clean(odd_docs, items)
    assert kept.columns == odd_docs.columns
    assert {r["doc_id"] for r in kept.collect()}.isdisjoint({8, 9, 10})
    assert dc.clean(odd_docs, items.limit(0)).count() == len(odd_rows)
    assert dc.find_leaks(no_docs, items).count() == 0


def test_changed_case_and_marks_are_found(spark):
    item = "Where does the river rise? It rises in the far northern hills"
    noise = item.upper().replace(" ", "!! ").replace("?", "")
    docs = spark.createDataFrame([(1, prose(1, 50) + " " + noise + " " + prose(2, 50)), (2, "where does the river rise " + prose(3, 40))], "doc_id long, text string")
    items = spark.createDataFrame([(5, item)] + [(10 + i, prose(20 + i, 20)) for i in range(20)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(docs, items).collect()} == {(1, 5)}


def distinct(seed, n):
    return [f"w{seed}x{i}" for i in range(n)]


def test_partial_and_edited_quotes_of_items_without_answer(spark):
    """A quote of some of the words, of one piece, or with any one word changed is found."""
    whole = {1: distinct(1, 59), 2: distinct(2, 200), 3: distinct(3, 14), 4: distinct(4, 8), 5: distinct(5, 10)}
    asked = distinct(6, 12)
    items = [(i, " ".join(w)) for i, w in whole.items()] + [(6, " ".join(asked[:8]) + "? " + " ".join(asked[8:]))]
    quotes = [(1, whole[1][:40]), (1, whole[1][10:50]), (1, whole[1][19:]), (1, whole[1][:29])]
    quotes += [(2, p) for p in dc.cut_pieces(whole[2])]
    quotes += [(i, [*whole[i][:at], "other", *whole[i][at + 1 :]]) for i in (3, 4, 5) for at in range(len(whole[i]))]
    quotes += [(6, asked), (None, asked[:8]), (None, whole[1][5:12]), (None, whole[3][3:7]), (None, [])]
    docs = [(n, " ".join([*distinct(100, 45), *q, *distinct(200, 30)])) for n, (_, q) in enumerate(quotes)]
    found = dc.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(n, i) for n, (i, _) in enumerate(quotes) if i}
    assert all((r["answer_overlap"] is None) == (r["item_id"] != 6) for r in found)
