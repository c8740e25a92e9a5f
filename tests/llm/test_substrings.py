import hashlib

import numpy as np
import pytest
from ratepanel.llm import substrings

from llm.conftest import prose


def brute(rows):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        if i is not None:
            for j in range(len(words) - 49):
                key = tuple(words[j : j + 50])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, words in split:
        dead = [False] * len(words)
        for j in range(len(words) - 49 if i is not None else 0):
            if first[tuple(words[j : j + 50])] < i:
                dead[j : j + 50] = [True] * 50
        kept = [w for w, d in zip(words, dead) if not d]
        out.append((i, len(words), sum(dead), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def digest(df, **options):
    found = substrings.digest(df, **options).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found), key=str)


@pytest.mark.parametrize("which", ["odd", "some"])
def test_against_all_windows(which, odd_docs, odd_rows, some_docs, some_rows):
    docs, rows = (odd_docs, odd_rows) if which == "odd" else (some_docs, some_rows)
    expected = brute([r[:2] for r in rows])
    assert digest(docs) == expected and sum(r[2] for r in expected) > 0


def edited(spark):
    """Overlapping quotations, edits every few words, repetition within and across documents."""
    rng = np.random.default_rng(6)
    base = prose(11, 900).split()
    rows = []
    for i in range(60):
        a, n = int(rng.integers(0, 700)), int(rng.integers(20, 200))
        words = prose(100 + i, int(rng.integers(0, 40))).split() + base[a : a + n] + prose(200 + i, 20).split()
        for at in rng.integers(0, len(words), int(rng.integers(0, 3))):
            words[at] = "edit"
        rows.append((int(rng.integers(0, 50)), " ".join(words)))
    rows += [(100 + i, " ".join(["De"] * n)) for i, n in enumerate((49, 50, 51, 300, 1000, 120))]
    rows += [(200, " ".join(["asga"] * 70 + ["De"] * 200)), (3, " ".join(base)), (300, " ".join(base + base))]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_edits_overlaps_and_repetition(spark):
    rows, df = edited(spark)
    assert digest(df) == brute(rows)


def test_full_filter_changes_nothing(spark):
    rows, df = edited(spark)
    assert digest(df, most_bits=6) == brute(rows)


def test_filter_holds_its_keys_and_few_others(spark):
    rng = np.random.default_rng(2)
    keys = rng.integers(-(2**63), 2**63, 2000, dtype=np.int64)
    filter_ = substrings.bloom(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert substrings.held_by(filter_, keys).all()
    assert substrings.held_by(filter_, rng.integers(-(2**63), 2**63, 20_000, dtype=np.int64)).mean() < 0.01


def test_words_are_hashed_by_content():
    texts = [b"a bb  ccc", b"", b"\t bb a\n", b"x" * 5000 + b" y", b"x" * 5000]
    found, edges = substrings.word_hashes(texts)
    assert edges.tolist() == [0, 3, 3, 5, 7, 8]
    assert found[0] == found[4] and found[1] == found[3] and found[5] == found[7] and len(set(found.tolist())) == 5


@pytest.mark.parametrize("width", [1, 2, 3, 7, 35])
def test_least_of(width):
    values = np.random.default_rng(1).integers(0, 1000, 80)
    assert substrings.least_of(values, width).tolist() == [values[i : i + width].min() for i in range(81 - width)]


def test_deduplicated_texts(odd_docs, no_docs):
    kept = {r["doc_id"]: r["text"] for r in substrings.deduplicate(odd_docs).collect()}
    assert kept[8].split() == (prose(4, 30) + " " + prose(2, 70) + " " + prose(5, 30)).split()
    assert kept[10] == "" and kept[2] == ""
    assert digest(no_docs) == []
