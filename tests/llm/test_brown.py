import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from ratepanel.llm import brown

SMALL = {"n_classes": 8, "n_units": 200, "n_slots": 56, "known": 400, "rounds": 3}


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


@pytest.mark.parametrize("which", ["odd", "some"])
def test_base_scores(which, odd_docs, odd_rows, some_docs, some_rows):
    docs, rows = (odd_docs, odd_rows) if which == "odd" else (some_docs, some_rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    found = brown.score_texts(docs, **SMALL).collect()
    expected = []
    for r in rows:
        own = tokens(r[1])
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        expected.append((str(r[0]), held(r[0]), len(own), sum(w in counts for w in own), n, round(base, 4)))
    got = [(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in found]
    assert sorted(got) == sorted(expected)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)


def test_model_beats_base_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = brown.score_texts(docs, rounds=3).where("held_out").toPandas()
    assert found.score.sum() > found.base_score.sum()


def test_exchange_gain_is_the_likelihood_gain():
    """Every move is the best of all, by recounting the text."""
    rng = np.random.default_rng(3)
    n_classes, n_units = 4, 12
    text = rng.integers(0, n_units, 400)
    classes = rng.integers(0, n_classes, n_units)

    def bigrams(of):
        found = np.zeros((n_classes, n_classes))
        np.add.at(found, (of[text[:-1]], of[text[1:]]), 1)
        return found

    for unit in range(n_units):
        counts = np.zeros(2 * n_classes + 1, dtype=np.int64)
        for a, b in zip(text[:-1], text[1:]):
            if a == unit:
                counts[classes[b]] += 1
            if b == unit:
                counts[n_classes + classes[a]] += 1
            if a == b == unit:
                counts[2 * n_classes] += 1
        now = bigrams(classes)
        best = brown.exchange(counts, int(classes[unit]), now)
        tried = []
        for other in range(n_classes):
            moved = classes.copy()
            moved[unit] = other
            tried.append(brown.likelihood(bigrams(moved)))
        assert tried[best] == pytest.approx(max(tried))
        classes[unit] = best
        assert np.allclose(now, bigrams(classes))


def test_rounds_gather_every_pair(spark):
    rng = np.random.default_rng(5)
    texts = [np.r_[rng.integers(0, 300, int(n)), 7].astype(np.uint16) for n in rng.integers(0, 60, 50)]
    df = spark.createDataFrame([(bytearray(t.tobytes()), False) for t in texts], "units binary, held_out boolean").repartition(4)
    classes = np.arange(300) % 6
    counted = brown.gather(df, classes, 6, 7)
    expected = np.zeros((6, 6))
    for t in texts:
        np.add.at(expected, (classes[np.r_[7, t[:-1]]], classes[t]), 1)
    assert np.array_equal(brown.class_bigrams(counted, classes, 6), expected)
    best, matrix, found = brown.cluster(df, 300, 6, 7, 4)
    assert max(found) > found[0] and brown.likelihood(matrix) == pytest.approx(max(found))


def test_a_task_has_one_python_worker(spark, monkeypatch, capsys):
    """Steps in Python are parted by a shuffle, and paths are counted in the step that finds them."""
    monkeypatch.setattr(brown, "settle", lambda df: df)
    unit = [0, 1, 2, 3, 2, 1]
    rows = [(i, bytearray(np.array(unit, np.uint16).tobytes()), bytearray(np.array([0, 1, 0], np.int32).tobytes()), i == 3) for i in range(8)]
    texts = spark.createDataFrame(rows, "row long, units binary, rest binary, held_out boolean").repartition(4)
    model = brown.Classes(np.arange(8) % 3, np.array([2, 1]), 2, 1)
    want = brown.path_bigrams(brown.with_paths(texts, model, False), 3, 1)
    assert np.array_equal(brown.path_bigrams(texts, 3, 1, model), want) and want.sum() == 7 * len(unit)
    capsys.readouterr()
    brown.gather(texts, np.arange(300) % 6, 6, 7).explain()
    steps = [line for line in capsys.readouterr().out.splitlines() if line.strip()]
    arrow = ["MapInArrow" in line for line in steps]
    assert sum(arrow) == 2 and not any(a and b for a, b in zip(arrow, arrow[1:]))


def test_probabilities_add_up(some_docs):
    bigrams = np.array([[3.0, 1.0], [0.0, 0.0]])
    steps = brown.transitions(bigrams, np.array([4.0, 0.0]))
    assert np.allclose((10**steps).sum(axis=1), 1)


def test_no_rows(no_docs, odd_docs):
    assert brown.score_texts(no_docs, **SMALL).count() == 0
    only_held = odd_docs.where("doc_id is not null and crc32(cast(doc_id as string)) % 7 = 2")
    found = brown.score_texts(only_held, **SMALL).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in found} == {(0, 0, 0.0)}


def test_many_exchanges_are_single_ones():
    rng = np.random.default_rng(6)
    n_classes, n_units = 5, 40
    text = rng.integers(0, n_units, 900) * rng.integers(0, 2, 900)
    classes = rng.integers(0, n_classes, n_units)
    now = np.zeros((n_classes, n_classes))
    np.add.at(now, (classes[text[:-1]], classes[text[1:]]), 1)
    counts = np.zeros((n_units, 2 * n_classes + 1), dtype=np.int64)
    for a, b in zip(text[:-1], text[1:]):
        counts[a, classes[b]] += 1
        counts[b, n_classes + classes[a]] += 1
        counts[a, 2 * n_classes] += a == b
    alone = [brown.exchange(counts[u], int(classes[u]), now.copy()) for u in range(n_units)]
    assert brown.exchange_many(counts, classes, now).tolist() == alone


def test_words_of_one_slot_part(spark):
    """Two groups of words, used in different places, share the only slot but not a class."""
    rng = np.random.default_rng(7)
    texts = []
    for i in range(300):
        pairs = [f"a b{rng.integers(0, 30)}" if rng.random() < 0.5 else f"c d{rng.integers(0, 30)}" for _ in range(20)]
        texts.append((i, " ".join(pairs), False))
    docs = spark.createDataFrame(texts, "row long, text string, held_out boolean").withColumn("doc_id", F.col("row"))
    counted = brown.count_words(docs).cache()
    for known in (1000, 20):
        dictionary = brown.Dictionary.of(counted, known, 3, 1)
        read = brown.read_texts(docs, dictionary).cache()
        classes, bigrams, _ = brown.cluster(read, 4, 6, dictionary.unit(b""), 3)
        paths, learnt, model, bigrams, found = brown.settle_words(read, counted, dictionary, classes, bigrams)
        assert found[2] > found[0] and brown.likelihood(bigrams) == pytest.approx(max(found))
        own = {bytes(r["word"]): r["class"] for r in learnt.collect()}
        own |= {w: int(model.words[i]) for w, i in dictionary.words.items()}
        groups = [{own[w] for w in own if w[:1] == g and len(w) > 1} for g in (b"b", b"d")]
        assert groups[0].isdisjoint(groups[1])
        of = [own[w] for w in tokens(texts[0][1])]
        assert paths.where("row = 0").first()["path"] == np.array(of, np.uint16).tobytes()
        assert brown.class_sizes(learnt, dictionary, model, 6)[0].tolist() == bigrams.sum(axis=0).tolist()


def test_words_are_those_of_bytes():
    """Arrow splits and lowers as ``bytes`` do, whatever the bytes."""
    rng = np.random.default_rng(8)
    some = [*b" \t\n\v\f\r" * 12, *range(256)]
    texts = [None, b"", b" \t", "É a\u00a0b\u0085c\u2003D\x1cE".encode(), *(bytes(rng.choice(some, n).tolist()) for n in range(200))]
    binary = pa.array(texts, pa.binary())
    words, sizes = brown.split_words(pa.Array.from_buffers(pa.string(), len(binary), binary.buffers())[1:])
    expected = [(t or b"").lower().split() for t in texts[1:]]
    assert sizes.tolist() == [len(w) for w in expected]
    names = brown.listed(words.dictionary.cast(pa.binary()))
    assert [names[i] for i in words.indices.to_numpy()] == [w for ws in expected for w in ws]


def test_counts_leave_in_few_bytes():
    """What a round shuffles of a block: three bytes a cell where counts are small, and any count survives."""
    rng = np.random.default_rng(9)
    for most, size in ((200, 3), (60_000, 4), (2**40, 10)):
        own = np.where(rng.random(8256) < 0.4, rng.integers(1, most, 8256), 0)
        places = np.flatnonzero(own)
        steps, counts = brown.narrow(np.diff(places, prepend=0)), brown.narrow(own[places])
        assert len(steps) + len(counts) <= size * len(places)
        assert np.array_equal(np.cumsum(brown.widened(steps, len(places))), places)
        assert np.array_equal(brown.widened(counts, len(places)), own[places])


def test_most_frequent_words_are_sorted_without_the_rare(spark):
    rows = [(f"w{i:03d}".encode(), 1 + i % 7 + 2000 * (i % 50 == 0)) for i in range(300)] + [(b"", 1), (b"x" * 99, 5000)]
    counted = spark.createDataFrame([(bytearray(w), n) for w, n in rows], "word binary, n long").repartition(3)
    ranked = [w for w, n in sorted(rows[:-1], key=lambda r: (r[0] != b"", -r[1], r[0]))]
    for known in (1, 4, 50, 290, 1000):
        assert list(brown.Dictionary.of(counted, known, 20, 4).words) == ranked[:known]


def test_texts_meet_their_sums_as_paths(spark, some_docs, monkeypatch):
    """The shuffle of the texts holds the class of each token, in a byte, not its unit and word."""
    settled, settle = [], brown.settle
    monkeypatch.setattr(brown, "settle", lambda df, **options: settled.append(df) or settle(df, **options))
    brown.score_texts(some_docs, **SMALL).collect()
    plan = next(df for df in settled if "more_logs" in df.columns)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join LeftOuter", 1)
    assert "units#" not in above and "units#" in below
