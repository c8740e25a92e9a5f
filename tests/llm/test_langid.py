from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from ratepanel.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.95


def test_segments_count_what_a_loop_counts(odd_rows, monkeypatch):
    monkeypatch.setattr(langid, "SEGMENT", 37)
    texts = [(r[1] or "")[:500] for r in odd_rows]
    data, edges = langid.raw(pa.array(["skip", *texts], pa.string()).slice(1))
    found = [[] for _ in texts]
    for grams, counts, at, begins in langid.segments(data, edges):
        for t, a, b in zip(at, begins, np.r_[begins[1:], len(grams)]):
            found[t] += [int(g) for g, c in zip(grams[a:b], counts[a:b]) if c]
    for text, got in zip(texts, found):
        raw = bytes(langid.FOLD[list(text.encode())])
        whole = [raw[i : i + 4] for i in range(len(raw) - 3)]
        assert got == [int.from_bytes(g, "little") for g in whole if g.count(b" ") <= 1]


def test_filters_hold_what_was_learnt(spark, some_docs):
    filters = langid.learn(some_docs)
    kept = langid.count_grams(some_docs.where("lang = 'de'")).where("n > 20").collect()
    grams = np.array([r["gram"] for r in kept], dtype=np.uint32)
    at = langid.places(grams, filters.bits)
    mask = filters.table[0][at[0]] & filters.table[0][at[1]] & filters.table[0][at[2]]
    assert ((mask >> filters.langs.index("de")) & 1).mean() > 0.5
    wrong = filters.false_positives()
    assert (wrong < 0.05).all()
    strange = np.random.default_rng(3).integers(0, 2**32, 200_000, dtype=np.uint32)
    at = langid.places(strange, filters.bits)
    mask = filters.table[0][at[0]] & filters.table[0][at[1]] & filters.table[0][at[2]]
    for i in range(len(filters.langs)):
        assert abs(((mask >> i) & 1).mean() - wrong[i]) < 0.002


def test_many_languages(spark):
    rows = [(f"{chr(0x4E00 + i)}{chr(0x5E00 + i)} " * 5, f"l{i:03}") for i in range(70)]
    filters = langid.learn(spark.createDataFrame(rows, "text string, lang string"))
    names, _ = filters.predict(pa.array([t for t, _ in rows], pa.string()))
    assert names == [g for _, g in rows]


def test_odd_rows(odd_docs, odd_rows, no_docs):
    found = langid.identify(odd_docs).collect()
    assert len(found) == len(odd_rows)
    learnt = {r[2] for r in odd_rows} - {None} | {"und"}
    assert all(r["lang_pred"] in learnt and 0 <= r["score"] <= 1 for r in found)
    undecided = {r["doc_id"] for r in found if r["lang_pred"] == "und"}
    assert undecided == {2, 3, 4, 12, None}
    assert langid.identify(no_docs).count() == 0
    nothing = langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}


def grams_of(text):
    raw = bytes(langid.FOLD[list(text.encode())])
    whole = [raw[i : i + 4] for i in range(len(raw) - 3)]
    return [g for g in whole if g.count(b" ") <= 1]


def by_sets(learnt, texts):
    """What sets in place of the filters answer: the language and the score of each text."""
    counts = {}
    for text, lang in learnt:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(grams_of(text))
    counts = dict(sorted(counts.items()))
    foreign = []
    for lang, own in counts.items():
        others = [sum(n for g, n in c.items() if g in own) / c.total() for x, c in counts.items() if x != lang and c]
        foreign.append(sum(others) / max(1, len([c for c in counts.values() if c]) - 1) if own else 0.0)
    out = []
    for text in texts:
        grams = grams_of(text or "")
        shares = [(sum(g in own for g in grams) / max(1, len(grams)) - f) / (1 - f) for own, f in zip(counts.values(), foreign)]
        whole = sum(max(0.0, x) for x in shares)
        out.append((list(counts)[int(np.argmax(shares))], max(0.0, *shares) / whole if whole else 0.0))
    return out


@pytest.mark.parametrize("which", ["odd", "some"])
def test_filters_answer_as_sets(which, spark, odd_rows, some_rows):
    rows = odd_rows if which == "odd" else some_rows
    learnt = [(r[1], r[2]) for r in rows]
    filters = langid.learn(spark.createDataFrame(learnt, "text string, lang string"))
    texts = [r[1] for r in rows if r[1] and len(grams_of(r[1])) >= 20 and any(c.isalpha() for c in r[1])]
    names, score = filters.predict(pa.array(texts, pa.string()))
    expected = by_sets(learnt, texts)
    assert texts and np.abs(score - [s for _, s in expected]).max() < 0.02
    assert sum(a != b for a, (b, _) in zip(names, expected)) <= len(texts) // 200


def test_a_language_of_one_sentence(spark, some_rows):
    dutch = [
        "De kat zat gisteren rustig op de mat terwijl het buiten hard regende en de kinderen speelden.",
        "Wij gingen naar het strand om schelpen te zoeken maar vonden alleen een oude schoen.",
    ]
    for known in (1, 2):
        learnt = [(r[1], r[2]) for r in some_rows] + [(text, "nl") for text in dutch[:known]]
        filters = langid.learn(spark.createDataFrame(learnt, "text string, lang string"))
        names, _ = filters.predict(pa.array(dutch[:known] + [r[1] for r in some_rows if r[1]], pa.string()))
        assert names[:known] == ["nl"] * known
        assert names.count("nl") == known
