"""Language identification with bit-sliced Bloom filters of n-grams.

One table of positions holds a bit for each language, so looking an n-gram up at its
positions and taking the bits common to all gives the languages that contain it. A text's
n-grams are counted for each language by those bits; the share with which a language's
filter says yes to text that is not its own is taken off; the language with the
largest share of the n-grams decides.

An n-gram is four bytes of the text with ASCII letters lower-cased and other ASCII
turned into spaces, with at most one space. A language contains every n-gram that its
texts hold. A filter is wrong in two ways: by chance, known from its fill, and because languages
have n-grams in common: the share of the other languages' text, each weighing the same, that a
language contains. A language learnt from much text contains more of the others, and more is taken off. The
filter's size is a power of two with ``ROOM`` positions for each n-gram of the largest
language, at most ``2 ** MOST_BITS``; a fuller filter only answers yes more often, which is corrected for.

Defined results: ``und`` with score 0 if the text is null or has no letter, or nothing was
learnt; a text with letters but no known n-gram gets the language with most n-grams,
score 0; ties go to the smaller name. Rows without language are not learnt from. Repeated
rows count and are answered each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratepanel.llm.common import remainder
from ratepanel.session import settle

GRAM = 4
HASHES = 3
ROOM = 16
MOST_BITS = 24
SEGMENT = 2_000_000
RANGES = 64

LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = True
FOLD = np.full(256, 32, dtype=np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column one after the other, and where each text begins and the last ends."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    found = np.frombuffer(data, dtype=np.uint8)[edges[0] : edges[-1]] if data else np.zeros(0, np.uint8)
    return found, edges - edges[0]


def segments(data: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """N-grams piece by piece: the n-grams, whether each counts, the texts in the piece, and where each begins."""
    for start in range(0, len(data), SEGMENT):
        stop = min(start + SEGMENT, len(data))
        part = FOLD[data[start : stop + GRAM - 1]]
        part = np.concatenate([part, np.full(stop - start + GRAM - 1 - len(part), 32, np.uint8)])
        grams = np.zeros(stop - start, dtype=np.uint32)
        spaces = np.zeros(stop - start, dtype=np.uint8)
        for i in range(GRAM):
            piece = part[i : i + stop - start]
            grams |= piece.astype(np.uint32) << np.uint32(8 * i)
            spaces += piece == 32
        counts = spaces <= 1
        first, last = np.searchsorted(edges, start, side="right") - 1, np.searchsorted(edges, stop, side="left")
        texts = np.arange(first, last)
        texts = texts[edges[texts + 1] > edges[texts]]
        for back in range(1, GRAM):  # n-grams that begin in the last bytes of a text run over its end
            over = edges[texts + 1] - back
            counts[over[(over >= np.maximum(start, edges[texts])) & (over < stop)] - start] = False
        yield grams, counts, texts, np.maximum(edges[texts] - start, 0)


def places(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    """The positions of each n-gram in a filter of ``2 ** bits``."""
    x = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    step = (x >> np.uint64(8)) | np.uint64(1)
    return [((x >> np.uint64(32)) + np.uint64(i) * step) & np.uint64((1 << bits) - 1) for i in range(HASHES)]


def count_grams(rows: DataFrame) -> DataFrame:
    """``lang, gram, n`` over ``text, lang``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("lang").dictionary_encode()
            codes = names.indices.to_numpy().astype(np.uint64)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for grams, counts, texts, begins in segments(*raw(batch.column("text"))):
                own = np.repeat(codes[texts], np.diff(np.r_[begins, len(grams)]))
                found.append(np.unique(((own << np.uint64(32)) | grams)[counts], return_counts=True))
            if not found:
                continue
            keys, n = (np.concatenate(x) for x in zip(*found))
            keys, back = np.unique(keys, return_inverse=True)
            n = np.bincount(back, weights=n, minlength=len(keys)).astype(np.int64)
            lang = names.dictionary.take(pa.array((keys >> np.uint64(32)).astype(np.int64)))
            gram = pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64))
            yield pa.record_batch([lang, gram, pa.array(n)], ["lang", "gram", "n"])

    counted = rows.select("text", "lang").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Filters:
    """``table[s, p]``: bits of the languages ``s * width`` onwards at position ``p``.

    ``foreign`` is the share of other languages' n-grams that each language contains.
    """

    langs: list[str]
    bits: int
    width: int
    table: np.ndarray
    common: str
    foreign: np.ndarray

    def false_positives(self) -> np.ndarray:
        fill = [
            np.count_nonzero((self.table[i // self.width] >> self.table.dtype.type(i % self.width)) & self.table.dtype.type(1))
            for i in range(len(self.langs))
        ]
        return (np.array(fill) / self.table.shape[1]) ** HASHES

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        data, edges = raw(column)
        hits = np.zeros((len(self.langs), len(column)), dtype=np.int64)
        total = np.zeros(len(column), dtype=np.int64)
        letters = np.zeros(len(column), dtype=bool)
        start, one = 0, self.table.dtype.type(1)
        for grams, counts, texts, begins in segments(data, edges):
            ascii_letters = np.add.reduceat(LETTERS[data[start : start + len(grams)]], begins, dtype=np.int64)
            letters[texts] |= ascii_letters > 0
            start += len(grams)
            total[texts] += np.add.reduceat(counts, begins, dtype=np.int64)
            at = places(grams, self.bits)
            for s in range(len(self.table)):
                mask = self.table[s][at[0]]
                for p in at[1:]:
                    mask &= self.table[s][p]
                mask *= counts
                for b in range(min(self.width, len(self.langs) - s * self.width)):
                    bit = (mask >> self.table.dtype.type(b)) & one
                    hits[s * self.width + b][texts] += np.add.reduceat(bit, begins, dtype=np.int64)
        for i in np.flatnonzero(~letters & (np.diff(edges) > 0)):
            letters[i] = any(c.isalpha() for c in column[int(i)].as_py())
        if not self.langs:
            return ["und"] * len(column), np.zeros(len(column))
        chance = self.false_positives()
        wrong = (chance + self.foreign * (1.0 - chance))[:, None]
        corrected = (hits / np.maximum(total, 1) - wrong) / np.maximum(1.0 - wrong, 1e-9)
        shares = np.maximum(0.0, corrected)
        best, whole, known = corrected.argmax(axis=0), shares.sum(axis=0), hits.any(axis=0)
        score = np.where(letters & (whole > 0), shares.max(axis=0) / np.maximum(whole, 1e-12), 0.0)
        names = [("und" if not letter else self.langs[i] if k else self.common) for letter, i, k in zip(letters, best, known)]
        return names, score


def learn(rows: DataFrame) -> Filters:
    """Filters from ``text, lang``; rows without either are left out."""
    known = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = settle(count_grams(known))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("whole"))
    sizes = {r["lang"]: r["whole"] for r in totals.collect()}
    langs = sorted({r["lang"] for r in known.select("lang").distinct().collect()}, key=lambda x: x.encode())
    common = min(langs, key=lambda x: (-sizes.get(x, 0), x.encode()), default="und")
    rates = counted.join(totals, "lang").withColumn("rate", F.col("n") / F.col("whole"))
    tops = rates.groupBy("gram").agg(F.sum("rate").alias("every"))
    shared = rates.join(tops, "gram").groupBy("lang").agg(F.count(F.lit(1)).alias("grams"), F.sum(F.col("every") - F.col("rate")).alias("others"))
    facts = {r["lang"]: r for r in shared.collect()}
    largest = max((r["grams"] for r in facts.values()), default=1)
    foreign = [min(1.0, max(0.0, facts[x]["others"] / (len(sizes) - 1))) if x in facts and len(sizes) > 1 else 0.0 for x in langs]
    bits = min(MOST_BITS, max(16, int(np.ceil(np.log2(ROOM * largest)))))
    width = 8 if len(langs) <= 8 else 64
    kind = np.uint8 if width == 8 else np.uint64
    table = np.zeros((max(1, -(-len(langs) // width)), 1 << bits), dtype=kind)

    numbers = {lang: i for i, lang in enumerate(langs)}

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = np.array([numbers[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            bit = np.left_shift(np.int64(1), number % width)
            for at in places(batch.column("gram").to_numpy().astype(np.uint32), bits):
                yield pa.record_batch([pa.array(number // width), pa.array(at.astype(np.int64)), pa.array(bit)], ["slice", "place", "bit"])

    slices = (
        counted.select("gram", "lang").mapInArrow(positions, "slice long, place long, bit long")
        .groupBy("slice", "place")
        .agg(F.bit_or("bit").alias("mask"))
        .withColumn("range", F.shiftright("place", max(0, bits - 6)))
    )

    def filled(key: tuple, found: pa.Table) -> pa.Table:
        size = 1 << max(0, bits - 6)
        part = np.zeros(size, dtype=kind)
        part[found.column("place").to_numpy() % size] = found.column("mask").to_numpy().view(np.uint64).astype(kind)
        return pa.table({"slice": [key[0].as_py()], "range": [key[1].as_py()], "part": pa.array([part.tobytes()], pa.binary())})

    for r in slices.groupBy("slice", "range").applyInArrow(filled, "slice long, range long, part binary").collect():
        part = np.frombuffer(r["part"], dtype=kind)
        table[r["slice"], r["range"] * len(part) : (r["range"] + 1) * len(part)] = part
    return Filters(langs, bits, width, table, common, np.round(foreign, 9))


def predict_column(docs: DataFrame, filters: Filters) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(vars(filters))

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def run(texts: pa.Array) -> pa.Array:
        names, score = Filters(**shared.value).predict(texts)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return run(F.col("text"))


def identify(docs: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row; rows whose ``remainder`` is ``held`` are not learnt from."""
    held_out = remainder(F.col("doc_id"), folds) == held
    filters = learn(docs.where(~held_out).select("text", "lang"))
    found = docs.select("doc_id", held_out.alias("held_out"), predict_column(docs, filters).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")
