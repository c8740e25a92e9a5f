"""Substring deduplication by content-defined blocks and window hashes.

A window is ``WINDOW`` consecutive words. Every window is anchored at the least hash of the
``GRAM``-word sequences in it, so equal windows have equal anchors wherever they stand.
Consecutive windows of a document with one anchor form a *block*: the words they span,
``WINDOW`` at least. All blocks of all documents are the reference, indexed by anchor
and content. This replaces a greedy relative Lempel-Ziv parse: no phrase is matched and
extended, because a join on blocks needs no copy of the reference in a task, and takes the same
words. A block that the reference
holds for a smaller doc_id is a factor, long enough by itself, and all its words are a
duplicate span; factors that follow each other run together. At factor boundaries, that is
in blocks that no smaller document holds but whose anchor others share with other content
around it, the windows are checked one by one against the windows of those blocks.

Blocks reach a comparison only if their anchor occurs in two documents. That filter is a
Bloom filter of at most ``2 ** MOST_BITS`` bits, sized by the anchors it holds; a false hit
costs a row, never a result, and texts are shuffled once, to meet their spans. Only sums
and joins on anchors and contents, partly aggregated first, touch hot passages.

Sequences are compared by 64-bit hash together with their anchor's, so by 128 bits.

Defined results: null and empty texts have no words; documents without id neither give nor
take windows; rows with one doc_id are one document as far as order goes, and each is
answered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratepanel.llm.common import byte_texts, chunks, text_key
from ratepanel.session import settle

WINDOW = 50
GRAM = 16
RUN = 64
LONG_WORD = 1024
MOST_BITS = 28
BLOOM_HASHES = 4
PARTS = 64
CHUNK = 4_000_000

WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


WEIGHTS = mixed(np.arange(1, LONG_WORD + 1, dtype=np.uint64) * ODD) | np.uint64(1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of the texts, and where each text's words begin and the last end."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    white = WHITE[data]
    starts = np.flatnonzero(~white & np.r_[True, white[:-1]])
    stops = np.flatnonzero(white & np.r_[False, ~white[:-1]])
    edges = np.r_[0, np.searchsorted(starts, ends)]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), edges
    lengths = stops - starts
    letters = np.flatnonzero(~white)
    place = letters - np.repeat(starts, lengths)
    parts = (data[letters].astype(np.uint64) + np.uint64(1)) * WEIGHTS[np.minimum(place, LONG_WORD - 1)]
    found = mixed(np.add.reduceat(parts, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64) * ODD)
    for i in np.flatnonzero(lengths > LONG_WORD):
        found[i] = xxhash.xxh64_intdigest(data[starts[i] : stops[i]].tobytes())
    return found, edges


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    done, out = 1, values
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: len(out) - (width - done)], out[width - done :]) if done < width else out


@dataclass
class Sums:
    """Prefix sums over words, for the hash of any sequence of them."""

    sums: np.ndarray
    back: np.ndarray

    @classmethod
    def over(cls, words: np.ndarray) -> Sums:
        powers = np.full(len(words) + 1, ODD, dtype=np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        back = np.full(len(words) + 1, pow(int(ODD), -1, 2**64), dtype=np.uint64)
        back[0] = 1
        return cls(np.r_[np.zeros(1, np.uint64), np.cumsum(words * powers[:-1])], np.cumprod(back))

    def hashes(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[begins]) * self.back[begins] + (ends - begins).astype(np.uint64) * ODD)


@dataclass
class Blocks:
    """Blocks of some texts: which text, anchor, content, first window in the text, windows; and all windows' hashes."""

    text: np.ndarray
    anchor: np.ndarray
    content: np.ndarray
    first: np.ndarray
    size: np.ndarray
    at: np.ndarray
    sums: Sums

    def windows(self, block: int) -> np.ndarray:
        begins = self.at[block] + np.arange(self.size[block])
        return self.sums.hashes(begins, begins + WINDOW)


def cut_blocks(texts: list[bytes]) -> Blocks:
    words, edges = word_hashes(texts)
    sums = Sums.over(words)
    none = np.zeros(0, np.int64)
    if len(words) < WINDOW:
        return Blocks(none, none.astype(np.uint64), none.astype(np.uint64), none, none, none, sums)
    starts = np.arange(len(words) - GRAM + 1)
    least = least_of(sums.hashes(starts, starts + GRAM), WINDOW - GRAM + 1)
    owner = np.repeat(np.arange(len(texts)), np.diff(edges))
    whole = owner[: len(least)] == owner[WINDOW - 1 :]  # windows within one text
    at = np.flatnonzero(whole)
    if not len(at):
        return Blocks(none, none.astype(np.uint64), none.astype(np.uint64), none, none, none, sums)
    least, owner = least[at], owner[at]
    new = np.r_[True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])]
    run = np.flatnonzero(new)
    since = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
    begin = np.flatnonzero(since % RUN == 0)
    size = np.diff(np.r_[begin, len(at)])
    return Blocks(
        owner[begin],
        least[begin],
        sums.hashes(at[begin], at[begin] + size + WINDOW - 1),
        at[begin] - edges[owner[begin]],
        size,
        at[begin],
        sums,
    )


# --- Bloom filter -----------------------------------------------------------


def bloom_places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    x = mixed(keys.view(np.uint64))
    step = mixed(x) | np.uint64(1)
    return [(x + np.uint64(i) * step) >> np.uint64(64 - bits) for i in range(BLOOM_HASHES)]


def bloom(keys: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """Bits, packed in 64-bit words, of the filter of the one column of ``keys``."""
    n = keys.count()
    bits = min(most_bits, max(16, int(np.ceil(np.log2(16 * n + 1)))))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in bloom_places(batch.column(0).to_numpy(), bits):
                bit = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
                yield pa.record_batch([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bit)], ["word", "bit"])

    size = (1 << bits) // 64
    share = max(1, size // PARTS)

    def packed(key: tuple, found: pa.Table) -> pa.Table:
        part = np.zeros(share, dtype=np.int64)
        part[found.column("word").to_numpy() % share] = found.column("mask").to_numpy()
        return pa.table({"part": [key[0].as_py()], "bits": pa.array([part.tobytes()], pa.binary())})

    words = keys.mapInArrow(positions, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("mask"))
    parts = words.withColumn("part", F.floor(F.col("word") / share)).groupBy("part").applyInArrow(packed, "part long, bits binary")
    out = np.zeros(size, dtype=np.uint64)
    for r in parts.collect():
        out[r["part"] * share : (r["part"] + 1) * share] = np.frombuffer(r["bits"], dtype=np.uint64)
    return out


def held_by(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = int(len(filter_) * 64).bit_length() - 1
    found = np.ones(len(keys), dtype=bool)
    for at in bloom_places(keys, bits):
        found &= (filter_[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


# --- passes -----------------------------------------------------------------


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def anchors(rows: DataFrame) -> DataFrame:
    """First pass: ``anchor, shared, contested`` of the anchors that several documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, limit=CHUNK):
                found = cut_blocks(list(byte_texts(batch.column("text"))))
                docs = batch.column("doc_id").take(pa.array(found.text))
                yield pa.record_batch([signed(found.anchor), signed(found.content), docs], ["anchor", "content", "doc_id"])

    found = rows.select("doc_id", "text").mapInArrow(run, "anchor long, content long, doc_id long")
    ends = found.groupBy("anchor").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("content").alias("one"), F.max("content").alias("other")
    )
    return ends.where(F.col("low") < F.col("high")).select("anchor", (F.col("one") != F.col("other")).alias("contested"))


def shared_blocks(rows: DataFrame, shared: np.ndarray, contested: np.ndarray) -> DataFrame:
    """Second pass: the blocks whose anchor may be shared, with their windows where it may be contested."""
    spark = rows.sparkSession
    filters = spark.sparkContext.broadcast((shared, contested))
    names = ["doc_id", "text_hash", "anchor", "content", "first", "size", "windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, contested = filters.value
        for whole in batches:
            for batch in chunks(whole, limit=CHUNK):
                found = cut_blocks(list(byte_texts(batch.column("text"))))
                take = np.flatnonzero(held_by(shared, found.anchor))
                open_ = held_by(contested, found.anchor[take])
                windows = [found.windows(b).tobytes() if o else None for b, o in zip(take, open_)]
                docs = pa.array(found.text[take])
                columns = [batch.column("doc_id").take(docs), batch.column("text_hash").take(docs)]
                columns += [signed(found.anchor[take]), signed(found.content[take])]
                columns += [pa.array(found.first[take]), pa.array(found.size[take])]
                yield pa.record_batch([*columns, pa.array(windows, pa.binary())], names)

    kinds = "doc_id long, text_hash long, anchor long, content long, first long, size long, windows binary"
    return rows.mapInArrow(run, kinds)


def exploded(blocks: DataFrame) -> DataFrame:
    """``doc_id, text_hash, anchor, window, first``: a row per window of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            of = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            nth = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            found = np.frombuffer(b"".join(batch.column("windows").to_pylist()), dtype=np.int64)
            first = np.repeat(batch.column("first").to_numpy(), sizes) + nth
            columns = [batch.column(c).take(of) for c in ("doc_id", "text_hash", "anchor")]
            yield pa.record_batch([*columns, pa.array(found), pa.array(first)], ["doc_id", "text_hash", "anchor", "window", "first"])

    kept = blocks.select("doc_id", "text_hash", "anchor", "first", "size", "windows")
    return kept.mapInArrow(run, "doc_id long, text_hash long, anchor long, window long, first long")


def duplicate_spans(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """``doc_id, text_hash, first, size``: runs of windows that smaller documents hold too."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_hash"), "text")
    index = settle(anchors(rows))
    shared = bloom(index.select("anchor"), most_bits)
    contested = bloom(index.where("contested").select("anchor"), most_bits)
    blocks = settle(shared_blocks(rows, shared, contested))
    key = ["anchor", "content"]
    # Written out, so that the joins below shuffle both sides and hot keys can be split.
    lowest = settle(blocks.groupBy(*key).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")))
    several = lowest.where(F.col("low") < F.col("high")).select(*key, "low")
    factors = blocks.drop("windows").join(several, key).where(F.col("doc_id") > F.col("low"))
    held = blocks.where(F.col("windows").isNotNull()).join(lowest.drop("high"), key).where(F.col("doc_id") == F.col("low"))
    windows = settle(exploded(held))
    first = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    first = settle(first.where(F.col("low") < F.col("high")).drop("high"))
    checked = windows.join(first, ["anchor", "window"]).where(F.col("doc_id") > F.col("low"))
    spans = factors.select("doc_id", "text_hash", "first", "size")
    return spans.unionByName(checked.select("doc_id", "text_hash", "first", F.lit(1).cast("long").alias("size")))


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def kept_words(text: bytes, spans: list[dict]) -> tuple[int, list[bytes]]:
    words = text.split()
    if not spans:
        return len(words), words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for span in spans:
        change[span["first"]] += 1
        change[span["first"] + span["size"] + WINDOW - 1] -= 1
    return len(words), [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def with_spans(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """``doc_id, text, spans`` for each row of ``docs``."""
    spans = duplicate_spans(docs, most_bits).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "size")).alias("spans"))
    spans = settle(spans.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "spans"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    same = (rows["doc_id"] == spans["_id"]) & (F.xxhash64(rows["text"]) == spans["_hash"])
    return rows.join(spans, same, "left").select("doc_id", "text", "spans")


def deduplicate(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """``doc_id, text`` with the duplicate spans' words taken out, one space between words."""

    @F.arrow_udf("string")
    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        kept = (b" ".join(kept_words(t, s.as_py() or [])[1]).decode() for t, s in zip(byte_texts(texts), spans))
        return pa.array(kept, pa.string())

    return with_spans(docs, most_bits).select("doc_id", run("text", "spans").alias("text"))


def digest(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                words, removed, sums = [], [], []
                for text, spans in zip(byte_texts(batch.column("text")), batch.column("spans")):
                    n, kept = kept_words(text, spans.as_py() or [])
                    words.append(n)
                    removed.append(n - len(kept))
                    sums.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                columns = [pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums, pa.string())]
                yield pa.record_batch([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return with_spans(docs, most_bits).mapInArrow(run, RESULT)
