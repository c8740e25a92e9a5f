"""Benchmark decontamination with a BM25 index and block-max WAND.

Test items, cut into pieces of up to ``PIECE`` words, form an inverted index. A posting
holds the share of its piece's own BM25 score that the word brings, so a passage with
all words of a piece scores 1. Every document is read as passages of ``2 * PIECE``
words, one every ``PIECE`` words, so any piece quoted whole lies in some passage. Each
passage is a query; block-max WAND returns every piece with a score of ``THRESHOLD`` or
more: passages whose words' largest shares do not add up to it are done at once, then
blocks of pieces are ruled out by the words' largest shares in the block, and the
postings of what is left are walked in order. Pieces found are verified by the share of
shingles that occur around the passage, ``OVERLAP`` at least. Where a question mark has words
on both sides, the last one ends the question, the rest is the answer, and both must reach
it, the question by shingles of five words, the answer of three. Any other item is one part: its
shingles, or those of the piece found, must reach it, so a quoted piece is enough. They have
five words, fewer in parts under fourteen, where one changed word would break over half.

Words are lower-cased; ASCII punctuation separates words. Word statistics come from
all items. The index goes to the executors in chunks of at most ``POSTINGS`` postings, so
its size is bounded whatever the benchmark's. Documents are read once per chunk and
never shuffled.

Defined results: null or empty texts match nothing; items of fewer than ``LEAST`` words
are no evidence and match nothing; repeated rows of documents are reported each, repeated
items once; different items with one item_id are matched and reported each on its own.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratepanel.llm.common import byte_texts, chunks, identified, without
from ratepanel.session import settle

PIECE = 32
BLOCK = 8
THRESHOLD = 0.6
OVERLAP = 0.5
QUESTION_SHINGLE = 5
ANSWER_SHINGLE = 3
LEAST = 5
POSTINGS = 2_000_000
CELLS = 4_000_000
K1, B = 1.2, 0.75

SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
PLAIN = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))


def plain_words(text: str) -> list[bytes]:
    return text.lower().encode().translate(PLAIN).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """An item without a marked answer is all question."""
    head, mark, tail = text.rpartition("?")
    question, answer = plain_words(head), plain_words(tail)
    if mark and question and answer:
        return question, answer
    return plain_words(text), []


def shingles(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()


def part_shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """Shingles of which one changed word leaves half."""
    return shingles(words, max(1, min(QUESTION_SHINGLE, (len(words) + 1) // 3)))


def share_of(part: set, around: list[bytes]) -> float:
    return len(part & shingles_of(around, part)) / len(part) if part else 1.0


def cut_pieces(words: list[bytes], longest: int = PIECE) -> list[list[bytes]]:
    parts = -(-len(words) // longest)
    edges = [len(words) * i // parts for i in range(parts + 1)] if parts else [0]
    return [words[a:b] for a, b in zip(edges, edges[1:])]


def build_postings(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``chunk, item, item_id, piece, word, share``, a row per piece and word, and the items."""
    pieces_type = "array<array<binary>>"

    @F.arrow_udf(pieces_type)
    def pieces(texts: pa.Array) -> pa.Array:
        found = []
        for text in texts:
            words = plain_words(text.as_py() or "")
            found.append(cut_pieces(words) if len(words) >= LEAST else [])
        return pa.array(found, pa.list_(pa.list_(pa.binary())))

    named = items.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    named = named.withColumn("item", F.xxhash64("item_id", "text"))
    cut = named.select("item", "item_id", F.posexplode(pieces(F.col("text"))).alias("piece", "words"))
    cut = cut.withColumn("length", F.size("words"))
    counts = cut.select("item", "item_id", "piece", "length", F.explode("words").alias("word"))
    counts = settle(counts.groupBy("item", "item_id", "piece", "length", "word").agg(F.count(F.lit(1)).alias("tf")))
    sizes = counts.select("item", "piece", "length").distinct().agg(F.count(F.lit(1)), F.avg("length")).first()
    total, mean = sizes[0], sizes[1] or 1.0
    spread = counts.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log1p((F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
    weighed = counts.join(spread, "word").withColumn("weight", idf * tf)
    sums = weighed.groupBy("item", "piece").agg(F.sum("weight").alias("whole"))
    shares = weighed.join(sums, ["item", "piece"]).withColumn("share", F.col("weight") / F.col("whole"))
    n_chunks = max(1, -(-counts.count() // POSTINGS))
    return settle(shares.select(F.pmod("item", F.lit(n_chunks)).alias("chunk"), "item", "item_id", "piece", "word", "share")), named


@dataclass
class Index:
    """Postings of one chunk of the items, by piece in order, with the largest share of each word and block."""

    words: dict[bytes, int] = field(default_factory=dict)
    owners: list[int] = field(default_factory=list)
    postings: list[tuple[list[int], list[float]]] = field(default_factory=list)
    largest: np.ndarray = field(default_factory=lambda: np.zeros(1))
    block_at: np.ndarray = field(default_factory=lambda: np.zeros(2, np.int64))
    block_of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    block_most: np.ndarray = field(default_factory=lambda: np.zeros(0))
    by_block: np.ndarray | None = None
    items: list[tuple[int, set, set, int]] = field(default_factory=list)
    pieces: list[set | None] = field(default_factory=list)

    @classmethod
    def build(cls, rows: list, texts: dict[int, tuple[int, str]]) -> Index:
        """``rows`` are ``item, piece, word, share``; ``texts`` maps items to their id and text."""
        self = cls()
        numbers: dict[tuple[int, int], int] = {}
        item_numbers = {item: i for i, item in enumerate(sorted(texts))}
        parts: dict[int, list[set]] = {}
        for item in sorted(texts):
            item_id, text = texts[item]
            question, answer = question_and_answer(text)
            asked = shingles(question, QUESTION_SHINGLE) if answer else part_shingles(question)
            self.items.append((item_id, asked, shingles(answer, ANSWER_SHINGLE), len(question) + len(answer)))
            cut = cut_pieces(question)
            parts[item] = [] if answer or len(cut) == 1 else [part_shingles(words) for words in cut]
        for item, piece in sorted({(r["item"], r["piece"]) for r in rows}):
            numbers[item, piece] = len(self.owners)
            self.owners.append(item_numbers[item])
            self.pieces.append(parts[item][piece] if parts[item] else None)
        lists: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        for r in rows:
            lists[bytes(r["word"])].append((numbers[r["item"], r["piece"]], r["share"]))
        self.postings.append(([], []))
        blocks: list[list[tuple[int, float]]] = [[]]
        for number, word in enumerate(sorted(lists), start=1):
            self.words[word] = number
            found = sorted(lists[word])
            self.postings.append(([p for p, _ in found], [s for _, s in found]))
            most: dict[int, float] = {}
            for p, s in found:
                most[p // BLOCK] = max(most.get(p // BLOCK, 0.0), s)
            blocks.append(sorted(most.items()))
        self.block_at = np.cumsum([0] + [len(b) for b in blocks])
        self.block_of = np.array([n for b in blocks for n, _ in b], dtype=np.int64)
        self.block_most = np.array([s * (1 + 1e-9) for b in blocks for _, s in b])
        self.largest = np.array([max((s * (1 + 1e-9) for _, s in b), default=0.0) for b in blocks])
        n_blocks = -(-len(self.owners) // BLOCK)
        if len(blocks) * n_blocks <= CELLS:
            self.by_block = np.zeros((len(blocks), n_blocks))
            self.by_block[np.repeat(np.arange(len(blocks)), np.diff(self.block_at)), self.block_of] = self.block_most
        return self

    def block_bounds(self, terms: np.ndarray) -> np.ndarray:
        """The most that the terms can score in each block, from a full table if it is small."""
        if self.by_block is not None:
            return self.by_block[terms].sum(axis=0)
        sizes = self.block_at[terms + 1] - self.block_at[terms]
        at = np.arange(int(sizes.sum())) + np.repeat(self.block_at[terms] - np.cumsum(sizes) + sizes, sizes)
        return np.bincount(self.block_of[at], weights=self.block_most[at], minlength=1)

    def search(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Pieces whose score over the distinct ``terms`` is at least ``threshold``, by block-max WAND."""
        open_blocks = self.block_bounds(terms) >= threshold
        if not open_blocks.any():
            return []
        found = []
        # A cursor: current piece, word, place in its postings.
        cursors = [[self.postings[t][0][0], int(t), 0] for t in terms]

        def advance(cursor: list[int], piece: int) -> bool:
            pieces = self.postings[cursor[1]][0]
            cursor[2] = at = bisect_left(pieces, piece, cursor[2])
            if at < len(pieces):
                cursor[0] = pieces[at]
            return at < len(pieces)

        most = {int(t): float(self.largest[t]) for t in terms}
        while cursors:
            cursors.sort()
            total, pivot = 0.0, None
            for cursor in cursors:
                total += most[cursor[1]]
                if total >= threshold:
                    pivot = cursor[0]
                    break
            if pivot is None:
                return found
            block = pivot // BLOCK
            if not open_blocks[block]:
                cursors = [c for c in cursors if c[0] >= (block + 1) * BLOCK or advance(c, (block + 1) * BLOCK)]
            elif cursors[0][0] == pivot:
                score = sum(self.postings[c[1]][1][c[2]] for c in cursors if c[0] == pivot)
                if score >= threshold:
                    found.append((pivot, score))
                cursors = [c for c in cursors if c[0] > pivot or advance(c, pivot + 1)]
            else:
                cursors = [c for c in cursors if c[0] >= pivot or advance(c, pivot)]
        return found

    def matches(self, texts: list[str], threshold: float, overlap: float) -> Iterator[tuple[int, int, float, float, float | None, int]]:
        """For each text and item found in it: their places, the best score and overlaps, and the
        passages. Without a marked answer its overlap is null."""
        split = [plain_words(t) for t in texts]
        sizes = np.array([len(w) for w in split], dtype=np.int64)
        total = int(sizes.sum())
        ids = np.fromiter((i for w in split for i in map(self.words.get, w, repeat(0))), dtype=np.int32, count=total)
        reach = np.concatenate([[0.0], np.cumsum(self.largest[ids], dtype=np.float64)])
        steps = np.maximum(1, -(-(sizes - PIECE) // PIECE))  # passages of each text
        text_of = np.repeat(np.arange(len(texts)), steps)
        first = np.cumsum(sizes) - sizes
        nth = np.arange(int(steps.sum())) - np.repeat(np.cumsum(steps) - steps, steps)
        begins = first[text_of] + nth * PIECE
        ends = np.minimum(begins + 2 * PIECE, first[text_of] + sizes[text_of])
        best: dict[tuple[int, int], list] = {}
        for at in np.flatnonzero(reach[ends] - reach[begins] >= threshold):
            terms = np.unique(ids[begins[at] : ends[at]])
            for piece, score in self.search(terms[terms > 0], threshold):
                text, item = int(text_of[at]), self.owners[piece]
                item_id, question, answer, length = self.items[item]
                low = max(0, int(begins[at] - first[text]) - length)
                around = split[text][low : int(ends[at] - first[text]) + length]
                asked, answered = share_of(question, around), share_of(answer, around)
                if self.pieces[piece]:
                    asked = max(asked, share_of(self.pieces[piece], around))
                if min(asked, answered) >= overlap:
                    now = best.setdefault((text, item), [0.0, 0.0, 0.0 if answer else None, 0])
                    now[:] = max(now[0], score), max(now[1], asked), max(now[2], answered) if answer else None, now[3] + 1
        for (text, item), (score, asked, answered, n) in best.items():
            yield text, self.items[item][0], score, asked, answered, n


def shingles_of(words: list[bytes], like: set) -> set:
    """Shingles of ``words`` as long as those in ``like``."""
    size = len(next(iter(like)))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """``doc_id, text_hash, item_id, score, question_overlap, answer_overlap, passages``: one
    row for each document row and item found in it."""
    spark = docs.sparkSession
    postings, named = build_postings(items)
    schema = "doc_id long, text_hash long, item_id long, score double, question_overlap double, answer_overlap double, passages long"
    names = ["doc_id", "text_hash", "item_id", "score", "question_overlap", "answer_overlap", "passages"]
    rows = identified(docs, F.col("text")).where(F.col("text") != "")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    found = spark.createDataFrame([], schema)
    for (chunk,) in sorted(postings.select("chunk").distinct().collect()):
        own = postings.where(F.col("chunk") == chunk)
        texts = named.join(own.select("item").distinct(), "item", "left_semi").collect()
        index = Index.build(
            own.select("item", "piece", "word", "share").collect(), {r["item"]: (r["item_id"], r["text"]) for r in texts}
        )
        shared = spark.sparkContext.broadcast(vars(index))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(**shared.value)
            for whole in batches:
                for batch in chunks(whole):
                    hits = list(index.matches(batch.column("text").to_pylist(), threshold, overlap))
                    at = pa.array([h[0] for h in hits], pa.int64())
                    columns = [batch.column("doc_id").take(at), batch.column("text_hash").take(at)]
                    kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                    columns += [pa.array([h[i + 1] for h in hits], kind) for i, kind in enumerate(kinds)]
                    yield pa.record_batch(columns, names)

        found = found.unionByName(rows.mapInArrow(run, schema))
    return found


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no test item is found."""
    return without(docs, settle(find_leaks(docs, items).select("doc_id", "text_hash").distinct()))
