"""Language-model scoring with Brown classes: a class-based bigram model.

P(word | previous) = P(class | previous class) * P(word | class).

Classes come from exchange clustering: every unit moves to the class that raises the
training text's class-bigram likelihood most. At first a unit is one of the ``UNITS`` most
frequent words, or one of ``SLOTS`` slots into which all other words are hashed. A round gathers,
over all training text, how often each unit follows and precedes each class; tasks then
move their units one after the other against the class-bigram counts, which they keep up
to date for their own moves. Half of the units may move in a round, the counts are gathered
anew for the next, and the assignment with the best likelihood is kept.

Then every other word leaves its slot for the class that suits it best, by the same gain
from its own counts: first those among the ``KNOWN`` most frequent, then, against counts with
these moved, all the rest. Their counts and the classes of the rest are tables by word,
as large as the vocabulary; the latter meets the texts in a join. Words that training
text lacks have the class of their slot.

Both distributions are smoothed: transitions towards class frequencies, words by adding one
with one further, unknown word in every class. A text ends with an end token, which is
also what precedes its first word.

Word counts are exact, over all training text. The ``KNOWN`` most frequent words' counts go
to every task; the other words of a text meet their counts in a join, summed per text and
word first.

Defined results: null texts are empty, one end token; rows without id are learnt from;
repeated rows count and are answered each; with nothing to learn from base scores are 0 and
classes equally likely.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratepanel.llm.common import chunks, remainder
from ratepanel.session import settle

CLASSES = 64
UNITS = 14_336
SLOTS = 2_048
KNOWN = 262_144
ROUNDS = 6
PRIOR = 50.0
LONGEST = 64
BLOCK = 64
MERGE = 16
TOGETHER = 256
FEW = 1000
FEW_BYTES = 2_000_000
HELD_WORDS = 500_000
OFTEN = 1000
END = b""


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts in a row, in lower case, and how many each text has. Arrow splits at
    the six ASCII white-space bytes and lowers A-Z alone."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = split.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    upto = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))]
    return words.filter(real).dictionary_encode(), np.diff(upto[split.offsets.to_numpy()])


def packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values that hold so many of ``values`` each."""
    edges = np.r_[0, np.cumsum(sizes)] * values.itemsize
    if edges[-1] >= 2**31:
        raise OverflowError("a chunk's values exceed 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values in a column of binary values, in a row, and how many each holds."""
    column = column.cast(pa.large_binary())
    edges = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    size = np.dtype(kind).itemsize
    n = int(edges[-1] - edges[0]) // size
    return np.frombuffer(column.buffers()[2], kind, n, int(edges[0])) if n else np.zeros(0, kind), np.diff(edges) // size


def listed(column: pa.Array) -> list:
    """As ``to_pylist``, without an Arrow scalar for each value."""
    return column.to_numpy(zero_copy_only=False).tolist()


def narrow(values: np.ndarray) -> bytes:
    """In the smallest unsigned type that holds them all; ``len`` tells which."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def widened(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"u{len(data) // n}").astype(np.int64)


def count_words(texts: DataFrame) -> DataFrame:
    """``word, n`` over all texts; the end token is the empty word."""

    def together(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sums = pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).combine_chunks()
        return pa.record_batch([sums["word"].combine_chunks(), sums["n_sum"].combine_chunks()], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for batch in chunks(whole):
                words, _ = split_words(batch.column("text"))
                n = np.r_[np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)), batch.num_rows]
                names = pa.concat_arrays([words.dictionary.cast(pa.binary()), pa.array([END], pa.binary())])
                held.append(pa.record_batch([names, pa.array(n, pa.int64())], ["word", "n"]))
                size += len(names)
                if size > 2 * HELD_WORDS:
                    held = [together(held)]
                    size = held[0].num_rows
                    if size > HELD_WORDS:
                        yield held[0]
                        held, size = [], 0
        if held:
            yield together(held)

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Dictionary:
    """The end token and the most frequent words in order, their units and counts."""

    words: dict[bytes, int]
    units: np.ndarray
    counts: np.ndarray
    n_units: int
    n_slots: int

    @classmethod
    def of(cls, counted: DataFrame, known: int, n_units: int, n_slots: int) -> Dictionary:
        short = counted.where(F.length("word") <= LONGEST)
        # Words too rare to be among the most frequent need no sorting.
        often, least = 0, 0
        for n, words in short.groupBy(F.least("n", F.lit(OFTEN)).alias("n")).count().orderBy(F.col("n").desc()).collect():
            often += words
            if often > known:
                least = n
                break
        short = short.where((F.col("n") >= least) | (F.length("word") == 0))
        top = short.orderBy((F.length("word") == 0).desc(), F.col("n").desc(), "word").limit(known).toArrow()
        words = top.column("word").to_pylist()
        units = np.array([i if i < n_units else n_units + zlib.crc32(w) % n_slots for i, w in enumerate(words)], dtype=np.uint16)
        return cls({w: i for i, w in enumerate(words)}, units, top.column("n").to_numpy().astype(np.float64), n_units, n_slots)

    def unit(self, word: bytes) -> int:
        at = self.words.get(word)
        return int(self.units[at]) if at is not None else self.n_units + zlib.crc32(word) % self.n_slots


def read_texts(docs: DataFrame, dictionary: Dictionary) -> DataFrame:
    """For each row its units with the end, the sum of log10(count + 1) over words of the
    dictionary, how many they are, the other words with their numbers, and for each token in
    a slot its word: its place in the dictionary, or -1, -2, ... in the row's other words."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(dictionary))
    kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))
    given = ["row", "doc_id", "held_out"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Dictionary(**shared.value)
        get, logs = known.words.get, np.log10(known.counts + 1)
        end, end_at = known.unit(END), known.words.get(END)
        end_log = 0.0 if end_at is None else float(logs[end_at])
        for whole in batches:
            for batch in chunks(whole):
                words, sizes = split_words(batch.column("text"))
                distinct = words.dictionary.cast(pa.binary())
                names, code = listed(distinct), words.indices.to_numpy()
                own = np.fromiter(map(get, names, repeat(-1)), np.int32, len(names))
                unit = np.empty(len(names), np.uint16)
                unit[own >= 0] = known.units[own[own >= 0]]
                unit[own < 0] = [known.n_units + zlib.crc32(names[i]) % known.n_slots for i in np.flatnonzero(own < 0).tolist()]
                row, at = np.repeat(np.arange(len(sizes)), sizes), own[code]
                inside = at >= 0
                values, n_inside = logs[at[inside]], np.bincount(row[inside], minlength=len(sizes))
                edges = np.cumsum(n_inside).tolist()
                sums = [float(values[a:b].sum()) + end_log for a, b in zip([0, *edges], edges)]
                # Other words, numbered in each row as they first occur.
                rest = np.flatnonzero(~inside)
                _, first, same, times = np.unique(row[rest] * len(names) + code[rest], return_index=True, return_inverse=True, return_counts=True)
                order = np.argsort(first)
                number = np.empty(len(order), np.int64)
                number[order] = np.arange(len(order))
                first = rest[first[order]]
                begins = np.r_[0, np.cumsum(np.bincount(row[first], minlength=len(sizes)))]
                at[rest] = begins[row[rest]] - 1 - number[same]
                pairs = pa.StructArray.from_arrays([distinct.take(pa.array(code[first])), pa.array(times[order], pa.int32())], fields=list(kind.value_type))
                others = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pairs)
                out = np.full(len(code) + len(sizes), end, np.uint16)
                out[np.arange(len(code)) + row] = unit[code]
                slotted = unit[code] >= known.n_units
                columns = [batch.column(c) for c in given] + [packed(out, sizes + 1), pa.array(sums, pa.float64())]
                columns += [pa.array(n_inside + (end_at is not None), pa.int64()), others]
                columns.append(packed(at[slotted], np.bincount(row[slotted], minlength=len(sizes))))
                yield pa.record_batch(columns, [*given, "units", "log_counts", "n_known", "others", "rest"])

    schema = (
        "row long, doc_id long, held_out boolean, units binary, log_counts double, n_known long, "
        "others array<struct<word: binary, n: int>>, rest binary"
    )
    return docs.select("row", "doc_id", "held_out", "text").mapInArrow(run, schema)


# --- exchange clustering ----------------------------------------------------


def gather(texts: DataFrame, classes: np.ndarray, n_classes: int, end: int) -> DataFrame:
    """``block, counts``: for each unit of the block, how often it precedes and follows each
    class, and how often itself."""
    shared = texts.sparkSession.sparkContext.broadcast(classes.astype(np.int64))
    width = 2 * n_classes + 1
    total = len(classes) * width

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        sums = np.zeros(total, dtype=np.int64)
        for batch in batches:
            units = np.frombuffer(b"".join(batch.column("units").to_pylist()), dtype=np.uint16)
            for start in range(0, len(units), 1_000_000):
                now = units[start : start + 1_000_000].astype(np.int64)
                before = np.r_[units[start - 1] if start else end, now[:-1]].astype(np.int64)
                again = now[now == before]
                places = np.concatenate([before * width + of[now], now * width + n_classes + of[before], again * width + 2 * n_classes])
                sums += np.bincount(places, minlength=total)
        edges = range(0, total, BLOCK * width)
        part = TaskContext.get().partitionId()
        for block, start in enumerate(edges):
            own = sums[start : start + BLOCK * width]
            if own.any():
                yield sparse(block, part, own)

    def sparse(block: int, part: int, own: np.ndarray) -> pa.RecordBatch:
        places = np.flatnonzero(own)
        row = {"block": block, "part": part, "n": len(places), "steps": narrow(np.diff(places, prepend=0)), "counts": narrow(own[places])}
        return pa.RecordBatch.from_pylist([row])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        """Sums of the rows of one block and part, which follow each other."""
        key, own = None, np.zeros(0, dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                if key != (row["block"], row["part"]):
                    if key:
                        yield *key, own
                    key, own = (row["block"], row["part"]), np.zeros(BLOCK * width, dtype=np.int64)
                own[np.cumsum(widened(row["steps"], row["n"]))] += widened(row["counts"], row["n"])
        if key:
            yield *key, own

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part, own in added(batches):
            yield sparse(block, part, own)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, own in added(batches):
            yield pa.RecordBatch.from_pylist([{"block": block, "counts": own.tobytes()}])

    schema = "block long, part long, n long, steps binary, counts binary"
    rows = texts.where(~F.col("held_out")).select("units")
    parts = rows.mapInArrow(count, schema)
    # A tree, so that no task reads what more than MERGE tasks have counted of a block.
    left = rows.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // MERGE)
        parts = parts.withColumn("part", F.floor(F.col("part") / MERGE))
        parts = parts.repartition("block", "part").sortWithinPartitions("block", "part")
        # The last step finishes at once: two steps in a row would hold two Python workers a task.
        if left > 1:
            parts = parts.mapInArrow(merge, schema)
    return settle(parts.mapInArrow(finish, "block long, counts binary"))


def class_bigrams(counted: DataFrame, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """How often each class follows each, a matrix of fixed size."""
    width = 2 * n_classes + 1
    spark = counted.sparkSession
    shared = spark.sparkContext.broadcast(classes.astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((n_classes, n_classes))
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["counts"], dtype=np.int64).reshape(BLOCK, width)
                units = shared.value[row["block"] * BLOCK : (row["block"] + 1) * BLOCK]
                np.add.at(found, units, own[: len(units), :n_classes])
        yield pa.record_batch([pa.array([found.tobytes()], pa.binary())], ["found"])

    rows = counted.mapInArrow(run, "found binary").collect()
    return sum((np.frombuffer(r["found"]).reshape(n_classes, n_classes) for r in rows), np.zeros((n_classes, n_classes)))


def x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(bigrams: np.ndarray) -> float:
    return float(x_log_x(bigrams).sum() - x_log_x(bigrams.sum(axis=0)).sum() - x_log_x(bigrams.sum(axis=1)).sum())


def exchange(unit_counts: np.ndarray, own: int, bigrams: np.ndarray) -> int:
    """The class that suits a unit of class ``own`` best; ``bigrams`` takes the move."""
    n = len(bigrams)
    after, before, itself = unit_counts[:n].astype(float), unit_counts[n : 2 * n].astype(float), float(unit_counts[2 * n])
    out, into = after.sum(), before.sum()
    bigrams[own] -= after
    bigrams[:, own] -= before
    bigrams[own, own] += itself
    np.maximum(bigrams, 0.0, out=bigrams)
    after[own] = max(0.0, after[own] - itself)
    before[own] = max(0.0, before[own] - itself)
    now = x_log_x(bigrams)
    as_first = x_log_x(bigrams + after) - now
    as_second = x_log_x(bigrams + before[:, None]) - now
    inside = np.diag(bigrams)
    gain = as_first.sum(axis=1) - np.diag(as_first) + as_second.sum(axis=0) - np.diag(as_second)
    gain += x_log_x(inside + after + before + itself) - np.diag(now)
    # Class sizes without the unit; its neighbours' own tokens remain.
    rows, columns = bigrams.sum(axis=1) + before, bigrams.sum(axis=0) + after
    gain -= x_log_x(rows + out) - x_log_x(rows) + x_log_x(columns + into) - x_log_x(columns)
    best = int(gain.argmax())
    best = own if gain[own] >= gain[best] else best
    bigrams[best] += after
    bigrams[:, best] += before
    bigrams[best, best] += itself
    return best


def moves(counted: DataFrame, classes: np.ndarray, bigrams: np.ndarray, turn: int) -> np.ndarray:
    """The classes after every second unit has moved."""
    n_classes, width = len(bigrams), 2 * len(bigrams) + 1
    shared = counted.sparkSession.sparkContext.broadcast((classes, bigrams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, bigrams = shared.value
        bigrams = bigrams.copy()
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["counts"], dtype=np.int64).reshape(BLOCK, width)
                found = []
                for unit in range(row["block"] * BLOCK, min((row["block"] + 1) * BLOCK, len(classes))):
                    counts = own[unit % BLOCK]
                    if (unit // n_classes + unit) % 2 == turn % 2 and counts.any():
                        best = exchange(counts, int(classes[unit]), bigrams)
                        if best != classes[unit]:
                            found.append({"unit": unit, "class": best})
                if found:
                    yield pa.RecordBatch.from_pylist(found)

    out = classes.copy()
    for row in counted.mapInArrow(run, "unit long, class long").collect():
        out[row["unit"]] = row["class"]
    return out


def cluster(texts: DataFrame, n_units: int, n_classes: int, end: int, rounds: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """The best classes found, their bigram counts, and the likelihood of each round."""
    classes = np.arange(n_units, dtype=np.int64) % n_classes
    best, found = None, []
    for turn in range(rounds + 1):
        counted = gather(texts, classes, n_classes, end)
        bigrams = class_bigrams(counted, classes, n_classes)
        found.append(likelihood(bigrams))
        if best is None or found[-1] > best[0]:
            best = (found[-1], classes, bigrams)
        if turn < rounds:
            classes = moves(counted, classes, bigrams, turn)
    return best[1], best[2], found


# --- words in slots ---------------------------------------------------------


@dataclass(frozen=True)
class Classes:
    """The classes of units and of the dictionary's words."""

    units: np.ndarray
    words: np.ndarray
    n_units: int
    end: int

    def path(self, units: pa.Array, rest: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The class of each token of all rows, other words in that of their slot; how many tokens
        each row has; where tokens in slots stand, and their words."""
        own, sizes = unpacked(units, np.uint16)
        words, _ = unpacked(rest, np.int32)
        slotted = own >= self.n_units
        slotted[np.cumsum(sizes) - 1] = False
        at, of = np.flatnonzero(slotted), self.units[own]
        of[at[words >= 0]] = self.words[words[words >= 0]]
        return of, sizes, at, words

    def before(self, of: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The class before each token of ``path``."""
        before = np.r_[self.end, of[:-1]]
        before[(np.cumsum(sizes) - sizes)[sizes > 0]] = self.end
        return before


def gather_words(texts: DataFrame, model: Classes, n_classes: int, of_others: bool, names: list[bytes]) -> DataFrame:
    """``word, cells``: as ``gather``, for the words in slots that are in the dictionary, or that
    are not; a cell is its place plus ``width`` times its count. A word has further rows next to its first."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((vars(model), None if of_others else names))
    width = 2 * n_classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, names = Classes(**shared.value[0]), shared.value[1]
        for whole in batches:
            for batch in chunks(whole, "units"):
                found = [np.zeros(0, np.int64)]
                start = 0
                for few in chunks(batch, "units", FEW_BYTES):
                    of, sizes, at, word = model.path(few.column("units"), few.column("rest"))
                    before, row = model.before(of, sizes), np.repeat(np.arange(len(sizes)), sizes)[at]
                    mine = word < 0 if of_others else word >= 0
                    at, word = at[mine], word[mine].astype(np.int64)
                    if of_others:
                        distinct = few.column("others").value_lengths().to_numpy()
                        word = (start + np.cumsum(distinct) - distinct)[row[mine]] - 1 - word
                        start += int(distinct.sum())
                    again = (np.diff(at) == 1) & (np.diff(word) == 0)
                    found += [word * width + of[at + 1], word * width + n_classes + before[at], word[1:][again] * width + 2 * n_classes]
                keys = np.concatenate(found)
                if of_others:
                    coded = batch.column("others").flatten().field("word").dictionary_encode()
                    keys = coded.indices.to_numpy()[keys // width].astype(np.int64) * width + keys % width
                keys, n = np.unique(keys, return_counts=True)
                own, first = np.unique(keys // width, return_index=True)
                edges = pa.array(np.r_[first, len(keys)].astype(np.int32))
                cells = pa.ListArray.from_arrays(edges, pa.array(keys % width + n * width))
                text = coded.dictionary.take(pa.array(own)) if of_others else pa.array([names[i] for i in own.tolist()], pa.binary())
                yield pa.record_batch([text, cells], ["word", "cells"])

    rows = texts.where(~F.col("held_out")).select("units", "rest", *(["others"] if of_others else []))
    found = rows.mapInArrow(run, "word binary, cells array<bigint>")
    return found.repartition("word").sortWithinPartitions("word")


def added_words(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Up to ``TOGETHER`` words and their counts from rows of ``gather_words``."""
    held: tuple[list[bytes], np.ndarray] = ([], np.zeros((0, width)))
    for batch in batches:
        column, sizes = batch.column("word"), batch.column("cells").value_lengths().to_numpy()
        n, places = np.divmod(batch.column("cells").flatten().to_numpy(), width)
        new = pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        run = np.r_[0, np.cumsum(new)][: len(column)]
        firsts = np.flatnonzero(np.diff(run, prepend=-1))
        words = listed(column.take(pa.array(firsts)))
        of = np.repeat(run, sizes)
        for start in range(0, len(firsts), TOGETHER):
            names = words[start : start + TOGETHER]
            a, b = np.searchsorted(of, [start, start + len(names)])
            cells = (of[a:b] - start) * width + places[a:b]
            counts = np.bincount(cells, weights=n[a:b], minlength=len(names) * width).reshape(len(names), width)
            if held[0] and held[0][0] == names[0]:
                counts[0] += held[1][0]
            elif held[0]:
                yield held
            held = names[-1:], counts[-1:].copy()
            yield names[:-1], counts[:-1]
    yield held


def exchange_many(counts: np.ndarray, own: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
    """The class that suits each unit best if it alone moved; the gains are those of ``exchange``."""
    n = len(bigrams)
    units = np.arange(len(counts))
    after, before, itself = counts[:, :n].astype(float), counts[:, n : 2 * n].astype(float), counts[:, 2 * n].astype(float)
    out, into = after.sum(axis=1), before.sum(axis=1)
    left_after, left_before = after.copy(), before.copy()
    left_after[units, own] = np.maximum(0.0, after[units, own] - itself)
    left_before[units, own] = np.maximum(0.0, before[units, own] - itself)
    gain = np.zeros((len(counts), n))
    usual = x_log_x(bigrams)
    for left, whole, other, matrix, logs in (
        (left_after, after, before, bigrams.T, usual.T),
        (left_before, before, after, bigrams, usual),
    ):
        unit, to = np.nonzero(left)
        if not len(unit):
            continue
        each, mine, n_left = np.arange(len(unit)), own[unit], left[unit, to]
        # Most pairs are worth what they are to any unit with as many; those of its own class lack the unit's.
        _, first, like = np.unique(n_left * n + to, return_index=True, return_inverse=True)
        more = (x_log_x(matrix[to[first]] + n_left[first, None]) - logs[to[first]])[like]
        now = np.maximum(matrix[to, mine] - whole[unit, to], 0.0)
        more[each, mine] = x_log_x(now + n_left) - x_log_x(now)
        same = np.flatnonzero(to == mine)
        now = matrix[to[same]]  # by class: the counts of its pairs with ``to``, without the unit's own
        now[np.arange(len(same)), mine[same]] -= whole[unit[same], to[same]]
        now -= other[unit[same]]
        now[np.arange(len(same)), mine[same]] += itself[unit[same]]
        np.maximum(now, 0.0, out=now)
        more[same] = x_log_x(now + n_left[same, None]) - x_log_x(now)
        more[each, to] = 0.0
        edges = np.searchsorted(unit, units)
        has = np.diff(np.r_[edges, len(unit)]) > 0
        gain[has] += np.add.reduceat(more, edges[has], axis=0)
    unit, to = np.nonzero(left_after + left_before + itself[:, None])
    inside = np.diag(bigrams)[to]
    mine = to == own[unit]
    inside[mine] -= (after + before)[unit[mine], to[mine]] - itself[unit[mine]]
    np.maximum(inside, 0.0, out=inside)
    gain[unit, to] += x_log_x(inside + left_after[unit, to] + left_before[unit, to] + itself[unit]) - x_log_x(inside)
    rows, columns = bigrams.sum(axis=1), bigrams.sum(axis=0)
    grown = lambda r, o, c, i: x_log_x(r + o) - x_log_x(r) + x_log_x(c + i) - x_log_x(c)
    _, first, like = np.unique(np.stack([out, into]), axis=1, return_index=True, return_inverse=True)
    sizes = grown(rows, out[first, None], columns, into[first, None])[like.ravel()]
    sizes[units, own] = grown(rows[own] - out, out, columns[own] - into, into)
    gain -= sizes
    best = gain.argmax(axis=1)
    return np.where(gain[units, own] >= gain[units, best], own, best)


def move_words(counted: DataFrame, dictionary: Dictionary, model: Classes, bigrams: np.ndarray) -> DataFrame:
    """``word, n, class`` from ``gather_words``. Words are moved together, against the same counts,
    as long as they are few and hold under a ``FEW``-th of the tokens."""
    n_classes = len(bigrams)
    limit = bigrams.sum() / FEW
    width = 2 * n_classes + 1
    shared = counted.sparkSession.sparkContext.broadcast((vars(dictionary), vars(model), bigrams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model, now = Dictionary(**shared.value[0]), Classes(**shared.value[1]), shared.value[2].copy()
        for words, found in added_words(batches, width):
            # Every token precedes one.
            times = found[:, :n_classes].sum(axis=1)
            ends, stop = np.cumsum(times), 0
            at = np.fromiter(map(known.words.get, words, repeat(-1)), np.int64, len(words))
            own = np.empty(len(words), np.int64)
            own[at >= 0] = model.words[at[at >= 0]]
            own[at < 0] = model.units[[known.unit(words[i]) for i in np.flatnonzero(at < 0).tolist()]]
            best = own.copy()
            while stop < len(words):
                start, full = stop, (ends[stop - 1] if stop else 0.0) + limit
                stop = max(start + 1, int(np.searchsorted(ends, full)))
                counts = found[start:stop]
                best[start:stop] = exchange_many(counts, own[start:stop], now)
                unit, place = np.nonzero(counts[:, : 2 * n_classes])
                n = counts[unit, place]
                for to, sign in ((own[start:stop], -1), (best[start:stop], 1)):
                    cells = np.where(place < n_classes, to[unit] * n_classes + place, (place - n_classes) * n_classes + to[unit])
                    now += sign * np.bincount(cells, n, n_classes * n_classes).reshape(n_classes, n_classes)
                np.maximum(now, 0.0, out=now)
            yield pa.record_batch([pa.array(words, pa.binary()), pa.array(times.astype(np.int64)), pa.array(best.astype(np.int32))], ["word", "n", "class"])

    return counted.mapInArrow(run, "word binary, n long, class int")


def with_paths(texts: DataFrame, model: Classes, spots: bool, kind: str = "u2") -> DataFrame:
    """``texts`` with ``path``, the classes of each row's tokens as integers of type ``kind``; with
    ``spots`` also the places of the row's other words, then their numbers."""
    shared = texts.sparkSession.sparkContext.broadcast(vars(model))

    @F.arrow_udf("struct<path: binary, spots: binary>")
    def run(units: pa.Array, rest: pa.Array) -> pa.Array:
        model, done = Classes(**shared.value), [pa.array([], pa.struct([("path", pa.binary()), ("spots", pa.binary())]))]
        for few in chunks(pa.record_batch([units, rest], ["units", "rest"]), "units", FEW_BYTES):
            of, sizes, at, words = model.path(few.column("units"), few.column("rest"))
            found = [None] * len(sizes)
            if spots:
                at, number = at[words < 0], -1 - words[words < 0]
                starts = np.cumsum(sizes) - sizes
                edges = np.searchsorted(at, np.r_[starts, len(of)]).tolist()
                for i, (a, b, start, size) in enumerate(zip(edges, edges[1:], starts.tolist(), sizes.tolist())):
                    found[i] = np.r_[at[a:b] - start, number[a:b]].astype(np.min_scalar_type(size)).tobytes()
            done.append(pa.StructArray.from_arrays([packed(of.astype(kind), sizes), pa.array(found, pa.binary())], ["path", "spots"]))
        return pa.concat_arrays(done)

    traced = texts.withColumn("path", run("units", "rest"))
    if spots:
        traced = traced.withColumn("spots", F.col("path.spots"))
    return traced.withColumn("path", F.col("path.path"))


def with_others(rows: DataFrame, kind: str) -> DataFrame:
    """``with_paths`` after the other words have the classes in ``classes``, a list of ``at`` and
    ``class``; the path is of 16-bit integers."""

    @F.arrow_udf("binary")
    def run(paths: pa.Array, spots: pa.Array, classes: pa.Array) -> pa.Array:
        found = []
        for path, spot, own in zip(paths, spots, classes):
            of = np.frombuffer(path.as_py(), kind).astype(np.uint16)
            if own.is_valid:
                at, number = np.frombuffer(spot.as_py(), np.min_scalar_type(len(of))).reshape(2, -1).astype(np.int64)
                others = np.full(number.max(initial=-1) + 1, -1, dtype=np.int64)
                others[own.values.field("at").to_numpy()] = own.values.field("class").to_numpy()
                learnt = others[number] >= 0
                of[at[learnt]] = others[number[learnt]]
            found.append(of.tobytes())
        return pa.array(found, pa.binary())

    return rows.withColumn("path", run("path", "spots", "classes")).drop("spots", "classes")


def path_bigrams(rows: DataFrame, n_classes: int, end: int, model: Classes | None = None) -> np.ndarray:
    """How often each class follows each in the training rows' paths; with ``model``, of texts that have none yet."""
    shared = rows.sparkSession.sparkContext.broadcast(None if model is None else vars(model))
    columns = ["path"] if model is None else ["units", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classes(np.zeros(0), np.zeros(0), 0, end) if shared.value is None else Classes(**shared.value)
        found = np.zeros(n_classes * n_classes)
        for whole in batches:
            for batch in chunks(whole, columns[0], FEW_BYTES):
                of, sizes = unpacked(batch.column("path"), np.uint16) if shared.value is None else model.path(batch.column("units"), batch.column("rest"))[:2]
                of = of.astype(np.int64)
                found += np.bincount(model.before(of, sizes) * n_classes + of, minlength=len(found))
        yield pa.record_batch([pa.array([found.tobytes()], pa.binary())], ["found"])

    rows = rows.where(~F.col("held_out")).select(*columns).mapInArrow(run, "found binary").collect()
    return sum((np.frombuffer(r["found"]) for r in rows), np.zeros(n_classes * n_classes)).reshape(n_classes, n_classes)


def settle_words(
    texts: DataFrame, counted: DataFrame, dictionary: Dictionary, classes: np.ndarray, bigrams: np.ndarray
) -> tuple[DataFrame, DataFrame, Classes, np.ndarray, list[float]]:
    """The texts' paths, and counts and classes of the learnt words outside the dictionary, after
    every word in a slot has moved, the class bigrams, and the likelihood before, between and after. Moves of all
    words that lower it are not taken."""
    n_classes, n_units = len(bigrams), dictionary.n_units
    end, names = int(classes[dictionary.unit(END)]), list(dictionary.words)
    model = Classes(classes, classes[dictionary.units], n_units, end)
    found = [likelihood(bigrams)]

    words = model.words.copy()
    for word, _, to in move_words(gather_words(texts, model, n_classes, False, names), dictionary, model, bigrams).collect():
        words[dictionary.words[bytes(word)]] = to
    moved = Classes(classes, words, n_units, end)
    after = path_bigrams(texts, n_classes, end, moved)
    found.append(likelihood(after))
    if found[-1] >= found[-2]:
        model, bigrams = moved, after

    learnt = settle(move_words(gather_words(texts, model, n_classes, True, names), dictionary, model, bigrams))
    others = texts.select("row", F.posexplode("others").alias("at", "other")).select("row", "at", "other.word", "other.n")
    # As large as the vocabulary, so never sent to every task.
    met = others.join(learnt.withColumnRenamed("n", "count").hint("merge"), "word")
    sums = met.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.col("count") + 1)).alias("more_logs"),
        F.sum("n").alias("more_known"),
        F.collect_list(F.struct("at", "class")).alias("classes"),
    )
    # Texts meet the sums as paths of the fewest bytes.
    kind = "u1" if n_classes <= 256 else "u2"
    traced = with_paths(texts.drop("others"), model, True, kind).drop("units", "rest")
    paths = settle(with_others(traced.join(sums, "row", "left"), kind), compression="zstd")
    after = path_bigrams(paths, n_classes, end)
    found.append(likelihood(after))
    if found[-1] >= likelihood(bigrams):
        bigrams = after
    else:
        plain = with_paths(texts.drop("others"), model, False).drop("units", "rest")
        paths = settle(plain.join(sums.drop("classes"), "row", "left"), compression="zstd")
        learnt = learnt.withColumn("class", F.lit(None).cast("int"))
    return paths, learnt, model, bigrams, found


# --- model ------------------------------------------------------------------


def class_sizes(learnt: DataFrame, dictionary: Dictionary, model: Classes, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of every class, of the dictionary and the words ``learnt`` beside
    it, which without a class have that of their slot."""
    shared = learnt.sparkSession.sparkContext.broadcast((vars(dictionary), vars(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = Dictionary(**shared.value[0]), Classes(**shared.value[1])
        for batch in batches:
            of, n = batch.column("class"), batch.column("n").to_numpy()
            if of.null_count:
                of = pa.array([model.units[known.unit(w)] for w in listed(batch.column("word"))], pa.int32())
            of = of.to_numpy()
            tokens = np.bincount(of, weights=n, minlength=n_classes).astype(np.int64)
            words = np.bincount(of, minlength=n_classes)
            yield pa.record_batch([pa.array(np.arange(n_classes)), pa.array(tokens), pa.array(words)], ["class", "tokens", "words"])

    sums = learnt.mapInArrow(run, "class long, tokens long, words long").groupBy("class").agg(F.sum("tokens"), F.sum("words"))
    tokens, words = np.bincount(model.words, dictionary.counts, n_classes), np.bincount(model.words, None, n_classes).astype(float)
    for of, n, distinct in sums.collect():
        tokens[of] += n
        words[of] += distinct
    return tokens, words


def transitions(bigrams: np.ndarray, tokens: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log10 P(class | previous class)."""
    usual = (tokens + 1.0) / (tokens.sum() + len(tokens))
    return np.log10((bigrams + prior * usual) / (bigrams.sum(axis=1, keepdims=True) + prior))


def score_texts(
    docs: DataFrame,
    folds: int = 7,
    held: int = 2,
    n_classes: int = CLASSES,
    n_units: int = UNITS,
    n_slots: int = SLOTS,
    known: int = KNOWN,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row."""
    held_out = (remainder(F.col("doc_id"), folds) == held).alias("held_out")
    counted = settle(count_words(docs.where(~held_out)))
    totals = counted.agg(F.sum("n"), F.count(F.lit(1))).first()
    n_tokens, n_words = totals[0] or 0, totals[1]
    dictionary = Dictionary.of(counted, known, n_units, n_slots)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out, "text")
    texts = settle(read_texts(rows, dictionary), compression="zstd")
    end = dictionary.unit(END)
    classes, bigrams, _ = cluster(texts, n_units + n_slots, n_classes, end, rounds)
    paths, learnt, model, bigrams, _ = settle_words(texts, counted, dictionary, classes, bigrams)
    tokens, words = class_sizes(learnt, dictionary, model, n_classes)
    steps, spread = transitions(bigrams, tokens), np.log10(tokens + words + 1)
    shared = docs.sparkSession.sparkContext.broadcast((model.end, steps, spread))

    @F.arrow_udf("struct<n: bigint, score: double>")
    def scored(paths: pa.Array) -> pa.Array:
        end, steps, spread = shared.value
        sizes, scores = [], []
        for value in paths:
            of = np.frombuffer(value.as_py(), dtype=np.uint16)
            before = np.r_[end, of[:-1]].astype(np.int64)
            sizes.append(len(of))
            scores.append(float(steps[before, of].sum() - spread[of].sum()))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(scores, pa.float64())], ["n", "score"])

    local = paths.withColumn("path", scored("path"))
    logs = F.col("log_counts") + F.coalesce("more_logs", F.lit(0.0))
    base = float(np.log10(n_tokens + n_words + 1))
    return local.select(
        "doc_id",
        "held_out",
        F.col("path.n").alias("n_tokens"),
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (logs - F.col("path.n") * F.lit(base)).alias("base_score"),
        (logs + F.col("path.score")).alias("score"),
    )
