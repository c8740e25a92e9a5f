"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct word shingles. Two sets of a and b shingles whose Jaccard
similarity is at least ``PERCENT`` differ in few of them: (a + b) / 9 at 80 %. Sets of a size band
are therefore compared by Hamming distance. The feature domain (shingle hashes) is partitioned into
groups, so many that one group differs in at most one shingle, and each group into three parts;
the subsets of two parts are enumerated, and one of them is equal. Its shingles are a
*signature*, which sufficiently similar sets share. A band holds sizes up to twice the one
before; a set whose partners can reach into the next band has signatures there too.

Signatures without shingles would join everything, so they are left out: a set adds one group for
each group of its own with such a signature, after which the pigeonholes still suffice. Only a
set too sparse for that keeps them, and meets other sparse ones.

Equal sets are one class from the start. Classes that share a signature are joined to
the smallest of them (a star), and checked: a bound from counts in cells of the
domain, then the sets themselves. Stars leave open whether classes that missed their centre are
linked. Signatures whose classes ended in one component are done. Else, up to ``FEW`` classes
are compared in one task, counts first, across components, each with the hub of its neighbours and
then, if that leaves components apart, with all; more are divided by signatures of another
seed, which linked sets share as well, and so on; after ``LEVELS`` divisions what is left is
compared by blocks of ``FEW``. No link between components is lost, and
copies of any number cost one class.

Texts are read where they lie: once for the classes, once for the signatures, and once in every round of checks, for
the sets of classes that passed the bound, found by a Bloom filter. Shingles and sets are
compared by 64-bit hash.

Defined results: null and empty texts, and texts of white space, have no set and are linked
with nothing; with fewer words than a shingle the whole sequence is one. A component is
named by its smallest doc_id; it has none if no document of it has. Rows without id are answered, repeated
rows each. Texts of any length are taken whole. No rows give no rows. Further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratepanel.llm.common import byte_texts, chunks, text_key
from ratepanel.llm.simhash import components
from ratepanel.llm.substrings import bloom, held_by, mixed, signed, word_hashes
from ratepanel.session import settle

SHINGLE = 5
PERCENT = 80
PARTS = 3
FEW = 4096
LEVELS = 4
CHUNK = 1_000_000
HELD = 65_536
FINE = 10
ODD = np.uint64(0x9E3779B97F4A7C15)


# --- sets -------------------------------------------------------------------


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, edges = word_hashes([t.lower() for t in texts])
    weights = mixed(np.arange(1, width + 1, dtype=np.uint64) * ODD) | np.uint64(1)
    whole = max(0, len(words) - width + 1)
    rows = np.zeros(whole, dtype=np.uint64)
    for i in range(width):
        rows += words[i : i + whole] * weights[i]
    rows = mixed(rows)
    out = []
    for start, end in zip(edges, edges[1:]):
        if end - start >= width:
            out.append(np.unique(rows[start : end - width + 1]))
        elif end > start:
            short = (words[start:end] * weights[: end - start]).sum(dtype=np.uint64)
            out.append(mixed(np.array([short + np.uint64(end - start)])))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def class_of(shingles: np.ndarray) -> int:
    """The hash of a set, as a signed 64-bit number."""
    total = mixed(shingles + ODD).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mixed(np.array([total])).view(np.int64)[0])


def cells_of(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each cell of the domain: a power of two of cells, with one or two shingles
    each on average, or up to four times as many cells while these are ``2 ** FINE`` at most."""
    bits = max(2, (len(shingles) - 1).bit_length() - 1)
    bits = max(bits, min(bits + 2, FINE))
    counts = np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def halved(cells: np.ndarray) -> np.ndarray:
    """Counts of cells twice as large."""
    return cells[..., ::2] + cells[..., 1::2]


def with_sets(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``doc_id, text_hash, n, cls, cells`` of each row; ``cls`` and ``cells`` are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, limit=CHUNK):
                sets = shingle_sets(list(byte_texts(batch.column("text"))), width)
                columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64())]
                columns.append(pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()))
                columns.append(pa.array([cells_of(s) if len(s) else None for s in sets], pa.binary()))
                yield pa.record_batch(columns, ["doc_id", "text_hash", "n", "cls", "cells"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, n long, cls long, cells binary")


# --- signatures -------------------------------------------------------------


def differ(a: int, b: int) -> int:
    """In how many shingles linked sets of these sizes can differ."""
    return (a + b) * (100 - PERCENT) // (100 + PERCENT)


def band(size: int) -> int:
    return max(0, (size - 1).bit_length() - 2)


def largest(level: int) -> int:
    return 4 << level


def groups_in(level: int) -> int:
    needed = differ(largest(level), largest(level)) // 2 + 1
    return needed + needed // 8


BOUNDS: dict[int, np.ndarray] = {}


def bounds(level: int) -> np.ndarray:
    if level not in BOUNDS:
        parts = PARTS * groups_in(level)
        BOUNDS[level] = np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64)
    return BOUNDS[level]


def reach(size: int) -> list[tuple[int, int]]:
    """The bands a set has signatures in, and in how many shingles it differs there."""
    own, partner = band(size), size * 100 // PERCENT
    out = [(own, differ(size, min(partner, largest(own))))]
    if partner > largest(own):
        out.append((own + 1, differ(size, partner)))
    return [(level, most) for level, most in out if most]


def signatures(shingles: np.ndarray, seed: int = 0) -> np.ndarray:
    """PartEnum signatures of a sorted set; sets that differ in nothing need none."""
    todo = reach(len(shingles))
    if not todo:
        return np.zeros(0, dtype=np.uint64)
    if seed:
        shingles = np.sort(mixed(shingles ^ mixed(np.array([seed], dtype=np.uint64))))
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mixed(shingles + ODD))]
    out = []
    for level, most in todo:
        groups = groups_in(level)
        edges = np.r_[0, np.searchsorted(shingles, bounds(level)), len(shingles)]
        totals = (sums[edges[1:]] - sums[edges[:-1]]).reshape(groups, PARTS)
        counts = np.diff(edges).reshape(groups, PARTS)
        without = counts.sum(axis=1, keepdims=True) - counts
        weak = (without == 0).any(axis=1)
        enough = np.flatnonzero(np.arange(1, groups + 1) >= most // 2 + 1 + np.cumsum(weak))
        use = int(enough[0]) + 1 if len(enough) else groups
        named = np.arange(use * PARTS, dtype=np.uint64).reshape(use, PARTS) + np.uint64((level + 1) << 40)
        found = mixed(totals.sum(axis=1, keepdims=True, dtype=np.uint64)[:use] - totals[:use] + mixed(named))
        out.append(found[without[:use] > 0] if len(enough) else found.ravel())
    return np.concatenate(out)


def signed_classes(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``key, cls``: a row for every signature; a task names each class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in chunks(whole, limit=CHUNK):
                keys, classes, sizes = [], [], []
                for s in shingle_sets(list(byte_texts(batch.column("text"))), width):
                    if len(s) and (cls := class_of(s)) not in seen:
                        seen.add(cls)
                        keys.append(signatures(s))
                        classes.append(cls)
                        sizes.append(len(keys[-1]))
                if keys:
                    owners = np.repeat(np.array(classes, dtype=np.int64), sizes)
                    yield pa.record_batch([signed(np.concatenate(keys)), pa.array(owners)], ["key", "cls"])

    return docs.select("text").mapInArrow(run, "key long, cls long")


def met(signs: DataFrame) -> DataFrame:
    """``key, centre, cls`` for classes that share a signature; the centre is the smallest.

    Equal lists of classes are told once a task: two classes under key null, for they
    need no more than their star, longer lists under a hash of themselves. A list too
    long to hold keeps its signature and passes through.
    """
    names = ["key", "centre", "cls"]

    def listed(keys: np.ndarray, classes: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[first, len(keys)])
        several = sizes > 1
        take = np.repeat(several, sizes)
        classes, first, sizes = classes[take], first[several], sizes[several]
        if not len(sizes):
            return pa.record_batch([pa.array([], pa.int64())] * 3, names)
        starts = np.cumsum(sizes) - sizes
        name = mixed(np.add.reduceat(mixed(classes.view(np.uint64) + ODD), starts) + sizes.astype(np.uint64)).view(np.int64)
        _, once = np.unique(name, return_index=True)
        use = np.zeros(len(sizes), dtype=bool)
        use[once] = True
        rows = np.repeat(use, sizes)
        key = pa.array(np.repeat(name, sizes)[rows], mask=np.repeat(sizes == 2, sizes)[rows])
        return pa.record_batch([key, pa.array(np.repeat(classes[starts], sizes)[rows]), pa.array(classes[rows])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        long: tuple[int, int] | None = None  # key and centre of a list under way
        for batch in batches:
            keys = np.r_[held[0], batch.column(0).to_numpy()]
            classes = np.r_[held[1], batch.column(1).to_numpy()]
            new = np.r_[True, (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1])] if len(keys) else np.zeros(0, bool)
            keys, classes = keys[new], classes[new]
            if not len(keys):
                continue
            if long:
                mine = int(np.searchsorted(keys, long[0], side="right"))
                rest = classes[:mine]
                if mine:
                    yield pa.record_batch([pa.array(np.full(mine, long[0])), pa.array(np.full(mine, long[1])), pa.array(rest)], names)
                keys, classes = keys[mine:], classes[mine:]
                long = None if len(keys) else long
                if long:
                    held = (keys, classes)
                    continue
            last = int(np.searchsorted(keys, keys[-1]))
            if last and len(keys) >= HELD:
                yield listed(keys[:last], classes[:last])
                keys, classes = keys[last:], classes[last:]
            if len(keys) >= HELD and keys[0] == keys[-1]:
                long = (int(keys[0]), int(classes[0]))
                yield pa.record_batch([pa.array(keys), pa.array(np.full(len(keys), classes[0])), pa.array(classes)], names)
                keys, classes = keys[:0], classes[:0]
            held = (keys, classes)
        if len(held[0]):
            yield listed(*held)

    return signs.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(run, "key long, centre long, cls long")


# --- checks -----------------------------------------------------------------


def gap(a: np.ndarray, b: np.ndarray) -> int:
    """In how many shingles two sets differ at least, from their cells."""
    while len(a) > len(b):
        a = halved(a)
    while len(b) > len(a):
        b = halved(b)
    return int(np.abs(a - b).sum())


def counts_in(cells: bytes, kind: type = np.int32) -> np.ndarray:
    return np.frombuffer(cells, dtype=np.uint8).astype(kind)


@F.arrow_udf(T.BooleanType())
def may_link(a: pa.Array, b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
    rows = zip(a.to_pylist(), b.to_pylist(), n_a.to_pylist(), n_b.to_pylist())
    return pa.array([gap(counts_in(x), counts_in(y)) <= differ(n, m) for x, y, n, m in rows], pa.bool_())


def bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sizes and counts by cell leave a link possible."""
    left = classes.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("cells").alias("cells_a"))
    right = classes.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("cells").alias("cells_b"))
    both = pairs.join(left, "a").join(right, "b")
    close = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT
    return both.where(close).where(may_link("cells_a", "cells_b", "n_a", "n_b")).select("a", "b")


def sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``cls, shingles`` of the wanted classes (and now and then another one), from the texts that hold them."""
    texts = classes.join(wanted.distinct(), "cls").select("text_hash")
    filter_ = docs.sparkSession.sparkContext.broadcast(bloom(texts))

    # One worker a task finds the texts and makes their sets.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in chunks(whole, limit=CHUNK):
                held = batch.filter(pa.array(held_by(filter_.value, batch.column("text_hash").to_numpy())))
                if not held.num_rows:
                    continue
                found = {}
                for s in shingle_sets(list(byte_texts(held.column("text"))), width):
                    if len(s) and (cls := class_of(s)) not in seen:
                        seen.add(cls)
                        found[cls] = s
                ends = np.cumsum([0, *map(len, found.values())])
                values = np.concatenate([np.zeros(0, np.uint64), *found.values()])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), signed(values))
                yield pa.record_batch([pa.array(list(found), pa.int64()), lists], ["cls", "shingles"])

    rows = docs.where(F.col("text").isNotNull()).select(text_key().alias("text_hash"), "text")
    rows = rows.mapInArrow(run, "cls long, shingles array<long>")
    return settle(rows.groupBy("cls").agg(F.min("shingles").alias("shingles")))


def linked(a: str, b: str) -> Column:
    """Whether two sets are similar enough."""
    both = F.size(F.array_intersect(a, b)).cast("long")
    return both * 100 >= (F.size(a) + F.size(b) - both) * PERCENT


def checked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """The links ``a, b`` among distinct pairs."""
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
    sets = sets_of(docs, classes, ends, width)
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("set_b"))
    return settle(pairs.join(left, "a").join(right, "b").where(linked("set_a", "set_b")).select("a", "b"))


# --- groups that stars leave open --------------------------------------------


def open_groups(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """``key, cls, root, size`` of the lists whose classes are not in one component."""
    of = roots.select(F.col("node").alias("cls"), "root")
    rows = groups.where(F.col("key").isNotNull()).select("key", "cls").distinct()
    rows = rows.join(of, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    facts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
    return settle(rows.join(facts.where(F.col("low") < F.col("high")).select("key", "size"), "key"))


def divided(docs: DataFrame, classes: DataFrame, rows: DataFrame, seed: int, width: int = SHINGLE) -> DataFrame:
    """The long lists by the signatures of another seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, data in zip(batch.column("cls").to_pylist(), batch.column("shingles")):
                found = signatures(data.values.to_numpy().view(np.uint64), seed)
                yield pa.record_batch([pa.array(np.full(len(found), cls)), signed(found)], ["cls", "sign"])

    wanted = rows.select("cls").distinct()
    sets = sets_of(docs, classes, wanted, width).join(wanted, "cls", "left_semi")
    signs = settle(sets.select("cls", "shingles").mapInArrow(run, "cls long, sign long"))
    return rows.select("key", "cls").join(signs, "cls").select(F.xxhash64("key", "sign").alias("key"), "cls")


def compared(rows: DataFrame, classes: DataFrame, few: int = FEW, hubs: bool = False) -> DataFrame:
    """Pairs ``a, b`` between components of a list, within the bound of the counts.

    With ``hubs`` each class is paired only with the one of those that has most of them. A list of more than ``few`` classes is compared as blocks of about so many, each with each.
    """
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = rows.withColumn("blocks", F.ceil(F.col("size") / few).cast("long"))
    dealt = dealt.withColumn("home", F.pmod(F.xxhash64("cls"), F.col("blocks"))).withColumn("other", other)
    tile = [F.least("home", "other").alias("i"), F.greatest("home", "other").alias("j")]
    tiles = dealt.join(classes.select("cls", "n", "cells"), "cls").select("key", *tile, "home", "cls", "root", "n", "cells")

    def pairs(i: int, j: int, home: np.ndarray, cls: np.ndarray, root: np.ndarray, n: np.ndarray, cells: np.ndarray) -> np.ndarray:
        sizes = np.array([len(c) for c in cells])
        there = {int(k): np.flatnonzero((home == j) & (sizes == k)) for k in np.unique(sizes)}
        tables = {k: np.stack([counts_in(cells[x], np.int16) for x in at]) for k, at in there.items() if len(at)}
        smaller = {k: halved(t) for k, t in tables.items()}
        out = []
        for at in np.flatnonzero(home == i):
            own, k = counts_in(cells[at], np.int16), int(sizes[at])
            # linked sets have as many cells, or half or twice as many
            for size, side, mine in ((k, tables, own), (2 * k, smaller, own), (k // 2, tables, halved(own))):
                if size not in side:
                    continue
                to = there[size]
                right = ((cls[to] > cls[at]) | (i != j)) & (root[to] != root[at])
                right &= np.minimum(n[to], n[at]) * 100 >= np.maximum(n[to], n[at]) * PERCENT
                to = to[right]
                near = to[np.abs(side[size][right] - mine).sum(axis=1) <= differ(n[to], n[at])]
                out.append(np.stack([np.full(len(near), at), near]))
        ends = np.concatenate(out, axis=1) if out else np.zeros((2, 0), dtype=np.int64)
        if hubs and ends.size:
            one, other = np.r_[ends[0], ends[1]], np.r_[ends[1], ends[0]]
            order = np.lexsort((cls[other], -np.bincount(one, minlength=len(cls))[other], one))
            first = order[np.r_[True, np.diff(one[order]) != 0]]
            ends = np.stack([one[first], other[first]])
        return np.sort(cls[ends], axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def listed(part: list[np.ndarray]) -> pa.RecordBatch:
            tiles, *facts = part
            first = np.flatnonzero(np.r_[True, (tiles[1:] != tiles[:-1]).any(axis=1)])
            found = [np.zeros((2, 0), dtype=np.int64)]
            for start, end in zip(first, np.r_[first[1:], len(tiles)]):
                found.append(pairs(*tiles[start, 1:], *[f[start:end] for f in facts]))
            ends = np.unique(np.concatenate(found, axis=1), axis=1)
            return pa.record_batch([pa.array(ends[0]), pa.array(ends[1])], ["a", "b"])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {c: batch.column(c).to_numpy() for c in ("key", "i", "j", "home", "cls", "root", "n")}
            tiles = np.stack([columns[c] for c in ("key", "i", "j")], axis=1)
            cells = np.array(batch.column("cells").to_pylist(), dtype=object)
            now = [tiles, *[columns[c] for c in ("home", "cls", "root", "n")], cells]
            last = int(np.flatnonzero((tiles == tiles[-1]).all(axis=1))[0])
            if last or held and (held[-1][0][-1] != tiles[0]).any():
                yield listed([np.concatenate(p) for p in zip(*held, [x[:last] for x in now])])
                held = []
            held.append([x[last:] for x in now])
        if held:
            yield listed([np.concatenate(p) for p in zip(*held)])

    ordered = tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return ordered.mapInArrow(run, "a long, b long")


def find_links(docs: DataFrame, classes: DataFrame, width: int = SHINGLE, few: int = FEW, levels: int = LEVELS) -> DataFrame:
    """``node, root``: the components that links between different classes make."""
    groups = settle(met(signed_classes(docs, width)))
    tried = settle(bounded(stars(groups).distinct(), classes))
    links = checked(docs, classes, tried, width)
    roots = settle(components(links))
    level = 0
    while True:
        rows = open_groups(groups, roots)
        for hubs in (True, False):
            now = rows if level == levels else rows.where(F.col("size") <= few)
            pairs = settle(compared(now, classes, few, hubs).distinct().join(tried, ["a", "b"], "left_anti"))
            tried = tried.unionByName(pairs)
            links = links.unionByName(checked(docs, classes, pairs, width))
            roots = settle(components(links))
            rows = open_groups(rows, roots)
        rows = rows.where(F.col("size") > few)
        if level == levels or rows.isEmpty():
            return roots
        level += 1
        groups = settle(met(divided(docs, classes, rows, level, width)))
        pairs = settle(bounded(stars(groups).distinct().join(tried, ["a", "b"], "left_anti"), classes))
        tried = tried.unionByName(pairs)
        links = links.unionByName(checked(docs, classes, pairs, width))
        roots = settle(components(links))


def stars(groups: DataFrame) -> DataFrame:
    return groups.where(F.col("centre") != F.col("cls")).select(F.col("centre").alias("a"), F.col("cls").alias("b"))


def join_documents(docs: DataFrame, width: int = SHINGLE, few: int = FEW, levels: int = LEVELS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``."""
    marked = settle(with_sets(docs, width))
    some = marked.where(F.col("n") > 0)
    classes = settle(
        some.groupBy("cls").agg(
            F.min(F.struct("text_hash", "n", "cells")).alias("one"), F.min("doc_id").alias("low")
        ).select("cls", "one.text_hash", "one.n", "one.cells", "low")
    )
    roots = find_links(docs, classes.drop("low"), width, few, levels)
    rooted = classes.select("cls", "low").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "cls"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, "root").select("cls", "component_id")
    found = some.join(named, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = marked.where(F.col("n") == 0).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(alone)
