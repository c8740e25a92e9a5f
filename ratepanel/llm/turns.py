"""Conversation structure repair by Wagner-Fischer target alignment.

A well-formed conversation has role initials ``(s?(ua)+)?``. Its turns are edited into
that grammar at the least cost: keep a turn (0), give it the other role (2), delete it (3;
blank turns and repeats of an earlier turn must go), insert an empty turn (2); a truncated turn
that stays adds 1. The *audit* names the edits in order by their initials, K, R, D and I; of
the cheapest edits the ASCII-least audit is taken.

The grammar has one string of each feasible length (two where a system turn can lead).
Turns are aligned to each of them with the Wagner-Fischer table, nearest lengths first, and
only within the Ukkonen band that the incumbent's cost leaves; backtraced audits of
equal cost are compared.

A conversation may be any size. Rows are placed by ranges of (conversation, turn), cut
into blocks of at most ``BLOCK`` turns, and each block is aligned for every phase of the
grammar it can begin and end in. The blocks' tables are then joined in a tree, ``FAN`` at a
time, which is exact: the cheapest edits of a chain are chains of cheapest edits. Only the digest
of a repaired conversation reads its rows in one task, as a stream, because
a hash has to.

Defined results: a null role or text counts as one space, a null turn comes first, rows
without a conversation id are one conversation. Rows of one turn stand in the order of role and text, and
equal rows are repeats. Texts of any length are compared by 128-bit hash, and only reach a
task to be written. A conversation whose turns all go has an empty audit of its
rows' D's and the hash of the empty string. No rows give no rows. Further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratepanel.session import settle

WHITE = " \t\n\x0b\x0c\r"
BLOCK = 64
FAN = 64
KNOWN = 20_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LETTERS = "DIKR"

# Phases of the grammar: nothing yet, after s, after u, after a. A conversation ends in 0 or 3.
AFTER = {"s": 1, "u": 2, "a": 3}
LEGAL = {"su", "ua", "au"}

Choice = tuple[int, str]
Table = dict[tuple[int, int], Choice]


# --- alignment --------------------------------------------------------------


def imbalance(rows: int, letters: int) -> int:
    return DELETE * (rows - letters) if rows > letters else INSERT * (letters - rows)


def align(cells: list[tuple[str, str]], target: str, limit: int) -> Choice | None:
    """The cheapest audit that turns the initials of ``cells`` into ``target``, if at most ``limit``.

    A cell is an initial and its fault: ``b`` or ``d`` must go, ``t`` is truncated.
    """
    n, m = len(cells), len(target)
    free = [0]  # rows so far that may stay
    for _, fault in cells:
        free.append(free[-1] + (fault not in "bd"))
    spare = limit - DELETE * (n - free[n]) - imbalance(free[n], m)
    if spare < 0:
        return None
    side = spare // (DELETE + INSERT)
    drift = m - free[n]
    least, most = min(0, drift) - side, max(0, drift) + side
    far = limit + 1
    costs: list[dict[int, int]] = [{} for _ in range(n + 1)]
    for i in range(n, -1, -1):
        row, below = costs[i], costs[i + 1] if i < n else {}
        initial, fault = cells[i] if i < n else ("", "b")
        extra = TRUNCATED if fault == "t" else 0
        for j in range(min(m, free[i] + most), max(0, free[i] + least) - 1, -1):
            if i == n and j == m:
                row[j] = 0
                continue
            best = below.get(j, far) + DELETE
            if j < m:
                if target[j] != "s":
                    best = min(best, row.get(j + 1, far) + INSERT)
                if fault not in "bd":
                    step = KEEP if initial == target[j] else REROLE if target[j] != "s" else far
                    best = min(best, below.get(j + 1, far) + step + extra)
            row[j] = min(best, far)
    total = costs[0].get(0, far)
    if total > limit:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:
        here = costs[i][j]
        if i < n and costs[i + 1].get(j, far) + DELETE == here:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and costs[i].get(j + 1, far) + INSERT == here:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if cells[i][0] == target[j] else "R")
            i, j = i + 1, j + 1
    return total, "".join(audit)


def alternating(first: str, length: int) -> str:
    other = "a" if first == "u" else "u"
    return ((first + other) * (length // 2 + 1))[:length]


def lead(start: int, end: int) -> list[tuple[str, str, int]]:
    """The strings that lead from one phase to another: a head, the letter after it, and whether their rest is odd."""
    if end in (0, 1):
        return [("", "u", -1)] if start == end else [("s", "u", -1)] if (start, end) == (0, 1) else []
    if start == 0:
        return [("", "u", end == 2), ("s", "u", end == 2)]
    return [("", "a" if start == 2 else "u", (end == 2) != (start == 2))]


def cheapest(cells: str, start: int, end: int) -> Choice | None:
    """The least (cost, audit) of a block of ``cells`` (initial and fault by turns) from phase to phase."""
    rows = list(zip(cells[::2], cells[1::2]))
    free = [r for r in rows if r[1] not in "bd"]
    forced = DELETE * (len(rows) - len(free))
    targets = []
    for head, first, odd in lead(start, end):
        if head and not any(initial == "s" for initial, _ in free):
            continue
        # Beyond twice the rows and a few letters even deleting all rows is cheaper.
        lengths = [0] if odd == -1 else range(int(odd), 3 * len(free) + 4, 2)
        # in phase 0 an empty string does not lead to phase 3, nor to 2
        targets += [head + alternating(first, k) for k in lengths if k or odd == -1 or start == end or head and end == 1]
    best: Choice | None = None
    limit = forced + DELETE * len(free) + INSERT * 3  # all deleted, at most three inserted
    for target in sorted(targets, key=lambda t: imbalance(len(free), len(t))):
        if forced + imbalance(len(free), len(target)) > limit:
            break
        straight = sum(
            (KEEP if initial == letter else REROLE) + (fault == "t") for (initial, fault), letter in zip(free, target)
        ) + sum(fault == "t" for _, fault in free[len(target) :])
        if "s" not in target or (free and free[0][0] == "s"):
            limit = min(limit, forced + straight + imbalance(len(free), len(target)))
        found = align(rows, target, limit)
        if found and (best is None or found < best):
            best, limit = found, min(limit, found[0])
    return best


def table(cells: str, first: bool, last: bool, known: dict[tuple, Table] | None = None) -> Table:
    """Least costs and audits from phase to phase; ``known`` keeps those of cells seen before."""
    known = {} if known is None else known
    if (cells, first, last) not in known:
        if len(known) >= KNOWN:
            known.clear()
        starts, ends = (0,) if first else (0, 1, 2, 3), (0, 3) if last else (0, 1, 2, 3)
        found = {(s, e): cheapest(cells, s, e) for s in starts for e in ends}
        known[cells, first, last] = {k: v for k, v in found.items() if v is not None}
    return known[cells, first, last]


def chained(a: Table, b: Table) -> Table:
    out: Table = {}
    for (start, middle), (cost, audit) in a.items():
        for (again, end), (more, rest) in b.items():
            if middle == again:
                choice = (cost + more, audit + rest)
                if (start, end) not in out or choice < out[start, end]:
                    out[start, end] = choice
    return out


def illegal(cells: str, before: str | None) -> int:
    initials = (before or "") + cells[::2]
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


# --- rows, blocks and their tables ------------------------------------------


def _white_end(text: Column) -> Column:
    return F.substring(F.rtrim(text, F.lit(WHITE)), -1, 1)


def placed(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, _row``: rows in order; ``_row`` grows along it."""
    rows = conversations.select(
        "conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    )
    dealt = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return settle(dealt.withColumn("_row", F.monotonically_increasing_id()))


def faults(rows: DataFrame) -> DataFrame:
    """Marks of the placed rows: the initial and the first fault, ``b``, ``d``, ``t`` or ``-``."""
    key = [F.xxhash64("role", "text").alias("_h1"), F.xxhash64("text", F.lit(1), "role").alias("_h2")]
    marks = rows.select("conv_id", "turn", "_row", F.substring("role", 1, 1).alias("initial"), *key, _white_end(F.col("text")).alias("end"))
    seen = marks.groupBy("conv_id", "_h1", "_h2").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    again = seen.where(F.col("_n") > 1).select(F.col("conv_id").alias("_conv"), F.col("_h1").alias("_k1"), F.col("_h2").alias("_k2"), "_first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_h1") == F.col("_k1")) & (F.col("_h2") == F.col("_k2"))
    fault = (
        F.when(F.col("end") == "", "b")
        .when(F.col("_row") > F.col("_first"), "d")
        .when(~F.col("end").isin(".", "!", "?"), "t")
        .otherwise("-")
    )
    plain = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    return marks.join(again, same, "left").select("conv_id", "turn", "_row", plain.alias("initial"), fault.alias("fault"))


def blocks(marks: DataFrame, size: int = BLOCK) -> DataFrame:
    """Runs of at most ``size`` turns of a conversation, numbered, with what the run before them ends in."""
    cell = F.struct("_row", F.concat("initial", "fault").alias("cell"))
    runs = marks.groupBy("conv_id", F.floor(F.col("_row") / size).alias("_run")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["cell"]), "").alias("cells"),
        F.min("turn").alias("low"),
        F.max("turn").alias("high"),
        F.size(F.collect_set("turn")).cast("long").alias("turns"),
    )
    inside = Window.partitionBy("conv_id").orderBy("_run")
    before = F.lag(F.substring("cells", -2, 1)).over(inside)
    shared = F.coalesce((F.lag("high").over(inside) == F.col("low")).cast("long"), F.lit(0))
    return runs.select(
        "conv_id",
        (F.row_number().over(inside) - 1).alias("place"),
        F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("runs"),
        "cells",
        before.alias("before"),
        "low",
        "high",
        (F.col("turns") - shared).alias("turns"),
    )


TABLE = "conv_id long, place int, runs long, ends array<int>, costs array<long>, audits array<string>"
COUNTED = ["blank", "duplicate", "truncated", "illegal", "turns", "low", "high"]
SOLVED = TABLE + ", " + ", ".join(f"{c} long" for c in COUNTED)


def _row(conv: int | None, place: int, runs: int, found: Table, counts: list) -> dict:
    keys = sorted(found)
    return {
        "conv_id": conv,
        "place": place,
        "runs": runs,
        "ends": [4 * s + e for s, e in keys],
        "costs": [found[k][0] for k in keys],
        "audits": [found[k][1] for k in keys],
    } | dict(zip(COUNTED, counts))


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


ARROW = pa.schema(
    [("conv_id", pa.int64()), ("place", pa.int32()), ("runs", pa.int64()), ("ends", pa.list_(pa.int32()))]
    + [("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
    + [(c, pa.int64()) for c in COUNTED]
)


def solved(runs: DataFrame) -> DataFrame:
    """The table of every run: least cost and audit from phase to phase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, Table] = {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                found = table(r["cells"], r["place"] == 0, r["place"] == r["runs"] - 1, known)
                marks = r["cells"][1::2]
                counts = [marks.count("b"), marks.count("d"), marks.count("t"), illegal(r["cells"], r["before"])]
                out.append(_row(r["conv_id"], r["place"], r["runs"], found, counts + [r["turns"], r["low"], r["high"]]))
            yield _batch(out, ARROW)

    return runs.mapInArrow(run, SOLVED)


def _merged(a: list, b: list) -> list:
    sums = [x + y for x, y in zip(a[:5], b[:5])]
    low = min((x for x in (a[5], b[5]) if x is not None), default=None)
    return sums + [low, max((x for x in (a[6], b[6]) if x is not None), default=None)]


def joined(tables: DataFrame, fan: int = FAN) -> DataFrame:
    """Every ``fan`` neighbouring tables of a conversation made one, by halves."""

    def fold(part: list[tuple[Table, list]]) -> tuple[Table, list]:
        while len(part) > 1:
            pairs = [(chained(a[0], b[0]), _merged(a[1], b[1])) for a, b in zip(part[::2], part[1::2])]
            part = pairs + part[len(pairs) * 2 :]
        return part[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[Table, list]] = []
        mark = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                now = (r["conv_id"], r["place"] // fan, -(-r["runs"] // fan))
                if held and now != mark:
                    out.append(_row(*mark, *fold(held)))
                    held = []
                mark = now
                found = {divmod(k, 4): (c, a) for k, c, a in zip(r["ends"], r["costs"], r["audits"])}
                held.append((found, [r[c] for c in COUNTED]))
            yield _batch(out, ARROW)
        if held:
            yield _batch([_row(*mark, *fold(held))], ARROW)

    up = F.floor(F.col("place") / fan)
    return tables.repartition("conv_id", up).sortWithinPartitions("conv_id", "place").mapInArrow(run, SOLVED)


def planned(rows: DataFrame, size: int = BLOCK, fan: int = FAN) -> DataFrame:
    """One row a conversation of placed ``rows``: its faults and the cheapest edits."""
    tables = settle(solved(blocks(faults(rows), size)))
    done, rest = tables.where(F.col("runs") == 1), tables.where(F.col("runs") > 1)
    while not rest.isEmpty():
        tables = settle(joined(rest, fan))
        done, rest = done.unionByName(tables.where(F.col("runs") == 1)), tables.where(F.col("runs") > 1)
    ends = F.array_min(F.arrays_zip(F.col("costs").alias("cost"), F.col("audits").alias("audit")))
    # beyond 64 bits a span of turns is as long as can be said
    span = F.col("high").cast("decimal(20,0)") - F.col("low") + 1 - F.col("turns")
    gaps = F.least(span, F.lit(2**63 - 1).cast("decimal(20,0)")).cast("long")
    return settle(
        done.select(
            "conv_id",
            F.coalesce(gaps, F.lit(0).cast("long")).alias("gaps"),
            *COUNTED[:4],
            ends["cost"].alias("cost"),
            ends["audit"].alias("audit"),
        )
    )


# --- applying the edits -----------------------------------------------------


class Mender:
    """Applies an audit to a conversation's rows as they come."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.phase = audit, 0, 0

    def _said(self) -> str:
        role = "assistant" if self.phase == 2 else "user"
        self.phase = AFTER[role[0]]
        return role

    def inserted(self) -> list[tuple[str, str, str]]:
        out = []
        while self.audit[self.at : self.at + 1] == "I":
            out.append(("I", self._said(), ""))
            self.at += 1
        return out

    def row(self, role: str, text: str) -> list[tuple[str, str, str]]:
        out = self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.phase = AFTER[role[0]]
            out.append((edit, role, text))
        elif edit == "R":
            out.append((edit, self._said(), text))
        return out


def _streamed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order."""
    first = plan.select("conv_id", F.lit(-1).cast("long").alias("_row"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = rows.select("conv_id", "_row", "role", "text").unionByName(first)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "_row")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int | None, list[tuple[str, str, str]]]]:
    """``new`` at each conversation's start, then ``rows`` as they are repaired."""
    mender, conv = None, None
    for batch in batches:
        for r in batch.to_pylist():
            if r["_row"] == -1:
                if mender:
                    yield "rows", conv, mender.inserted()
                mender, conv = Mender(r["text"]), r["conv_id"]
                yield "new", conv, []
            else:
                yield "rows", conv, mender.row(r["role"], r["text"])
    if mender:
        yield "rows", conv, mender.inserted()


REPAIRED = pa.schema(
    [("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.large_string())]
)


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, place, edit, role, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place, held = [], 0, 0
        for kind, conv, rows in _pieces(batches):
            place = 0 if kind == "new" else place
            for edit, role, text in rows:
                out.append({"conv_id": conv, "place": place, "edit": edit, "role": role, "text": text})
                place, held = place + 1, held + len(text)
            if len(out) >= 1000 or held > 8_000_000:
                yield _batch(out, REPAIRED)
                out, held = [], 0
        yield _batch(out, REPAIRED)

    rows = placed(conversations)
    schema = "conv_id long, place long, edit string, role string, text string"
    return _streamed(rows, planned(rows)).mapInArrow(run, schema)


DIGEST = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def digests(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of the repaired ``role:text``, joined by newlines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, sha, conv, any_yet = [], None, None, False
        for kind, now, rows in _pieces(batches):
            if kind == "new":
                if sha:
                    out.append({"conv_id": conv, "repaired_sha256": sha.hexdigest()})
                sha, conv, any_yet = hashlib.sha256(), now, False
            for _, role, text in rows:
                sha.update((("\n" if any_yet else "") + f"{role}:{text}").encode())
                any_yet = True
            if len(out) >= 10_000:
                yield _batch(out, DIGEST)
                out = []
        if sha:
            out.append({"conv_id": conv, "repaired_sha256": sha.hexdigest()})
        yield _batch(out, DIGEST)

    return _streamed(rows, plan).mapInArrow(run, "conv_id long, repaired_sha256 string")


def structure(conversations: DataFrame) -> DataFrame:
    """One row a conversation: faults, cost, audit and digest of its repair."""
    rows = placed(conversations)
    plan = planned(rows)
    sha = digests(rows, plan).withColumnRenamed("conv_id", "_conv")
    return plan.join(sha, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")


# --- the query's damage -----------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut short, repeated or given another role by a hash of their place."""
    said = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fate = F.crc32(F.concat(said["conv_id"], F.lit(":"), said["turn"])) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(said["text"], "[.!?]", "")).otherwise(said["text"])
    role = F.when(fate == 4, "user").otherwise(said["role"])
    times = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_times"))
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).drop("_copy", "_times")


def repair_damage(conversations: DataFrame) -> DataFrame:
    """The repair of the damaged conversations, one row for each one there was."""
    found = structure(damaged(conversations)).withColumnRenamed("conv_id", "_conv")
    all_of = conversations.select("conv_id").distinct()
    numbers = ["gaps", *COUNTED[:4], "cost"]
    nothing = hashlib.sha256(b"").hexdigest()
    return all_of.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
