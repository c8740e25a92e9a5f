import hashlib
import random
import re
import zlib

import pytest
from ratepanel.llm import turns

CONV = "conv_id long, turn long, role string, text string"
CLASHING = ", place int, _row long, audit string, cost double, fault string, cells string"
WHITE = " \t\n\x0b\x0c\r"


def odd_conversations():
    rows = [
        (1, 0, "user", "Hello."),
        (1, 1, "assistant", "Hi"),
        (1, 1, "assistant", "Hi"),
        (1, 3, "system", "Late."),
        (2, None, "user", "No turn."),
        (2, None, "assistant", "Nor here!"),
        (2, 5, None, "No role."),
        (2, 7, "user", None),
        (3, 0, "system", "Only."),
        (4, 0, "user", " \t\n "),
        (5, 0, "assistant", "x" * 300_000 + "."),
        (5, 1, "", "No initial?"),
        (5, 2, "User", "Upper."),
        (None, 0, "user", "Nobody's."),
        (None, 1, "user", "Nobody's again."),
        (6, 0, None, None),
        (7, 2**62, "user", "Far."),
        (7, -(2**62) - 5, "assistant", "Near."),
        (8, 1, "user", "A.\x1c"),
        (8, 2, "tool", "日本語!"),
    ]
    rng = random.Random(3)
    for conv in range(20, 40):
        for turn in range(rng.randint(1, 40)):
            text = rng.choice(["Yes.", "No!", "Why?", "cut", "", "more. ", f"{turn}."])
            rows.append((conv, turn, rng.choice(["user", "assistant"] * 4 + ["system", "x"]), text))
    return rows


def plain(rows):
    return [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]


def cheapest(cells):
    """Least cost, audit and repair over the phases of the grammar, turn by turn."""

    def put(states, phase, value):
        if phase not in states or value < states[phase]:
            states[phase] = value

    def with_inserts(states):
        out = dict(states)
        for _ in range(3):
            for phase, (cost, audit, said) in list(out.items()):
                role, after = ("assistant", 3) if phase == 2 else ("user", 2)
                put(out, after, (cost + 2, audit + "I", said + ((role, ""),)))
        return out

    states = {0: (0, "", ())}
    for role, text, fault in cells:
        new = {}
        for phase, (cost, audit, said) in with_inserts(states).items():
            put(new, phase, (cost + 3, audit + "D", said))
            if fault in "bd":
                continue
            more = fault == "t"
            if role[:1] in ("s", "u", "a") and role[0] in {0: "su", 1: "u", 2: "a", 3: "u"}[phase]:
                put(new, {"s": 1, "u": 2, "a": 3}[role[0]], (cost + more, audit + "K", said + ((role, text),)))
            other, after = ("assistant", 3) if phase == 2 else ("user", 2)
            put(new, after, (cost + 2 + more, audit + "R", said + ((other, text),)))
        states = new
    ends = with_inserts(states)
    return min(ends[p] for p in (0, 3) if p in ends)


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in plain(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        cells, seen = [], set()
        for _, _, role, text in mine:
            body = text.rstrip(WHITE)
            fault = "b" if not body else "d" if (role, text) in seen else "-" if body[-1] in ".!?" else "t"
            seen.add((role, text))
            cells.append((role, text, fault))
        numbers = [r[1] for r in mine if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        marks = [c[2] for c in cells]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(cells, cells[1:]))
        cost, audit, said = cheapest(cells)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        out[conv] = (min(gaps, 2**63 - 1), marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, audit, sha, said)
    return out


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        said = [" " if x is None else x for x in (conv, turn, role, text)]
        fate = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", said[3]) if fate == 2 else said[3]
        row = (conv, turn, "user" if fate == 4 else said[2], text)
        out += [row] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def frame(spark, rows):
    return spark.createDataFrame([r + (1, 2, "x", 0.5, "f", "c") for r in rows], CONV + CLASHING)


@pytest.mark.parametrize("size,fan", [(64, 64), (3, 2), (1, 3)])
def test_odd_rows_in_blocks_of_any_size(spark, size, fan):
    rows = odd_conversations()
    placed = turns.placed(frame(spark, rows))
    found = turns.planned(placed, size, fan)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    expected = brute(rows)
    assert {r["conv_id"]: tuple(r[n] for n in names) for r in found.collect()} == {k: v[:7] for k, v in expected.items()}
    digests = turns.digests(placed, found)
    assert {r["conv_id"]: r["repaired_sha256"] for r in digests.collect()} == {k: v[7] for k, v in expected.items()}


def test_repaired_rows(spark):
    rows = odd_conversations()
    said = {}
    for r in sorted(turns.repair(frame(spark, rows)).collect(), key=lambda r: r["place"]):
        said.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert said == {k: list(v[8]) for k, v in brute(rows).items() if v[8]}


def test_damage(spark, sf):
    rows = odd_conversations() + [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    found = turns.repair_damage(frame(spark, rows)).collect()
    expected = brute(damage(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {tuple(r)[0]: tuple(r)[1:] for r in found} == {c: expected.get(c, nothing)[:8] for c in {r[0] for r in rows}}
    assert len(found) == len({r[0] for r in rows})


def test_alignment_between_phases():
    rng = random.Random(5)
    for _ in range(400):
        cells = [(rng.choice(["s", "u", "a", "u", "a", "x"]), str(i), rng.choice("--tbd")) for i in range(rng.randint(0, 8))]
        cost, audit, _ = cheapest(cells)
        text = "".join(a + c for a, _, c in cells)
        assert min(x for x in (turns.cheapest(text, 0, 0), turns.cheapest(text, 0, 3)) if x) == (cost, audit)


def test_long_conversation_of_one_role(spark):
    rows = [(1, i, "user", f"{i}.") for i in range(2000)]
    found = turns.planned(turns.placed(spark.createDataFrame(rows, CONV))).collect()
    assert [(r["cost"], r["illegal"], r["audit"]) for r in found] == [(2000, 1999, cheapest([("user", "", "-")] * 2000)[1])]


def test_no_rows(spark):
    empty = spark.createDataFrame([], CONV)
    assert turns.repair_damage(empty).collect() == []
    assert turns.repair(empty).collect() == []
