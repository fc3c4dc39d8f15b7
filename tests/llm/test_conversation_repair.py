"""Repairs against a plain search over all edits, row by row."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logsieve.llm.conversation_repair import damage, repair_digests, repaired
from logsieve.llm.turn_tables import CLOSING, tables

BLANK, MARKS = re.compile(r"[^\x20\x09-\x0d]"), re.compile("[.!?]")


def spoilt(rows):
    kept = []
    for conv, turn, role, text in rows:
        no = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if no == 0:
            continue
        text = "" if no == 1 else MARKS.sub("", text) if no == 2 else text
        kept += [(conv, turn, "user" if no == 4 else role, text)] * (2 if no == 3 else 1)
    return kept


def place(row):
    """Rows of one turn and role in the order of the hash that Spark gives their text."""
    conv, turn, role, text = row
    h = np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).astype(np.int64)
    return (turn is not None, turn or 0, role.encode(), int(h))


def cheapest(turns):
    """Least cost and least audit; ``turns``: role, fault."""

    @lru_cache(None)
    def go(i, said, made):
        found = []
        if i == len(turns):
            if re.fullmatch("(s?(ua)+)?", said):
                found.append((0, ""))
        else:
            role, fault = turns[i]
            cost, audit = go(i + 1, said, 0)
            found.append((cost + 4, "D" + audit))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                for edit, price, initial in [("K", 0, role[:1]), ("R", 3, "u"), ("R", 3, "a")]:
                    if initial and re.fullmatch("s?(ua)*u?", said + initial):
                        cost, audit = go(i + 1, short(said + initial), 0)
                        found.append((cost + price + extra, edit + audit))
        if made < 3:
            for initial in "ua":
                if re.fullmatch("s?(ua)*u?", said + initial):
                    cost, audit = go(i, short(said + initial), made + 1)
                    found.append((cost + 3, "I" + audit))
        return min(found, default=(10**9, ""))

    def short(said):
        return said if len(said) < 4 else said[:-2]

    return go(0, "", 0)


def plain(rows):
    groups = defaultdict(list)
    for row in spoilt(rows):
        groups[row[0]].append(row)
    out = {}
    for conv in {r[0] for r in rows}:
        seen, turns, faults = set(), [], []
        mine = sorted(groups[conv], key=place)
        for _, _, role, text in mine:
            marks = BLANK.findall(text)
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None
            seen.add((role, text))
            turns.append((role, fault))
            faults.append(fault)
        cost, audit = cheapest(tuple(turns))
        at, said, left = 0, [], ""
        for edit in audit:
            if edit in "IR":
                role = "assistant" if left.endswith("u") else "user"
            if edit == "I":
                said.append(f"{role}:")
            else:
                _, _, old, text = mine[at]
                at += 1
                if edit == "D":
                    continue
                role = old if edit == "K" else role
                said.append(f"{role}:{text}")
            left += role[0]
        nos = [t for _, t, _, _ in mine if t is not None]
        initials = [role[:1] for role, _ in turns]
        out[conv] = (
            max(nos) - min(nos) + 1 - len(set(nos)) if nos else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(said).encode()).hexdigest(),
        )
    return out


def made_up(seed, convs, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", " \t", "Why?", "So! ", "a.b", "…", "ß!", None, "x" * 70_000 + "."] + [f"t{i}." for i in range(40)]
    roles = ["user", "assistant"] * 8 + ["system", "tool", "", None, "utter", "User"]
    rows = []
    for conv in [*range(convs), None]:
        for turn in range(rng.randint(0, most)):
            no = None if rng.random() < 0.1 else turn + rng.choice([0, 0, 0, 1, 5])
            rows += [(conv, no, rng.choice(roles), rng.choice(texts))] * rng.choice([1, 1, 1, 1, 2])
    return rows


FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def found(spark, rows):
    given = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {r.conv_id: tuple(r[c] for c in FIGURES) for r in repair_digests(given, damage(given)).collect()}


@pytest.mark.parametrize("block", [1, 3, 4])
def test_tables_find_the_cheapest_edits(block):
    rng, known, names = random.Random(block), tables(block), ["user", "assistant", "system", "x"]
    for _ in range(400):
        symbols = [rng.randrange(8) for _ in range(rng.randint(0, 13))]
        cost, audit = cheapest(tuple((names[s >> 1], "truncated" if s & 1 else None) for s in symbols))
        given = np.array(symbols, np.int64)
        dest, off, end = known.passed(given)
        assert cost == off[0] + known.vectors[dest[0]][0]
        assert audit == "".join(known.traced(given, 0, 0)) + CLOSING[end[0][0]]


def test_conversations_as_plain_search(spark):
    rows = made_up(1, 120, 12)
    assert found(spark, rows) == plain(rows)


def test_a_conversation_with_most_rows_is_cut_into_ranges(spark):
    """The parts of a long conversation give the figures and edits of the whole."""
    rng = random.Random(4)
    rows = made_up(2, 10, 6) + [(3, rng.randrange(400), rng.choice(["user", "assistant", "tool"]), f"{rng.randrange(900)}" + rng.choice([".", ""]))
                                for _ in range(600)]
    assert found(spark, rows) == plain(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hm."), (1, 2, "user", "Hi?"), (1, 3, "user", "Hi?"), (1, 4, "assistant", "Lo.")]
    turns = spark.createDataFrame(rows, "conv long, turn long, role string, text string").withColumn("copies", F.lit(1).cast("long"))
    got = sorted((r.at, r.edit, r.role, r.text) for r in repaired(turns).collect())
    assert got == [(0, "K", "system", "Be kind."), (1, "I", "user", ""), (2, "K", "assistant", "Hm."), (3, "K", "user", "Hi?"),
                   (4, "D", "user", "Hi?"), (5, "K", "assistant", "Lo.")]


def test_empty_tables_other_types_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair_digests(empty, damage(empty)).collect() == []
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found(spark, [(dropped, 0, "user", "Hi.")]) == {dropped: nothing}
    named = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "assistant", "Ho.")], "conv_id string, turn int, role string, text string")
    wide = named.withColumns({c: F.lit(1) for c in ("conv", "h1", "h2", "copies", "first", "part", "cost", "id", "piece")})
    plainly = {r.conv_id: r for r in repair_digests(named, damage(named)).collect()}
    assert {r.conv_id: r for r in repair_digests(wide, damage(wide)).collect()} == plainly
    assert list(plainly) == ["a"]


def test_turns_as_far_apart_as_can_be(spark):
    ends = [(7, -(2**63), "user", "Hi."), (7, 2**63 - 1, "assistant", "Ho.")]
    kept = spoilt(ends)
    assert found(spark, ends)[7][0] == (None if len(kept) > 1 and kept[0][1] != kept[-1][1] else 0)
