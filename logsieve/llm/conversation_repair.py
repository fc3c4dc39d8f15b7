"""Repair of the turns of conversations: faults marked, roles made to alternate at the least cost by block tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.llm.turn_tables import ASSISTANT, CLOSING, DELETE, KEPT, MADE, START, USER, tables
from logsieve.llm.words import SPACE
from logsieve.session import materialise

_INITIALS = "uas"
_LEGAL = {(2, 0), (0, 1), (1, 0)}
_PLACE = ["conv", "turn", "role", "h1", "h2"]
_NAMES = {USER: "user", ASSISTANT: "assistant"}


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text, copies``: rows spoilt by a number from 0 to 19 that their conversation and turn give.

    0 drops the row, 1 empties its text, 2 takes the marks ``.!?`` out of it, 3 doubles the row, 4 makes it the user's.
    Nulls of role and text are a space, before the damage, and so are nulls in the number's text.
    """
    space = F.lit(" ")
    no = F.crc32(F.concat(F.coalesce(turns[conv].cast("string"), space), F.lit(":"), F.coalesce(turns[turn].cast("string"), space))) % 20
    said = F.coalesce(turns[text], space)
    return turns.where(no != 0).select(
        turns[conv].alias("conv"), turns[turn].cast("long").alias("turn"),
        F.when(no == 4, "user").otherwise(F.coalesce(turns[role], space)).alias("role"),
        F.when(no == 1, "").when(no == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said).alias("text"),
        F.when(no == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _named(turns: DataFrame) -> DataFrame:
    """``turns`` with two hashes of the text, which stand for it and set the order of rows of one turn and role."""
    return turns.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})


def judged(turns: DataFrame) -> DataFrame:
    """One narrow row per different row of ``turns``: ``conv, turn, role, h1, h2, copies, blank, cut, initial, first``.

    ``first`` says that no earlier row of the conversation has its role and text. Equal rows are counted before anything
    is dealt out, and the first of each text is found by an aggregate and handed in as a row of no copies, so there is
    no window and no join on a conversation or a text that holds very many rows.
    """
    bare = F.rtrim("text", F.lit(SPACE))
    initial = F.coalesce(F.array_position(F.array(*map(F.lit, _INITIALS)), F.substring("role", 1, 1)), F.lit(0))
    narrow = _named(turns).select(
        *_PLACE, "copies", (F.length(bare) == 0).alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        ((initial + 3) % 4).cast("int").alias("initial"),
    )
    least = F.min(F.struct("turn", "blank", "cut", "initial")).alias("x")  # a null turn is the least
    firsts = narrow.groupBy("conv", "role", "h1", "h2").agg(least).select(
        "conv", "x.turn", "role", "h1", "h2", F.lit(0).cast("long").alias("copies"), "x.blank", "x.cut", "x.initial", F.lit(True).alias("first"))
    return narrow.withColumn("first", F.lit(False)).unionByName(firsts).groupBy(*_PLACE).agg(
        F.sum("copies").alias("copies"), *[F.max(c).alias(c) for c in ("blank", "cut", "initial", "first")])


class _Segment:
    """Rows of one conversation in a row: symbols of those that may stay, and how many go before each and at the end."""

    def __init__(self, place):
        self.place = place
        self.symbols, self.deleted = bytearray(), [0]
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = None
        self.opens = self.ends = None

    def add(self, turn, copies, blank, cut, initial, first):
        if turn is not None and turn != self.most:
            self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        if self.opens is None:
            self.opens = initial
        else:
            self.illegal += (self.ends, initial) not in _LEGAL
        self.ends = initial
        self.illegal += copies - 1
        if blank:
            self.blank += copies
        elif first:
            self.truncated += cut
            self.symbols.append(2 * initial + cut)
            self.deleted.append(0)
            self.duplicate, copies = self.duplicate + copies - 1, copies - 1
        else:
            self.duplicate += copies
        self.deleted[-1] += copies


_FIGURES = "blank long, duplicate long, truncated long, illegal long"
_SEGMENT = (
    "turn long, role string, h1 long, h2 long, part int, symbols binary, deleted array<long>, dest binary, off binary, "
    f"ends binary, {_FIGURES}, opens int, closes int, least long, most long, turns long"
)


def _segments(narrow: DataFrame, block: int) -> DataFrame:
    """A row per conversation and part of the range partitioning that has rows of it, with its transition.

    Ranges cut a conversation of very many rows into as many parts as it needs. ``part`` rises with the order of rows.
    """
    kind = narrow.schema["conv"].dataType
    schema = f"conv {kind.simpleString()}, {_SEGMENT}"
    columns = [*_PLACE, "copies", "blank", "cut", "initial", "first"]
    ranged = narrow.repartitionByRange(*[F.col(c) for c in _PLACE]).sortWithinPartitions(*_PLACE).select(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = tables(block), TaskContext.get().partitionId()
        conv_type, done, now = None, [], None
        names = [c.split()[0] for c in schema.split(", ")]

        def packed(found):
            rows = []
            for (conv, *place), s in found:
                dest, off, end = known.passed(np.frombuffer(s.symbols, np.uint8).astype(np.int64))
                rows.append((
                    conv, *place, part, bytes(s.symbols), s.deleted, dest.astype(np.uint8).tobytes(), off.tobytes(),
                    end.astype(np.uint8).tobytes(), s.blank, s.duplicate, s.truncated, s.illegal, s.opens, s.ends, s.least, s.most, s.turns,
                ))
            types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()),
                     *[pa.binary()] * 3, *[pa.int64()] * 4, pa.int32(), pa.int32(), *[pa.int64()] * 3]
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            conv_type = batch.schema.field(0).type
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or row[0] != now.place[0]:
                    if now is not None:
                        done.append((now.place, now))
                        if len(done) == 4096:
                            yield packed(done)
                            done = []
                    now = _Segment(row[:5])
                now.add(row[1], *row[5:])
        if now is not None:
            yield packed([*done, (now.place, now)])

    return ranged.mapInArrow(run, schema)


def _joined(segments: DataFrame, block: int) -> DataFrame:
    """Figures of every conversation on the row of its last part; for every part the vector after and the state before it.

    A conversation gives a task one row per part: its transition, not its turns.
    """
    kind = segments.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, part int, after int, state int, closing string, gaps long, {_FIGURES}, cost long"
    gone = F.aggregate("deleted", F.lit(0).cast("long"), lambda a, d: a + d).alias("gone")
    slim = segments.select("conv", "part", "dest", "off", "ends", gone, "blank", "duplicate", "truncated", "illegal", "opens", "closes",
                           "least", "most", "turns").repartition("conv").sortWithinPartitions("conv", "part")

    def combined(rows):
        known = tables(block)
        n, v, cost, held = len(known.vectors), 0, 0, []
        for row in reversed(rows):
            held.append(v)
            cost += int(np.frombuffer(row[3], np.int64)[v]) + DELETE * row[5]
            v = row[2][v]
        cost += int(known.vectors[v][START])
        state, turns, least, most, illegal, ends = START, 0, None, None, 0, None
        for row, v in zip(rows, reversed(held), strict=True):
            illegal += row[9] + (ends is not None and (ends, row[10]) not in _LEGAL)
            ends = row[11]
            if row[12] is not None:
                turns += row[14] - (row[12] == most)
                least, most = row[12] if least is None else least, row[13]
            entered, state = state, np.frombuffer(row[4], np.uint8).reshape(n, 4)[v, state].item()
            closing, figures = None, (None,) * 6
            if row is rows[-1]:
                gaps = 0 if least is None else most - least + 1 - turns
                closing, figures = CLOSING[state], (gaps if gaps < 1 << 63 else None, *[sum(r[i] for r in rows) for i in (6, 7, 8)], illegal, cost)
            yield (row[0], row[1], v, entered, closing, *figures)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, conv_type, held, out = [c.split()[0] for c in schema.split(", ")], None, [], []

        def packed():
            types = [conv_type, pa.int32(), pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for batch in batches:
            conv_type = batch.schema.field(0).type
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and held[-1][0] != row[0]:
                    out.extend(combined(held))
                    held = []
                    if len(out) >= 8192:
                        yield packed()
                        out = []
                held.append(row)
        if held:
            out.extend(combined(held))
            yield packed()

    return slim.mapInArrow(run, schema)


def _pieces(segments: DataFrame, joined: DataFrame, block: int) -> DataFrame:
    """``conv, turn, role, h1, h2, piece``: the edits of every part, under the place of its first row."""
    kind = segments.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, turn long, role string, h1 long, h2 long, piece string"
    told = joined.select(F.col("conv").alias("c"), F.col("part").alias("p"), "after", "state", "closing")
    both = segments.join(told, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).select(
        *_PLACE, "symbols", "deleted", "after", "state", "closing")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tables(block)
        for batch in batches:
            made = []
            for symbols, deleted, after, state, closing in zip(*[batch.column(i).to_pylist() for i in range(5, 10)], strict=True):
                given = np.frombuffer(symbols, np.uint8).astype(np.int64)
                edits = known.traced(given, after, state)
                piece = "D" * deleted[0] + "".join(e + "D" * n for e, n in zip(edits, deleted[1:], strict=True))
                made.append(piece + (closing or ""))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(made, pa.string())], names=[*_PLACE, "piece"])

    return both.mapInArrow(run, schema)


def solve(turns: DataFrame, block: int = 4) -> tuple[DataFrame, DataFrame]:
    """Figures per conversation, and pieces of its edits in order, of ``turns`` (``conv, turn, role, text, copies``)."""
    segments = materialise(_segments(judged(turns), block), "segments")
    joined = materialise(_joined(segments, block), "joined")
    figures = joined.where("closing IS NOT NULL").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return figures, _pieces(segments, joined, block)


def _edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    """``conv, edit, role, text`` of every edit; ``rows``: ``conv, role, copies, text``, pieces having null copies."""
    conv, piece, at, state = None, "", 0, START

    def insert():
        nonlocal at, state
        while at < len(piece) and piece[at] == "I":
            at, state = at + 1, MADE[state]
            yield conv, "I", _NAMES[state], ""

    fresh = True
    for now, role, copies, text in rows:
        if fresh or now != conv:
            yield from insert()
            conv, piece, at, state, fresh = now, "", 0, START, False
        if copies is None:
            yield from insert()
            piece, at = text, 0
            continue
        for _ in range(copies):
            yield from insert()
            edit, at = piece[at], at + 1
            if edit == "R":
                state = MADE[state]
                role = _NAMES[state]
            elif edit == "K":
                state = KEPT[state, _INITIALS.index(role[0])]
            yield conv, edit, role, text
    yield from insert()


def _in_order(turns: DataFrame, pieces: DataFrame) -> DataFrame:
    """Turns and pieces of a conversation together and in order, each piece in front of the rows it is about."""
    both = _named(turns).select(*_PLACE, "copies", "text").unionByName(
        pieces.select(*_PLACE, F.lit(None).cast("long").alias("copies"), F.col("piece").alias("text")))
    return both.repartition("conv").sortWithinPartitions(*_PLACE, F.col("copies").asc_nulls_first()).select("conv", "role", "copies", "text")


def _rows(batches: Iterator[pa.RecordBatch], kinds: list) -> Iterator[tuple]:
    for batch in batches:
        kinds[:] = [batch.schema.field(0).type]
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def repaired(turns: DataFrame, block: int = 4) -> DataFrame:
    """``conv, at, edit, role, text`` of every turn of the repaired conversations, with those deleted (edit D).

    ``turns``: ``conv, turn, role, text, copies``; K keeps, R gives a new role, I inserts. ``at`` counts the edits from 0.
    """
    kind = turns.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list = []
        out, conv, at = [], None, -1
        names = ["conv", "at", "edit", "role", "text"]

        def packed():
            types = [kinds[0], pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for now, edit, role, text in _edited(_rows(batches, kinds)):
            at = at + 1 if at >= 0 and now == conv else 0
            conv = now
            out.append((now, at, edit, role, text))
            if len(out) == 4096:
                yield packed()
                out = []
        if out:
            yield packed()

    return _in_order(turns, solve(turns, block)[1]).mapInArrow(run, f"conv {kind}, at long, edit string, role string, text string")


def _hashed(turns: DataFrame, pieces: DataFrame) -> DataFrame:
    """``conv, audit, repaired_sha256``; texts pass through the hash one by one and none is kept."""
    kind = turns.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list = []
        out, conv, audit, digest, some = [], None, [], None, False

        def packed():
            types = [kinds[0], pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                                              names=["conv", "audit", "repaired_sha256"])

        for now, edit, role, text in _edited(_rows(batches, kinds)):
            if digest is None or now != conv:
                if digest is not None:
                    out.append((conv, "".join(audit), digest.hexdigest()))
                    if len(out) == 4096:
                        yield packed()
                        out = []
                conv, audit, digest, some = now, [], hashlib.sha256(), False
            audit.append(edit)
            if edit != "D":
                digest.update(f"\n{role}:{text}".encode() if some else f"{role}:{text}".encode())
                some = True
        if digest is not None:
            out.append((conv, "".join(audit), digest.hexdigest()))
            yield packed()

    return _in_order(turns, pieces).mapInArrow(run, f"conv {kind}, audit string, repaired_sha256 string")


def repair_digests(conversations: DataFrame, turns: DataFrame, conv: str = "conv_id", block: int = 4) -> DataFrame:
    """Faults, least cost, edits and the hash of the repaired turns for every id in ``conversations``.

    ``turns``: ``conv, turn, role, text, copies`` without null roles, texts and copies, as ``damage`` gives them; a null
    turn comes first, and rows of one turn follow each other by role and hashes of the text (equal ones are neighbours).
    A row's first fault counts: blank, duplicate (role and text seen before), truncated. Blank rows and duplicates have
    to go. The initials of the roles left must read ``(s?(ua)+)?``; a role without initial, or with another one, cannot
    stay as it is. ``audit`` is the cheapest row of edits, of equally cheap ones the least in ASCII order.

    A null conversation is one like others. Ids without a row in ``turns`` have zeros, no edits and the hash of no text.
    ``gaps`` is null where it fits no long. Further columns are not read; an empty table gives no rows.
    A conversation of very many rows is cut into ranges of rows wherever it is judged and solved; only its hash, which is
    serial, reads it in one task, row by row. Duplicates go by two 64-bit hashes of the text.
    """
    figures, pieces = solve(turns, block)
    hashes = _hashed(turns, pieces).withColumnRenamed("conv", "h")
    ids = conversations.select(conversations[conv].alias("id")).distinct()
    zero: dict[str, Column] = {c: F.when(F.col("cost").isNull(), 0).otherwise(F.col(c)).cast("long").alias(c)
                               for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return ids.join(figures, F.col("id").eqNullSafe(F.col("conv")), "left").join(hashes, F.col("id").eqNullSafe(F.col("h")), "left").select(
        F.col("id").alias(conv), *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
