"""Lines that an earlier document already has: rare line hashes pair documents, patience diff aligns each pair."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.session import materialise

_BLANK = 0


def line_hashes(text: str) -> tuple[list[int], list[int]]:
    """Hash and words of every line; lines are equal if their words are, and one without words has hash 0."""
    words = [line.split() for line in text.encode("utf-8", "surrogatepass").split(b"\n")]
    return [int.from_bytes(xxhash.xxh3_64_digest(b" ".join(w)), "big", signed=True) or 1 if w else _BLANK for w in words], list(map(len, words))


def run_hashes(hashes: list[int], counts: list[int], min_words: int) -> tuple[list[int | None], list[int | None]]:
    """For each line the hash of the run that starts there, and of the run that ends there.

    A run is the fewest lines in a row that hold ``min_words`` words; lines without words count for nothing. Every line
    of a longer stretch lies in a run of that stretch, if not in one that starts there or before, in the one it ends.
    """
    starts: list[int | None] = [None] * len(counts)
    ends: list[int | None] = [None] * len(counts)
    full = [i for i, n in enumerate(counts) if n]
    packed = np.array([hashes[i] for i in full], "<i8").tobytes()
    name = lambda a, b: int.from_bytes(xxhash.xxh3_64_digest(packed[8 * a : 8 * b]), "big", signed=True)
    held, stop = 0, 0
    for start, i in enumerate(full):
        while held < min_words and stop < len(full):
            held += counts[full[stop]]
            stop += 1
        if held < min_words:
            break
        starts[i] = name(start, stop)
        held -= counts[i]
    held, start = 0, 0
    for stop, i in enumerate(full):
        held += counts[i]
        while held - counts[full[start]] >= min_words:
            held -= counts[full[start]]
            start += 1
        if held >= min_words:
            ends[i] = name(start, stop + 1)
    return starts, ends


def sketch(text: str, min_words: int) -> tuple[list[int], list[int], list[int]]:
    """Hash and words of every line, and the different runs."""
    hashes, counts = line_hashes(text)
    starts, ends = run_hashes(hashes, counts, min_words)
    return hashes, counts, sorted({r for r in (*starts, *ends) if r is not None})


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of ``pairs`` (rising in the first) that rises in the second too, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    behind: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        behind.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[pile], at[pile] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = behind[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of equal elements: those unique in both anchor, equal ends are matched, gaps are done again."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if once_b[b[j]] == 1}
        anchors = _rising([(i, place[a[i]]) for i in range(a0, a1) if once_a[a[i]] == 1 and a[i] in place])
        if not anchors:
            continue
        out += anchors
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            todo.append((i + 1, k, j + 1, m))
    return sorted(out)


def deleted_lines(later: list[int], counts: list[int], earlier: list[int], earlier_counts: list[int], min_words: int) -> list[int]:
    """Places of the lines of ``later`` in aligned blocks of ``min_words`` words with ``earlier``.

    Blocks that the alignment leaves out, as they stand in another order or repeat, are found by their runs and go too.
    """
    mine = [i for i, h in enumerate(later) if h != _BLANK]
    theirs = [j for j, h in enumerate(earlier) if h != _BLANK]
    a, b = [later[i] for i in mine], [earlier[j] for j in theirs]
    gone: set[int] = set()
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(counts[mine[k]] for k in block) >= min_words:
                gone.update(block)
            block = []
        block.append(i)
        last = (i, j)
    own, other = run_hashes(later, counts, min_words), run_hashes(earlier, earlier_counts, min_words)
    for runs, their_runs, step in zip(own, other, (1, -1), strict=True):
        first: dict[int, int] = {}
        for j, at in enumerate(theirs):
            if their_runs[at] is not None:
                first.setdefault(their_runs[at], j)
        for i, at in enumerate(mine):
            if runs[at] not in first:
                continue
            j, held = first[runs[at]], 0
            # on from there while the lines agree; once past the run, what is gone already need not be gone through again
            while 0 <= i < len(a) and 0 <= j < len(b) and a[i] == b[j] and not (held >= min_words and i in gone):
                gone.add(i)
                held += counts[mine[i]]
                i, j = i + step, j + step
    return sorted(mine[i] for i in gone)


_SKETCH = "id {0}, text_hash long, lines array<long>, counts array<int>, runs array<long>"
_LONGS = pa.list_(pa.int64())


def sketches(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """Sketches of the documents that have a run at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(t or "", min_words) for t in batch.column(2).to_pylist()]
            full = [i for i, m in enumerate(made) if m[2]]
            lines, counts, runs = zip(*(made[i] for i in full), strict=True) if full else ((), (), ())
            keep = pa.array(full, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(keep), batch.column(1).take(keep), pa.array(lines, _LONGS),
                 pa.array(counts, pa.list_(pa.int32())), pa.array(runs, _LONGS)],
                names=["id", "text_hash", "lines", "counts", "runs"])

    text = docs[text_col]
    slim = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return slim.mapInArrow(run, _SKETCH.format(slim.schema["id"].dataType.simpleString()))


def pairs(sketched: DataFrame) -> DataFrame:
    """``id, text_hash, e_id, e_hash``: a document and an earlier one, for every run the later one does not own.

    A run belongs to the first document that has it (by id, null last, then by the hash of the text), so a run in n
    documents gives n - 1 pairs and a group of copies no more than its members, however large. Owners are minima,
    taken before the shuffle too.
    """
    key = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    held = sketched.select(key.alias("key"), F.explode("runs").alias("run"))
    owners = held.groupBy("run").agg(F.min("key").alias("owner"), F.max("key").alias("newest")).where("owner <> newest")
    met = held.join(owners.drop("newest"), "run").where("key <> owner").select("key", "owner").distinct()
    return met.select("key.id", "key.text_hash", F.col("owner.id").alias("e_id"), F.col("owner.text_hash").alias("e_hash"))


def _without(lines: Column, removed: Column) -> Column:
    """Elements whose place is not in ``removed``; places are sorted together, so long lists stay near linear."""
    pair = lambda i, tag: F.struct(i.cast("int").alias("i"), F.lit(tag).alias("tag"))
    all_places = F.transform(lines, lambda _, i: pair(i, 1))
    mixed = F.sort_array(F.concat(F.transform(removed, lambda i: pair(i, 0)), all_places))

    def left(s: Column, x: Column) -> Column:
        stays = F.filter(s, lambda e, j: (e["tag"] == 1) & ~F.coalesce(F.get(s, j - 1)["i"] == e["i"], F.lit(False)))
        return F.transform(stays, lambda e: x[e["i"]])

    return F.element_at(F.transform(F.array(F.struct(mixed.alias("s"), lines.alias("x"))), lambda m: left(m["s"], m["x"])), 1)


def _deduped(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """``row`` (the columns of ``docs`` as they were), ``text`` and what was removed from it."""
    sketched = materialise(sketches(docs, min_words, id_col, text_col), "sketches")
    id_kind = sketched.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("lines", "counts", "e_lines", "e_counts")]
            gone = [deleted_lines(*row, min_words) for row in zip(*columns, strict=True)]
            words = [[c[i] for i in g] for g, c in zip(gone, columns[1], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), batch.column("e_id"),
                 pa.array(gone, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.int32()))],
                names=["id", "text_hash", "e_id", "gone", "words"])

    found, owner = pairs(sketched), sketched.select(
        F.col("id").alias("o_id"), F.col("text_hash").alias("o_hash"), F.col("lines").alias("e_lines"), F.col("counts").alias("e_counts")
    ).dropDuplicates(["o_id", "o_hash"])
    own = sketched.select(F.col("id").alias("s_id"), F.col("text_hash").alias("s_hash"), "lines", "counts").dropDuplicates(["s_id", "s_hash"])
    of_own = F.col("id").eqNullSafe(F.col("s_id")) & (F.col("text_hash") == F.col("s_hash"))
    of_owner = F.col("e_id").eqNullSafe(F.col("o_id")) & (F.col("e_hash") == F.col("o_hash"))
    both = found.join(own, of_own).join(owner, of_owner)
    aligned = both.select("id", "text_hash", "e_id", "lines", "counts", "e_lines", "e_counts").mapInArrow(
        run, f"id {id_kind}, text_hash long, e_id {id_kind}, gone array<int>, words array<int>"
    )
    line = F.explode(F.arrays_zip("gone", "words")).alias("g")
    by_line = aligned.select("id", "text_hash", "e_id", line).groupBy("id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("g.gone", "g.words"))).alias("g"), F.sort_array(F.collect_set("e_id")).alias("earlier_ids")
    )
    removed = by_line.select(
        F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("g.gone").alias("removed_lines"),
        F.aggregate("g.words", F.lit(0).cast("long"), lambda a, x: a + x).alias("removed_words"), "earlier_ids",
    )
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    this = row["id"].eqNullSafe(removed["_id"]) & (F.xxhash64(row["text"]) == removed["_hash"])
    text = F.when(F.col("removed_lines").isNull(), F.col("text")).otherwise(
        F.array_join(_without(F.split("text", "\n", -1), F.col("removed_lines")), "\n")
    )
    return row.join(removed, this, "left").select("row", text.alias("text"), "removed_lines", "removed_words", "earlier_ids")


def _columns(docs: DataFrame, text_col: str) -> list[Column]:
    return [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text less the blocks an earlier document has, and ``removed_lines, removed_words, earlier_ids``.

    A block is a stretch of lines, equal and in a row in both documents but for lines without words, that holds
    ``min_words`` words or more; shorter agreement (a licence line, a heading) stays. Documents meet through runs, the
    fewest lines in a row with that many words, from a line on or up to it: rare enough to mean something, and every
    line of a block is in one. Each document is aligned with the first owner of each of its runs, so all lines of every
    block that any earlier document has are deleted, and each stays in some earlier document. Lines are compared whole
    and by their words; those without words are never deleted.

    Rows that agree in id and text are one document and get the same result; rows that share an id only are ordered by
    the hash of the text. Null ids come last. Null texts stay null, and an empty table gives no rows. Places in
    ``removed_lines`` count from 0 in the text split at newlines; all three are null where nothing is removed. Columns
    of ``docs`` with these names are replaced. Texts are read twice and shuffled once; what is aligned are hashes.
    """
    new = ["removed_lines", "removed_words", "earlier_ids"]
    kept = docs.select(*[docs[c] for c in docs.columns if c not in new])
    return _deduped(kept, min_words, id_col, text_col).select(*_columns(kept, text_col), *new)


def without_repeats(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with repeated blocks taken out of the text; rows that lose all their words go."""
    has_words = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    done = _deduped(docs, min_words, id_col, text_col).where(F.col("removed_lines").isNull() | has_words)
    return done.select(*_columns(docs, text_col))
