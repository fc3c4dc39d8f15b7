"""Near-duplicate documents by SimHash fingerprints and an index of their bytes by position."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.llm.components import connected
from logsieve.llm.words import byte_words
from logsieve.session import materialise

SEED = 42
_BYTES = 8
_STRIDE = 65_536
#: Parts over which the rows of one fingerprint are dealt where they meet the name of their component.
_SLOTS = 256


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Bit i is set if more than half of the shingles' XXH64 have it; no words give zero. Signed, as Spark's long."""
    words = byte_words(text)
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n < shingle:
        return int(np.uint64(xxhash.xxh64_intdigest(joined, SEED)).astype(np.int64))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - shingle + 1]
    digest, bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _STRIDE):  # a very long text needs no more memory than this many shingles
        part = zip(starts[at : at + _STRIDE].tolist(), ends[at + shingle - 1 : at + shingle - 1 + _STRIDE].tolist(), strict=False)
        h = np.array([digest(joined[a:b], SEED) for a, b in part], "<u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > n - shingle + 1, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_hash, fp`` of every row; the hash tells rows apart that share an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], names=["id", "text_hash", "fp"])

    text = docs[text_col]
    slim = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, text_hash long, fp long")


def posting_masks() -> list[int]:
    """Byte triples of which every four bytes hold one at least.

    Bytes go to three classes in turn; taken are the triples inside a class and those with two bytes of a class and
    one of the next. Of any four bytes some three are such.
    """
    of = lambda i: i % 3
    taken = []
    for t in combinations(range(_BYTES), 3):
        classes = sorted(map(of, t))
        for c in range(3):
            if classes == [c] * 3 or classes == sorted([c, c, (c + 1) % 3]):
                taken.append(t)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(0xFF << 8 * b for b in t)) for t in taken]


def _ball(radius: int) -> list[int]:
    """All words of 64 bits with at most ``radius`` bits set, signed."""
    words = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(64), r)]
    return [w - (1 << 64) if w >> 63 else w for w in words]


def links(nodes: DataFrame, most_bucket: int = 4096) -> DataFrame:
    """Edges ``u, v`` between ``node`` values that connect all whose fingerprints (``fp``, distinct) differ in 4 bits or fewer.

    Four differing bits touch at most four of the eight bytes, so linked fingerprints share four bytes at their
    positions and with them one of the posting lists. In a list, pairs with four shared bytes are verified; a pair in
    several lists is only taken from the first. A list of more than ``most_bucket`` fingerprints would compare too
    many: its members are spread over all words within two bits instead, and those that meet at a word are tied to
    the least of them. Two are within four bits if and only if they meet, so no connection is lost, and a member
    gives a fixed number of rows.
    """
    masks = posting_masks()
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])
    entries = nodes.select("fp", "node", F.posexplode(keys).alias("no", "key"))
    shared = entries.groupBy("no", "key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = materialise(entries.join(shared, ["no", "key"]), "postings")

    few = crowded.where(F.col("n") <= most_bucket)
    x: Column = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    byte_shared = [(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(0xFF)) == 0).cast("int") for i in range(_BYTES)]
    tally = reduce(lambda p, q: p + q, byte_shared)
    first = F.when(x.bitwiseAND(F.lit(masks[0])) == 0, 0)
    for i, m in enumerate(masks[1:], 1):
        first = first.when(x.bitwiseAND(F.lit(m)) == 0, i)
    paired = few.alias("a").join(
        few.alias("b"),
        (F.col("a.no") == F.col("b.no")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
        & (tally >= 4) & (F.bit_count(x) <= 4) & (first == F.col("a.no")),
    ).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))

    many = crowded.where(F.col("n") > most_bucket).select("fp", "node").distinct()
    ball = F.explode(F.transform(F.array(*map(F.lit, _ball(2))), lambda w: w.bitwiseXOR(F.col("fp"))))
    met = many.select("node", ball.alias("at")).groupBy("at").agg(F.collect_set("node").alias("met")).where(F.size("met") > 1)
    tied = met.select(F.explode("met").alias("u"), F.array_min("met").alias("v")).where("u <> v").distinct()
    return paired.union(tied)


def near_duplicates(
    docs: DataFrame, shingle: int = 4, most_bucket: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, fingerprint, component_id, text_hash, root`` of every row; the component is named by the least id it reaches.

    Where different texts share an id two components may have one ``component_id``; ``root``, a fingerprint, is unique.

    Rows with one fingerprint are a class and enter the search once, so a third of all rows may be copies; they are
    dealt over a fixed number of slots, each of which gets the class's name, so no task has them all. Texts
    without words (null and empty ones too) have fingerprint zero and link like others. Repeated rows give a row
    each. A null id belongs to its component but never names one that has another id. Further columns are not
    read, an empty table gives no rows.
    """
    slot = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(_SLOTS)).cast("short").alias("slot")
    rows = materialise(fingerprints(docs, shingle, id_col, text_col).select("*", slot), "fingerprints")
    # the least node of a component bears its least id, so that no row of a component has to meet the others for its name
    node = F.struct(F.col("least").isNull().alias("unnamed"), "least", "fp").alias("node")
    classes = rows.groupBy("fp").agg(F.min("id").alias("least"), F.collect_set("slot").alias("slots")).select("fp", node, "slots")
    roots = connected(links(classes, most_bucket)).select(F.col("node.fp").alias("fp"), "root")
    named = classes.join(roots, "fp", "left").select("fp", F.explode("slots").alias("slot"), F.coalesce("root", "node").alias("root"))
    return rows.join(named, ["fp", "slot"]).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("root.least").alias("component_id"), "text_hash", F.col("root.fp").alias("root"),
    )


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component (``root``) of ``found``: the one with the least id.

    Of rows that share that id in a component, the one with the least text hash stays, once if it is repeated; those
    of other components stay beside it. Rows without an id cannot be told from each other and stay.
    """
    named = found.where(F.col(id_col).isNotNull()).groupBy("root", id_col, "text_hash").agg(F.count("*").alias("n"))
    picked = named.groupBy("root").agg(F.min(F.struct(id_col, "text_hash", "n")).alias("p"))
    picked = picked.select(F.col("p")[id_col].alias("_id"), F.col("p.text_hash").alias("_hash"), F.col("p.n").alias("_n"))

    def only(some: DataFrame) -> DataFrame:
        return docs.join(some, (docs[id_col] == some["_id"]) & (F.xxhash64(docs[text_col]) == some["_hash"]), "left_semi")

    once, often = only(picked.where("_n = 1")), only(picked.where("_n > 1")).dropDuplicates([id_col, text_col])
    return once.unionByName(often).unionByName(docs.where(docs[id_col].isNull()))
