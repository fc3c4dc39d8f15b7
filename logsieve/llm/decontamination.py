"""Benchmark passages in documents: random-walk embedding of windows, bit-sampling keys, exact edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from logsieve.llm.words import byte_words
from logsieve.session import materialise

#: Words that may be inserted, deleted or changed: a similarity of 0.8 or more.
MOST_EDITS = 0.2
#: Items of more words are cut into pieces of about this length, at most. Where a passage is within the bound of an item,
#: it is within the bound of one piece at least, as the edits of the pieces add up to those of the item.
PIECE = 24
#: Keys of a window, and sampled coordinates of its embedding in each key. Walks of longer windows fall further out of
#: step, which is why items are cut: the recall of these keys holds for pieces, and so for items of any length.
TABLES, SAMPLED = 28, 2
#: Items are sent to the tasks in blocks of so many words at most; each block is a pass over the documents.
BLOCK_WORDS = 2_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (x.astype(np.uint64) + np.uint64(salt + 1)) * _MIX
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def allowed(n: int) -> int:
    return int(MOST_EDITS * n + 1e-9)


def run_length(n: int) -> int:
    """Words in a row that an item of ``n`` words keeps unchanged at least: the kept words fall into edits + 1 runs."""
    return -(-(n - allowed(n)) // (allowed(n) + 1))


def embed(words: np.ndarray, table: int) -> np.ndarray:
    """CGK embedding of each row: 3n coordinates; a random bit of coordinate and word decides if the walk goes on."""
    rows, n = words.shape
    padded = np.concatenate([words, np.full((rows, 1), -2, words.dtype)], axis=1)
    at, out, each = np.zeros(rows, np.int64), np.empty((rows, 3 * n), words.dtype), np.arange(rows)
    for j in range(3 * n):
        symbol = padded[each, at]
        out[:, j] = symbol
        at = np.minimum(at + (_hash(symbol, table * 1_000_003 + j) >> np.uint64(63)).astype(np.int64), n)
    return out


def keys(words: np.ndarray) -> np.ndarray:
    """One key per table and row: its sampled coordinates. Rows of another length never share a key."""
    rows, n = words.shape
    out = np.empty((rows, TABLES), np.int64)
    for t in range(TABLES):
        # coordinates past 2n mostly repeat the end mark, which tells nothing
        taken = np.random.default_rng(t * 7919 + n).choice(max(1, 2 * n), SAMPLED)
        walked, h = embed(words, t), np.full(rows, t * 65_537 + n, np.uint64)
        for c in taken:
            with np.errstate(over="ignore"):
                h = _hash(h ^ _hash(walked[:, c], c), t)
        out[:, t] = h.view(np.int64)
    return out


def distance(window: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of ``item`` to a part of ``window``, and where that part starts and ends."""
    n = len(window)
    cost, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps = np.arange(n + 1)
    for i, word in enumerate(item, 1):
        change = cost[:-1] + (window != word)
        drop = cost[1:] + 1
        best = np.minimum(change, drop)
        begin = np.where(change <= drop, start[:-1], start[1:])
        cost, start = np.concatenate(([i], best)), np.concatenate(([0], begin))
        # insertions run along the row: the least of cost - position so far, plus the position
        slope = cost - steps
        least = np.minimum.accumulate(slope)
        origin = np.maximum.accumulate(np.where(slope == least, steps, 0))
        cost, start = least + steps, start[origin]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


def pieces(n: int) -> list[tuple[int, int]]:
    """From and to of the pieces of an item of ``n`` words, of nearly equal length."""
    count = -(-n // PIECE)
    cuts = [n * i // count for i in range(count + 1)]
    return list(zip(cuts, cuts[1:]))


class Items:
    """A block of benchmark items as word numbers, their pieces, and the runs that place windows."""

    def __init__(self, items: list[tuple[object, list[bytes]]]):
        vocabulary = sorted({w for _, ws in items for w in ws})
        number = {w: i for i, w in enumerate(vocabulary)}
        self.vocabulary = [w.decode("utf-8", "replace") for w in vocabulary]
        self.words = [np.array([number[w] for w in ws], np.int32) for _, ws in items]
        self.ids = [i for i, _ in items]
        self.counts = [np.unique(w, return_counts=True) for w in self.words]
        #: Item, place in it and length of every piece.
        self.pieces = np.array([(k, a, b - a) for k, w in enumerate(self.words) for a, b in pieces(len(w))], np.int64).reshape(-1, 3)
        self.keys = self.holders = np.zeros(0, np.int64)
        runs: dict[int, set[tuple[int, int, int]]] = {}
        for k, a, n in self.pieces.tolist():
            r = run_length(n)
            runs.setdefault(r, set()).update((c, q, n) for q, c in enumerate(self.codes(self.words[k][a : a + n], r).tolist()))
        self.seeds = {r: tuple(np.array(sorted(rows), np.int64).T) for r, rows in runs.items()}

    @staticmethod
    def codes(ids: np.ndarray, run: int) -> np.ndarray:
        """A number per ``run`` words in a row."""
        n = len(ids) - run + 1
        h = np.zeros(max(n, 0), np.uint64)
        for k in range(run if n > 0 else 0):
            h = _hash(h ^ _hash(ids[k : k + n], 3), k)
        return h.view(np.int64)

    def keyed(self, spark: SparkSession) -> Items:
        """Adds the keys of all pieces, worked out by tasks."""
        rows = pa.table({
            "piece": pa.array(range(len(self.pieces)), pa.int32()),
            "words": pa.array([self.words[k][a : a + n] for k, a, n in self.pieces.tolist()], _WINDOW),
        })

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lengths = pc.list_value_length(batch.column(1)).to_numpy()
                for n in np.unique(lengths):
                    at = np.flatnonzero(lengths == n)
                    words = np.array(batch.column(1).take(pa.array(at)).to_pylist(), np.int64)
                    flat = keys(words).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(flat), batch.column(0).take(pa.array(np.repeat(at, TABLES)))], names=["key", "piece"])

        found = spark.createDataFrame(rows).mapInArrow(run, "key long, piece int").distinct().orderBy("key", "piece").toArrow()
        self.keys, self.holders = found.column(0).to_numpy(), found.column(1).to_numpy().astype(np.int64)
        return self

    def places(self, ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Text, start and length of the windows that may hold a piece: where a run of one lies in place."""
        found = [np.zeros((3, 0), np.int64)]
        for r, (codes, offsets, sizes) in self.seeds.items():
            n = len(ids) - r + 1
            if n <= 0:
                continue
            ok = doc[:n] == doc[r - 1 :]
            for k in range(r):
                ok &= ids[k : k + n] >= 0
            at = np.flatnonzero(ok)
            h = np.zeros(len(at), np.uint64)
            for k in range(r):
                h = _hash(h ^ _hash(ids[at + k], 3), k)
            h = h.view(np.int64)
            low, high = np.searchsorted(codes, h, "left"), np.searchsorted(codes, h, "right")
            at, which = _spread(at, low, high)
            found.append(np.stack([doc[at], at - offsets[which], sizes[which]]))
        return np.unique(np.concatenate(found, axis=1), axis=1)


def _spread(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row with every number from its ``low`` to its ``high``."""
    hits = high - low
    which = np.repeat(low - np.cumsum(hits) + hits, hits) + np.arange(hits.sum())
    return np.repeat(rows, hits), which


_WINDOW = pa.list_(pa.int32())


def _numbered(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts in a row (-1: in no item), and the text each word stands in."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat = pc.list_flatten(words)
    doc = pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    ids = pc.index_in(flat, vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
    return ids[full], doc[full]


def met(ids: np.ndarray, doc: np.ndarray, items: Items) -> np.ndarray:
    """Text, item and place where its first word would stand, of every window that shares a key with a piece of its length."""
    text, start, length = items.places(ids, doc)
    found = [np.zeros((3, 0), np.int64)]
    for n in np.unique(length):
        mine = np.flatnonzero(length == n)
        for part in range(0, len(mine), 4096):
            rows = mine[part : part + 4096]
            grid = start[rows, None] + np.arange(n)
            cut = np.clip(grid, 0, len(ids) - 1)
            # a window at the edge of a text keeps its size; what lies outside is no word of the item
            here = (grid == cut) & (doc[cut] == text[rows, None])
            k = keys(np.where(here, ids[cut], -1).astype(np.int64)).ravel()
            row, which = _spread(np.repeat(rows, TABLES), np.searchsorted(items.keys, k, "left"), np.searchsorted(items.keys, k, "right"))
            piece = items.pieces[items.holders[which]]
            found.append(np.stack([text[row], piece[:, 0], start[row] - piece[:, 1]])[:, piece[:, 2] == n])
    return np.unique(np.concatenate(found, axis=1), axis=1)


def verified(ids: np.ndarray, doc: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, int]]:
    """``text, item, distance, start in it`` of the passages within the bound, by exact edit distance.

    Places of an item within its slack of the first are one stretch, for the closest part of a stretch is looked for
    anyway. A part within the bound has all words of the item but for the edits; a stretch with fewer holds none.
    """
    stretches: list[list[int]] = []
    for text, k, start in met(ids, doc, items).T.tolist():
        if stretches and stretches[-1][:2] == [text, k] and start - stretches[-1][2] <= allowed(len(items.words[k])):
            stretches[-1][3] = start
        else:
            stretches.append([text, k, start, start])
    for text, k, start, last in stretches:
        item = items.words[k]
        n, first = len(item), int(np.searchsorted(doc, text, "left"))
        low, high = max(start - allowed(n), first), min(last + n + allowed(n), int(np.searchsorted(doc, text, "right")))
        values, counts = items.counts[k]
        have, times = np.unique(ids[low:high], return_counts=True)
        _, mine, theirs = np.intersect1d(values, have, assume_unique=True, return_indices=True)
        if np.minimum(counts[mine], times[theirs]).sum() < n - allowed(n):
            continue
        d, begin, _ = distance(ids[low:high], item)
        if d <= allowed(n):
            yield text, k, d, low - first + begin


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items with words, in blocks of about ``BLOCK_WORDS`` words; the driver holds one at a time."""
    block, size = [], 0
    for row in items.select(items[id_col], items[text_col]).where(items[text_col].isNotNull()).distinct().toLocalIterator():
        words = byte_words(row[1])
        if words:
            block.append((row[0], words))
            size += len(words)
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _found(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str) -> DataFrame:
    """``id, text_hash, item, distance, n_words, start`` of every passage within the bound."""
    spark = docs.sparkSession
    text = docs[text_col]
    slim = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    item_type = items.schema[item_col].dataType
    schema = T.StructType([slim.schema["id"], slim.schema["text_hash"], T.StructField("item", item_type), T.StructField("distance", T.IntegerType()),
                           T.StructField("n_words", T.IntegerType()), T.StructField("start", T.LongType())])

    def look(held: Items) -> DataFrame:
        sent = spark.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = sent.value
            vocabulary = pa.array(held.vocabulary, pa.string())
            for batch in batches:
                for part in _parts(batch):
                    rows = list(verified(*_numbered(part.column(2), vocabulary), held))
                    if rows:
                        at, k, d, start = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), pa.array([held.ids[i] for i in k], to_arrow_type(item_type)),
                             pa.array(d, pa.int32()), pa.array([len(held.words[i]) for i in k], pa.int32()), pa.array(start, pa.int64())], names=schema.names)

        made = materialise(slim.mapInArrow(run, schema), "passages")
        sent.unpersist()
        return made

    found = [look(Items(block).keyed(spark)) for block in _blocks(items, item_col, "text")]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``id_col, item_col, distance, n_words, start`` of every item found in a document, with its closest place.

    An item is found where the words of some part of the document (A-Z lower-cased) are within ``MOST_EDITS`` of it in
    edit distance over words. Items are looked for by their pieces (``PIECE``). A part within the bound of a piece keeps a run of
    ``run_length`` words of it in place, so windows of the piece's size are laid where one does. A window is embedded by
    random walks; keys made of sampled coordinates of the embedding are looked up among those of the pieces of its size,
    and every meeting is verified against the whole item. The recall is that of ``TABLES`` keys; unchanged passages always meet.

    Items without words and null items are never found; null and empty texts hold nothing. Documents that share an id
    give one row per item together; a null id gives rows with a null id; repeated items count as one row per item id;
    other columns are not read; empty tables give no rows. The benchmark is the query set: it goes to the tasks in
    blocks of bounded size, whatever its own; every block meets all documents where they are read, one after the other.
    """
    best = _found(docs, items, id_col, text_col, item_col).groupBy("id", "item").agg(F.min(F.struct("distance", "n_words", "start")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "b.*")


def _parts(batch: pa.RecordBatch, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``most`` bytes of text; a single text is never cut."""
    lengths = pc.binary_length(batch.column(2)).fill_null(0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(lengths), 0
    while start < len(lengths):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most)))
        yield batch.slice(start, stop - start)
        start = stop


def without_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """The rows of ``docs`` that hold no item. Rows are told by id and text, so others that share an id, or have none, stay."""
    hit = _found(docs, items, id_col, text_col, item_col).select(F.col("id").alias("_hit"), F.col("text_hash").alias("_hash")).distinct()
    same = docs[id_col].eqNullSafe(hit["_hit"]) & (F.xxhash64(docs[text_col]) == hit["_hash"])
    return docs.join(hit, same, "left_anti")
