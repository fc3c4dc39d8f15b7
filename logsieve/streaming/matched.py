"""Rows of one stream with the latest row about them in another, in a state of few large pieces.

A join of two streams keeps, counts and looks up every row for itself in the state store. Here keys are dealt into a fixed
number of buckets. The rows that a micro-batch brings for a bucket are kept as a few compressed tables; they are merged,
column by column and not row by row, once there are more of them than merged ones or a row is over. Merging leaves of the
rows of the other stream only those that may still be the latest for a row that waits or one that may come.
"""

from __future__ import annotations

import json
import pickle
from base64 import b64decode
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from logsieve.streaming.ordered import _JSON, _packed, _unpacked

#: Rows and bytes of a piece, rows that are merged at once, rows of a frame to Spark.
_PIECE, _PIECE_BYTES, _MERGED, _SHOWN = 1 << 16, 1 << 24, 1 << 19, 1 << 14
_WAITING = pa.schema({"key": pa.string(), "low": pa.int64(), "high": pa.int64(), "what": pa.string()})
_SEEN = pa.schema({"key": pa.string(), "at": pa.int64(), "what": pa.string(), "raw": pa.string()})
_TOLD = ["_what", "_seen", "_raw"]
_NEVER = 1 << 62


def _rank(kind: T.DataType) -> Callable:
    """Values of ``kind`` as ``to_json`` writes them to what Python orders as Spark does: null first, not-a-number last."""
    if isinstance(kind, T.StructType):
        parts = [(f.name, _rank(f.dataType)) for f in kind.fields]
        def known(v): return tuple(rank(v.get(name)) for name, rank in parts)
    elif isinstance(kind, T.ArrayType):
        one = _rank(kind.elementType)
        def known(v): return [one(x) for x in v]
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        def known(v): return (1, 0.0) if (x := float(v)) != x else (0, x)
    elif isinstance(kind, T.BinaryType):
        known = b64decode
    else:
        def known(v): return v
    return lambda v: () if v is None else (known(v),)


class _Latest:
    """What is done with the rows of a bucket, to be called with its key, new rows and state.

    The state is a list of pieces: whether they hold rows that wait, whether they are merged, how many rows, and the rows.
    ``early`` is the longest time by which a row of the other stream may come before the row it is about, and ``late`` the
    least time by which one may come after any; both in microseconds. A row waits for the longer of both.
    """

    def __init__(self, version: T.DataType, early: int, late: int):
        self.version, self.early, self.late, self.longer = version, early, late, max(0, early - late)

    def __call__(self, key, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        self.rank = _rank(self.version)
        pieces, least = pickle.loads(state.get[0]) if state.exists else ([], _NEVER)
        mark = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            least = min(least, self._taken(rows, pieces))
        merged = sum(p[2] for p in pieces if p[1])
        if least < mark or mark > 0 and sum(p[2] for p in pieces) - merged > max(_PIECE, merged):
            pieces, old = [], pieces
            least = yield from self._merged(old, pieces, mark)
        if pieces:
            state.update((pickle.dumps((pieces, least), 5),))
            if least < _NEVER:
                state.setTimeoutTimestamp(least // 1000)  # over once the watermark is later
        elif state.exists:
            state.remove()

    # ---- pieces ---------------------------------------------------------------------------------

    def _keep(self, pieces: list[tuple], table: pa.Table, mine: bool, merged: bool) -> None:
        size = max(1, min(_PIECE, table.num_rows * _PIECE_BYTES // max(1, table.nbytes)))
        for start in range(0, table.num_rows, size):
            piece = table.slice(start, size).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(piece)
            pieces.append((mine, merged, piece.num_rows, sink.getvalue().to_pybytes()))

    def _read(self, piece: tuple, turn: int, turns: int) -> pa.Table:
        """Of the rows of a piece those whose turn it is, by their key."""
        table = pa.ipc.open_stream(piece[3]).read_all()
        if turns == 1:
            return table
        names = table["key"].fill_null("").to_numpy().astype(object)
        return table.filter(pa.array(pd.util.hash_array(names) // np.uint64(7) % np.uint64(turns) == turn))

    def _over(self, waiting: pa.Table) -> int:
        return pc.min(waiting["high"]).as_py() + self.longer if waiting.num_rows else _NEVER

    def _taken(self, rows: Iterator[pd.DataFrame], pieces: list[tuple]) -> int:
        """Keeps new rows as pieces and gives the time at which the first of them is over."""
        fresh, count, size, least = [], 0, 0, _NEVER

        def keep() -> int:
            table = pa.concat_tables(fresh)
            mine = table["mine"]
            waiting = table.filter(mine).select(_WAITING.names)
            seen = table.filter(pc.invert(mine)).select(["key", "low", "what", "raw"]).rename_columns(_SEEN.names)
            self._keep(pieces, waiting, True, False)
            self._keep(pieces, seen, False, False)
            return self._over(waiting)

        for frame in rows:
            texts = {c: pa.array(frame[c], pa.string(), from_pandas=True) for c in ("key", "what", "raw")}
            numbers = {c: pa.array(frame[c].to_numpy("int64")) for c in ("low", "high")}
            fresh.append(pa.table(texts | numbers | {"mine": pa.array(frame["mine"].to_numpy("bool"))}))
            count, size = count + len(frame), size + fresh[-1].nbytes
            if count >= _PIECE or size >= _PIECE_BYTES:
                least = min(least, keep())
                fresh, count, size = [], 0, 0
        return min(least, keep()) if fresh else least

    # ---- merging --------------------------------------------------------------------------------

    def _merged(self, pieces: list[tuple], kept: list[tuple], mark: int) -> Iterator[pd.DataFrame]:
        """Merges pieces into ``kept``, ``_MERGED`` rows at once, and tells the rows that are over; the time of the next one."""
        turns, least = max(1, -(-sum(p[2] for p in pieces) // _MERGED)), _NEVER
        theirs = [p for p in pieces if not p[0]]
        for turn in range(turns):
            waiting = pa.concat_tables([_WAITING.empty_table(), *(self._read(p, turn, turns) for p in pieces if p[0])])
            if waiting.num_rows:  # ``what`` is all of a row
                waiting = waiting.take(np.unique(waiting["what"].combine_chunks().dictionary_encode().indices.to_numpy(), return_index=True)[1])
            over = waiting["high"].to_numpy() + self.longer < mark
            seen, fresh = _SEEN.empty_table(), []
            for i, piece in enumerate(theirs, 1):
                fresh.append(self._read(piece, turn, turns))
                if i < len(theirs) and sum(t.num_rows for t in fresh) >= 2 * _PIECE:
                    seen, code, at, best = self._placed(waiting, pa.concat_tables([seen, *fresh]))
                    seen, fresh = seen.filter(self._useful(code, at, best, mark)), []
            seen, code, at, best = self._placed(waiting, pa.concat_tables([seen, *fresh]))
            if over.any():
                yield from self._told(waiting.filter(pa.array(over)), seen, best[over])
                waiting, best = waiting.filter(pa.array(~over)), best[~over]
            self._keep(kept, waiting, True, True)
            self._keep(kept, seen.filter(self._useful(code, at, best, mark)), False, True)
            least = min(least, self._over(waiting))
        return least

    def _placed(self, waiting: pa.Table, seen: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        """``seen`` by key and time, one row of each; numbers of its keys, its times, and the row for each that waits or -1."""
        n = waiting.num_rows
        keys = pa.chunked_array([*waiting["key"].chunks, *seen["key"].chunks], pa.string()).combine_chunks()
        codes = keys.dictionary_encode().indices.fill_null(-1).to_numpy()
        mine, code, at = codes[:n], codes[n:], seen["at"].to_numpy()
        order = np.lexsort((at, code))
        code, at = code[order], at[order]
        begins = np.ones(len(at), bool)
        begins[1:] = (code[1:] != code[:-1]) | (at[1:] != at[:-1])
        if not begins.all():
            chosen = np.flatnonzero(begins)
            size = np.diff(np.append(chosen, len(at)))
            several = np.flatnonzero(size > 1)
            rows = np.concatenate([order[chosen[g] : chosen[g] + size[g]] for g in several])
            said = list(zip(seen["what"].take(rows).to_pylist(), seen["raw"].take(rows).to_pylist(), strict=True))
            i = 0
            for g in several:
                some = said[i : i + size[g]]
                i += size[g]
                if any(x != some[0] for x in some[1:]):
                    chosen[g] += max(range(len(some)), key=lambda j: self._version(*some[j]))
            order, code, at = order[chosen], code[chosen], at[chosen]
        # the last row not after the end of each that waits: both in one order, the highest number so far
        high = waiting["high"].to_numpy()
        own = np.concatenate([np.zeros(len(at), bool), np.ones(n, bool)])
        both = np.lexsort((own, np.concatenate([at, high]), np.concatenate([code, mine])))
        last = np.maximum.accumulate(np.where(own[both], -1, both)) if len(both) else both
        best = np.full(n, -1)
        best[both[own[both]] - len(at)] = last[own[both]]
        if len(at):
            right = (best >= 0) & (code[best] == mine) & (at[best] >= waiting["low"].to_numpy())
            best = np.where(right, best, -1)
        return seen.take(order), code, at, best

    def _version(self, what: str, raw: str | None) -> tuple:
        return self.rank(json.loads(what, parse_float=Decimal).get("version")), () if raw is None else (raw,)

    def _useful(self, code: np.ndarray, at: np.ndarray, best: np.ndarray, mark: int) -> pa.Array:
        """Which placed rows are the latest for one that waits, or may be for one that comes after the watermark ``mark``."""
        ahead = at > mark + self.late
        last = ~ahead
        last[:-1] &= (code[1:] != code[:-1]) | ahead[1:]
        useful = (ahead | last) & (at > mark - self.early)
        useful[best[best >= 0]] = True
        return pa.array(useful)

    def _told(self, over: pa.Table, seen: pa.Table, best: np.ndarray) -> Iterator[pd.DataFrame]:
        place = pa.array(best, mask=best < 0)
        told = pa.table([over["what"], pc.cast(seen["at"].take(place), pa.string()), seen["raw"].take(place)], names=_TOLD)
        for start in range(0, told.num_rows, _SHOWN):
            yield told.slice(start, _SHOWN).to_pandas()


def _span(rows: DataFrame, text: str) -> tuple[int, int]:
    """Least and most microseconds of an interval; months and years differ in theirs."""
    days = rows.sparkSession.range(0, 1500).select(F.timestamp_seconds(F.col("id") * 86400).alias("t"))
    took = F.unix_micros(F.col("t") + F.expr(f"INTERVAL {text}")) - F.unix_micros("t")
    least, most = days.agg(F.min(took), F.max(took)).first()
    slack = 2 * 86_400_000_000 if least != most else 0
    return least - slack, most + slack


def latest_within(
    rows: DataFrame, others: DataFrame, keys: list[str], at: str, seen_at: str, version: str, raw: str,
    before: str, after: str, watermark: str, buckets: int = 1024,
) -> DataFrame:
    """Each distinct one of ``rows`` once, with ``_seen``: the latest of ``others`` with its ``keys``, or null.

    The latest is that of the last ``seen_at`` from ``before`` the time ``at`` of the row to ``after`` it, of one time that of
    the last ``version``, then ``raw``, a text. A row is told once the watermark has passed its time and the longer of
    ``after`` and ``before``. Rows without a time are not told and those with a null key are told as not seen. ``buckets``
    bounds the tasks that share the work and has to stay the same for a checkpoint; what waits in a bucket is in the memory
    of a task, compressed.
    """
    kinds, theirs = {f.name: f.dataType for f in rows.schema}, {f.name: f.dataType for f in others.schema}
    key = F.concat_ws("", *[F.concat(F.length(F.col(k).cast("string")), F.lit(":"), F.col(k).cast("string")) for k in keys])

    def bucket(seed: Column) -> Column:
        return F.pmod(F.xxhash64(seed), F.lit(buckets)).cast("int").alias("bucket")

    def number(time: Column) -> Column:
        return F.unix_micros(time.cast("timestamp"))

    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    texts = [_packed(c, kinds[c]).alias(f"c{i}") for i, c in enumerate(rows.columns)]
    mine = rows.where(F.col(at).isNotNull()).select(
        F.col(at).cast("timestamp").alias("at"), F.lit(True).alias("mine"), F.when(known, key).alias("key"),
        number(F.col(at) - F.expr(f"INTERVAL {before}")).alias("low"), number(F.col(at) + F.expr(f"INTERVAL {after}")).alias("high"),
        F.to_json(F.struct(*texts)).alias("what"), F.lit(None).cast("string").alias("raw"))
    seen = others.where(known & F.col(seen_at).isNotNull()).select(
        F.col(seen_at).cast("timestamp").alias("at"), F.lit(False).alias("mine"), key.alias("key"),
        number(F.col(seen_at)).alias("low"), number(F.col(seen_at)).alias("high"),
        F.to_json(F.struct(F.col(version).alias("version")), _JSON).alias("what"), F.col(raw).cast("string").alias("raw"))
    both = mine.withWatermark("at", watermark).unionAll(seen.withWatermark("at", watermark))
    dealt = both.select(bucket(F.coalesce("key", "what")), "*")
    processor = _Latest(theirs[version], _span(rows, before)[1], _span(rows, after)[0])
    told = dealt.groupBy("bucket").applyInPandasWithState(
        lambda *given: processor(*given), ", ".join(f"{c} string" for c in _TOLD), "pieces binary", "append", GroupStateTimeout.EventTimeTimeout)
    packed = T.StructType([T.StructField(f"c{i}", T.BinaryType() if isinstance(kinds[c], T.BinaryType) else T.StringType())
                           for i, c in enumerate(rows.columns)])
    parted = told.select(F.from_json("_what", packed).alias("_what"), "_seen", "_raw").select("_what.*", "_seen", "_raw")
    when = F.timestamp_micros(F.col("_seen").cast("long")).cast(theirs[seen_at])
    latest = F.when(F.col("_seen").isNotNull(), F.struct(when.alias(seen_at), F.col("_raw").alias(raw)))
    return parted.select(*[_unpacked(f"c{i}", kinds[c]).alias(c) for i, c in enumerate(rows.columns)], latest.alias("_seen"))
