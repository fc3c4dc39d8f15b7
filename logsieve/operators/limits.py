"""Fixed-window request limits whose windows open at a request.

The first request of a client opens a window of ``seconds``; the first one at or after its end opens the next. Where
windows lie thus depends on every request before, yet no client may be walked through by one task when it sends a third
of all requests. So requests are dealt by ranges of client and time, which cut a busy client into as many parts as it
needs, and walked part by part:

* A part's clients are walked from their first request on, but for the client the part opens with: its requests may
  belong to a window of the part before. For them the part tells what any window in force at its start would lead to,
  as a table from the end of that window to the window in force after the part.
* Parts filled by one client are joined by doubling: the table of a part after that of the part before it, then two
  before it, then four. What is in force at the start of every part is then known, and its first client is walked too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsieve.session import discard, materialise
from logsieve.settings import RateLimit

_MICROS = 1_000_000
_NEVER = -(1 << 62)
_PART = [T.StructField(n, t) for n, t in (
    ("_start", T.LongType()), ("_count", T.LongType()), ("_part", T.IntegerType()), ("_whole", T.BooleanType()), ("_rows", T.LongType()),
    ("_at", T.ArrayType(T.LongType())), ("_ends", T.ArrayType(T.LongType())), ("_counts", T.ArrayType(T.LongType())),
    ("_last_key", T.StringType()), ("_last_end", T.LongType()), ("_last_count", T.LongType()),
)]


def epoch_micros(ts: str) -> Column:
    return F.timestamp_diff(
        "MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz")
    )


def _walk(times: np.ndarray, end: int, count: int, span: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Window start and place of each of a client's requests, given the window in force; and the one in force after."""
    starts, places = np.empty(len(times), np.int64), np.empty(len(times), np.int64)
    i = 0
    while i < len(times):
        if times[i] >= end:
            end, count = int(times[i]) + span, 0
        j = i + int(np.searchsorted(times[i:], end))
        starts[i:j] = end - span
        places[i:j] = np.arange(count + 1, count + 1 + j - i)
        i, count = j, count + j - i
    return starts, places, end, count


def _table(times: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``at, ends, counts``: the window in force after ``times`` if the one in force before ends at or before ``at``.

    An end in between counts as the next ``at``; one past the last leaves that window in force, with all these requests.
    Only requests that such a window can end at are listed.
    """
    n = len(times)
    follows = np.searchsorted(times, times + span)
    last = np.where(follows == n, np.arange(n), np.minimum(follows, n - 1))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    ends, counts = times[last] + span, n - last
    kept = min(n, int(np.searchsorted(times, times[0] + span)) + 1)
    times, ends, counts = times[:kept], ends[:kept], counts[:kept]
    told = np.append((ends[1:] != ends[:-1]) | (counts[1:] != counts[:-1]), True)
    return times[told], ends[told], counts[told]


def _runs(keys: pa.Array) -> list[tuple[int, int]]:
    """From and to of equal neighbours."""
    if not len(keys):
        return []
    codes = keys.dictionary_encode().indices.to_numpy()
    cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
    return list(zip(cuts, cuts[1:]))


def _walked_parts(keyed: DataFrame, order: str, span: int) -> DataFrame:
    """Requests by ranges with ``_start`` and ``_count``, null for the first client of a part; and a row that sums up each part."""
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in keyed.schema], *_PART])
    width, key_at, time_at = len(keyed.columns), keyed.columns.index("_key"), keyed.columns.index("_t")
    ranged = keyed.repartitionByRange("_key", "_t", order).sortWithinPartitions("_key", "_t", order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, held, now, end, count, target = TaskContext.get().partitionId(), None, [], None, _NEVER, 0, None
        for batch in batches:
            keys, times = batch.column(key_at), batch.column(time_at).to_numpy()
            starts, places = np.zeros(len(times), np.int64), np.zeros(len(times), np.int64)
            known = np.zeros(len(times), bool)
            for a, b in _runs(keys):
                key = keys[a].as_py()
                first = key if first is None else first
                if key == first:
                    held.append(times[a:b])
                    continue
                if key != now:
                    now, end, count = key, _NEVER, 0
                starts[a:b], places[a:b], end, count = _walk(times[a:b], end, count, span)
                known[a:b] = True
            added = [pa.array(starts, mask=~known), pa.array(places, mask=~known), pa.array(np.full(len(times), part), pa.int32())]
            target = pa.schema([*batch.schema, *_arrow_part()])
            rest = [pa.nulls(len(times), f.type) for f in list(target)[width + 3 :]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added, *rest], schema=target)
        if first is not None:
            at, ends, counts = _table(np.concatenate(held), span)
            told = {"_key": first, "_part": part, "_whole": now is None, "_rows": sum(map(len, held)), "_at": at.tolist(), "_ends": ends.tolist(),
                    "_counts": counts.tolist(), "_last_key": now, "_last_end": end, "_last_count": count}
            yield pa.RecordBatch.from_arrays([pa.array([told.get(f.name)], f.type) for f in target], schema=target)

    return ranged.mapInArrow(run, schema)


def _arrow_part() -> list[pa.Field]:
    longs = pa.list_(pa.int64())
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), longs, longs, longs, pa.string(), pa.int64(), pa.int64()]
    return [pa.field(f.name, k) for f, k in zip(_PART, kinds, strict=True)]


def _through(ends: np.ndarray, counts: np.ndarray, at, to, told, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows in force after a part with that table, from those in force before it."""
    at, to, told = (np.asarray(v, np.int64) for v in (at, to, told))
    i = np.searchsorted(at, ends)
    stays = i == len(at)
    i = np.minimum(i, len(at) - 1)
    return np.where(stays, ends, to[i]), np.where(stays, counts + rows, told[i])


_STEP = "_part int, _at array<long>, _ends array<long>, _counts array<long>, _rows long"


def _doubled(parts: DataFrame, reach: int) -> DataFrame:
    """Each part's table after that of ``reach`` parts before it, where that is in its run; ``parts`` are whole."""
    right = parts.alias("r")
    left = parts.select(F.col("_run").alias("lr"), (F.col("_part") + reach).alias("lp"), F.col("_at").alias("la"), F.col("_ends").alias("le"),
                        F.col("_counts").alias("lc"), F.col("_rows").alias("ln"))
    both = right.join(left, (F.col("_run") == F.col("lr")) & (F.col("_part") == F.col("lp")), "left").select(
        "_run", "_part", "_at", "_ends", "_counts", "_rows", "la", "le", "lc", "ln")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for no, part, at, ends, counts, n, la, le, lc, ln in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if la is not None:
                    e, c = _through(np.array(le, np.int64), np.array(lc, np.int64), at, ends, counts, n)
                    at, ends, counts, n = la, e.tolist(), c.tolist(), n + ln
                rows.append((no, part, at, ends, counts, n))
            if rows:
                longs = pa.list_(pa.int64())
                kinds = [pa.int32(), pa.int32(), longs, longs, longs, pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 names=["_run", "_part", "_at", "_ends", "_counts", "_rows"])

    return both.mapInArrow(run, f"_run int, {_STEP}")


def _entries(parts: DataFrame) -> DataFrame:
    """``_part, _end, _before``: the window in force at the start of every part for its first client, and its requests so far.

    The driver sees a narrow row per part, the tables stay where they are.
    """
    spark = parts.sparkSession
    seen = parts.select("_part", F.xxhash64("_key").alias("k"), F.xxhash64("_last_key").alias("z"), "_whole", "_last_end", "_last_count").orderBy("_part").collect()
    entered, runs, members, tail = [], 0, [], None  # tail: key, constant window or None, run it goes on from
    for row in seen:
        mine = tail is not None and tail[0] == row["k"]
        if not mine:
            given = (_NEVER, 0, None, None)
        elif tail[1] is not None:
            given = (*tail[1], None, None)
        else:
            given = (None, None, tail[2], members[-1][1])
        if row["_whole"]:
            if given[2] is None:
                runs += 1
                members.append((runs, row["_part"], 0, given[0], given[1]))
            else:
                members.append((runs, row["_part"], members[-1][2] + 1, None, None))
            tail = (row["k"], None, runs)
        else:
            tail = (row["z"], (row["_last_end"], row["_last_count"]), None)
        entered.append((row["_part"], *given))
    given = spark.createDataFrame(entered, "_part int, _end long, _before long, _from int, _after int")
    if all(e[3] is None for e in entered):
        return given.select("_part", "_end", "_before")
    places = spark.createDataFrame([(r, p, i) for r, p, i, *_ in members], "_run int, _part int, _no int")
    tables = parts.join(places, "_part").select("_run", F.col("_no").alias("_part"), "_at", "_ends", "_counts", "_rows")
    longest = max(i for _, _, i, *_ in members) + 1
    before = None
    for level in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        tables = materialise(_doubled(tables, 1 << level), "limits")
        if before is not None:
            discard(before)
        before = tables
    opened = spark.createDataFrame([(r, e, c) for r, _, i, e, c in members if i == 0], "_run int, _e long, _c long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part, at, ends, counts, n, e, c in zip(*[col.to_pylist() for col in batch.columns], strict=True):
                end, count = _through(np.array([e]), np.array([c]), at, ends, counts, n)
                rows.append((part, int(end[0]), int(count[0])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)],
                                                 names=["_after", "_e", "_c"])

    left = tables.withColumnRenamed("_part", "_no").join(places, ["_run", "_no"]).join(opened, "_run").select(
        "_part", "_at", "_ends", "_counts", "_rows", "_e", "_c").mapInArrow(run, "_after int, _e long, _c long")
    return given.join(left, "_after", "left").select("_part", F.coalesce("_end", "_e").alias("_end"), F.coalesce("_before", "_c").alias("_before"))


def _walked_first(rows: DataFrame, entries: DataFrame, order: str, span: int) -> DataFrame:
    """The requests of each part's first client, walked from the window in force at its start."""
    given = rows.join(entries, "_part").repartition("_part").sortWithinPartitions("_part", "_t", order)
    columns = [c for c in rows.columns if c not in ("_start", "_count")]
    schema = T.StructType([*[rows.schema[c] for c in columns], T.StructField("_start", T.LongType()), T.StructField("_count", T.LongType())])
    part_at, time_at = columns.index("_part"), columns.index("_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, end, count = None, _NEVER, 0
        for batch in batches:
            times = batch.column(time_at).to_numpy()
            starts, places = np.empty(len(times), np.int64), np.empty(len(times), np.int64)
            for a, b in _runs(batch.column(part_at)):
                part = batch.column(part_at)[a].as_py()
                if part != now:
                    now, end, count = part, batch.column(len(columns))[a].as_py(), batch.column(len(columns) + 1)[a].as_py()
                starts[a:b], places[a:b], end, count = _walk(times[a:b], end, count, span)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(starts), pa.array(places)], names=schema.names)

    return given.select(*columns, "_end", "_before").mapInArrow(run, schema)


def fixed_window(requests: DataFrame, keys: list[str], ts: str, order: str, limit: RateLimit) -> DataFrame:
    """Adds ``window_start``, ``window_count``, ``remaining``, ``reset`` (epoch micros) and ``allowed``.

    Requests with equal time follow ``order``. Rejected requests count as well.
    """
    if limit.limit <= 0:
        at = epoch_micros(ts)
        return requests.withColumns({
            "window_start": at, "window_count": F.lit(0).cast("long"), "remaining": F.lit(limit.limit).cast("long"),
            "reset": at + limit.seconds * _MICROS, "allowed": F.lit(True),
        })
    span = limit.seconds * _MICROS
    keyed = requests.withColumns({
        "_key": F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys]), "_t": epoch_micros(ts)
    })
    walked = materialise(_walked_parts(keyed, order, span), "limits")
    rows = walked.where("_rows IS NULL").select(*keyed.columns, "_part", "_start", "_count")
    entries = _entries(walked.where("_rows IS NOT NULL"))
    first = _walked_first(rows.where("_start IS NULL"), entries, order, span)
    return rows.where("_start IS NOT NULL").unionByName(first).select(
        *requests.columns, F.col("_start").alias("window_start"), F.col("_count").alias("window_count"),
        F.greatest(F.lit(0).cast("long"), F.lit(limit.limit) - F.col("_count")).alias("remaining"),
        (F.col("_start") + span).alias("reset"), (F.col("_count") <= limit.limit).alias("allowed"),
    )


def clock_window(requests: DataFrame, keys: list[str], ts: str, limit: RateLimit) -> DataFrame:
    """Cheap approximation with clock-aligned windows: requests and rejections per window."""
    start = F.floor(epoch_micros(ts) / (limit.seconds * _MICROS)) * (limit.seconds * _MICROS)
    return requests.groupBy(*keys, start.alias("window_start")).agg(F.count(F.lit(1)).alias("requests")).withColumn(
        "rejected", F.greatest(F.lit(0).cast("long"), F.col("requests") - limit.limit)
    )


def enforce(
    requests: DataFrame, client: str, ts: str, order: str, main: RateLimit, burst: RateLimit,
    scope: str | None = None,
) -> DataFrame:
    """Main limit first; only requests that pass it reach the burst limit.

    Adds ``rejected_by`` (``main``, ``burst`` or null), and ``limit``, ``remaining``, ``reset`` as told
    to the client: of the limit that refused, else the smaller of both.
    """
    keys = [client] if scope is None else [scope, client]
    added = ["window_start", "window_count", "remaining", "reset", "allowed"]
    judged = fixed_window(requests, keys, ts, order, main)
    # written once: the burst limit reads it several times
    first = materialise(judged.withColumnsRenamed({c: f"main_{c}" for c in added}), "limits")
    passed = fixed_window(first.where("main_allowed"), [client], ts, order, burst).withColumnsRenamed(
        {c: f"burst_{c}" for c in added}
    )
    refused = first.where("NOT main_allowed")
    for name in added:
        refused = refused.withColumn(f"burst_{name}", F.lit(None).cast(passed.schema[f"burst_{name}"].dataType))
    both = passed.unionByName(refused)
    by = F.when(~F.col("main_allowed"), "main").when(~F.col("burst_allowed"), "burst")

    def told(name: str) -> Column:
        return (
            F.when(~F.col("main_allowed"), F.col(f"main_{name}"))
            .when(~F.col("burst_allowed"), F.col(f"burst_{name}"))
            .otherwise(F.least(f"main_{name}", f"burst_{name}"))
        )

    return both.select(
        *requests.columns,
        by.alias("rejected_by"),
        F.when(by == "burst", burst.limit).otherwise(main.limit).alias("limit"),
        told("remaining").alias("remaining"), told("reset").alias("reset"),
    )
