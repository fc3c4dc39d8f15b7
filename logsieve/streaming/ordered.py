"""Stateful streams that see the rows of a key in order of time, one by one, whatever the size of a micro-batch.

Rows wait in the state store until the watermark has passed them, in pieces of some hundred rows that are sorted and
filed under their first time; then the pieces are merged and the rows released in order to a fold whose state is a few
values per key. A piece is one request to the store, so requests grow with the pieces and not with the rows, and only
pieces that overlap in time are in memory together. A fold may set a deadline: it is called at that time, before any row
that is not earlier, and may emit or end its state there. All times are event times, so a replay gives the same rows.

Every form drops rows later than its ``watermark`` (``progress.LateRows`` counts them) and rows whose key is null. The
last rows stay in the state until the watermark passes them; a row without a key, such as a clock signal, moves it on.
A row is released only when everything before it is late, so no row ever comes behind one that was released.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice
from operator import itemgetter
from random import getrandbits

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from logsieve.settings import TERMINAL_STATUSES, RateLimit

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_AT, _ORDER = "_at", "_order"
_FLUSH, _PIECE, _SHOWN = 65_536, 512, 8_192
_FLUSH_CHARS, _PIECE_CHARS = 1 << 24, 1 << 18
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_place, _time = itemgetter(0, 1), itemgetter(0)


class Fold:
    """What is done with the rows of a key. ``state`` is a tuple or None, where there is none.

    ``step`` takes the time of a row and its values in ``reads``; ``tick`` takes the deadline that ``due`` gave. Both
    return the new state and tuples to emit. The tuples of ``step`` bear the columns ``tells`` of their row in front
    where the form has such. ``tick`` has to move the deadline on. ``settled`` may emit rows once those at hand are done.
    """

    state_schema = ""
    reads: tuple[str, ...] = ()

    def step(self, key, state, at, *read):
        raise NotImplementedError

    def due(self, state):
        return None

    def tick(self, key, state, at):
        return None, ()

    def settled(self, key, state):
        return ()


class _InOrder(StatefulProcessor):
    """Holds rows back until the watermark passes their bucket and then feeds them to the fold, with its deadlines.

    A row is ``time, order, what the fold reads, what it is told with``.
    """

    def __init__(self, fold: Fold, names: list[str], columns: list[str], given: list[str], bucket_ms: int, frames: bool):
        self.fold, self.bucket_ms, self.names, self.frames = fold, bucket_ms, names, frames
        self.take = itemgetter(*[columns.index(c) for c in given])
        self.read = 2 + len(fold.reads)

    def init(self, handle) -> None:
        self.handle = handle
        # pieces that begin at the same time differ in their number
        self.waiting = handle.getMapState("waiting", "first long, number long", "rows binary")
        self.state = handle.getValueState("state", self.fold.state_schema)

    def close(self) -> None:
        pass

    def _keep(self, rows: list[tuple], chars: int) -> None:
        rows.sort(key=_place)
        size = max(1, min(_PIECE, len(rows) * _PIECE_CHARS // max(1, chars)))
        for i in range(0, len(rows), size):
            piece = rows[i : i + size]
            self.waiting.updateValue((piece[0][0], getrandbits(62)), (pickle.dumps(piece, 5),))

    def _taken(self, rows) -> Iterator[list[tuple]]:
        if self.frames:
            for frame in rows:
                yield list(map(self.take, frame.itertuples(index=False, name=None)))
        else:
            while some := list(map(self.take, islice(rows, 4096))):
                yield some

    def _after(self, at: int) -> int:
        """When rows of that time are released: the end of their bucket."""
        return (at // 1000 // self.bucket_ms + 1) * self.bucket_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame | Row]:
        if any(k is None for k in key):
            for _ in rows:
                pass
            return iter(())
        held, chars, first = [], 0, None
        for fresh in self._taken(rows):
            least = min(map(_time, fresh))
            first = least if first is None else min(first, least)
            held += fresh
            chars += _chars(fresh)
            if len(held) >= _FLUSH or chars >= _FLUSH_CHARS:
                self._keep(held, chars)
                held, chars = [], 0
        if held:
            self._keep(held, chars)
        if first is not None:
            self.handle.registerTimer(self._after(first))
        return iter(())

    def _released(self, pieces: list[tuple], end: int, left: list[tuple]) -> Iterator[tuple]:
        """Rows earlier than ``end`` of ``pieces`` in order; others are put into ``left`` and wait on as new pieces."""
        pool, n = left, 0
        while n < len(pieces):
            # as many rows as are in the pool already, so that a row is sorted a few times only
            enough = len(pool) + max(_PIECE, len(pool))
            while n < len(pieces) and len(pool) < enough:
                pool += pickle.loads(self.waiting.getValue(pieces[n])[0])
                self.waiting.removeKey(pieces[n])
                n += 1
            pool.sort(key=_place)
            cut = bisect_left(pool, pieces[n][0] if n < len(pieces) else end, key=_time)
            yield from pool[:cut]
            del pool[:cut]
        if pool:
            self._keep(pool, _chars(pool))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame | Row]:
        fold, upto, read = self.fold, timerValues.getCurrentWatermarkInMs(), self.read
        end = upto // self.bucket_ms * self.bucket_ms * 1000
        pieces = sorted(tuple(k) for k in self.waiting.keys())
        begun = bisect_left(pieces, end, key=_time)
        before = state = tuple(self.state.get()) if self.state.exists() else None
        out, left, any_row = [], [], False
        for row in self._released(pieces[:begun], end, left):
            at, any_row = row[0], True
            while state is not None and (due := fold.due(state)) is not None and due <= at:
                state, told = fold.tick(key, state, due)
                out += told
            state, told = fold.step(key, state, at, *row[2:read])
            out += [row[read:] + t for t in told] if len(row) > read else told
            if len(out) >= _SHOWN:
                yield from self._shown(out)
                out = []
        while state is not None and (due := fold.due(state)) is not None and due <= upto * 1000:
            state, told = fold.tick(key, state, due)
            out += told
        if any_row or state != before:
            out += fold.settled(key, state)
        if out:
            yield from self._shown(out)
        if state is None:
            if before is not None:
                self.state.clear()
        elif state != before:
            self.state.update(state)
        later = [self._after(rows[0][0]) for rows in (left, pieces[begun:]) if rows]
        if state is not None and (due := fold.due(state)) is not None:
            later.append(-(-due // 1000))
        if later:
            self.handle.registerTimer(min(later))

    def _shown(self, rows: list[tuple]) -> Iterator[pd.DataFrame | Row]:
        if self.frames:
            yield pd.DataFrame(rows, columns=self.names, dtype=object)
        else:
            yield from map(lambda values: Row(*self.names)(*values), rows)


def _chars(rows: list[tuple]) -> int:
    return sum(len(v) for row in rows for v in row[2:] if v.__class__ is str or v.__class__ is bytes)


def _packed(name: str, kind: T.DataType) -> Column:
    """A value as text, or as it is: frames would make numbers that may be null inexact."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name).cast("string")
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(name, {**_JSON, "ignoreNullFields": "false"})
    return F.col(name).cast("string")


def _unpacked(name: str, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.col(name).cast("long")).alias(name)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.from_json(name, kind, _JSON).alias(name)
    return F.col(name).cast(kind).alias(name)


def in_order(
    rows: DataFrame, keys: list[str], ts: str, order: Column, fold: Fold, made: str, watermark: str,
    mode: str = "append", bucket_ms: int = 1000, tells: list[str] = [], frames: bool = True,
) -> DataFrame:
    """``fold`` over the rows of each key in the order of ``ts`` and ``order``, a number, null first.

    The result has the columns ``tells`` of a row and those that the fold has ``made``. Columns that it ``reads`` are
    texts, or are not null. Without ``watermark`` the rows have to bear one already. ``bucket_ms`` is the time that rows
    of a key wait together. ``frames`` is the way to and from Python: frames are fast for keys of many rows and come out in
    bounded pieces, single rows cost less where there are many keys with few of them to emit. The rows are the same.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    marked = rows.withWatermark(ts, watermark) if watermark else rows
    kinds = {f.name: f.dataType for f in rows.schema}
    place = F.coalesce(order.cast("long"), F.lit(-(1 << 63)))
    own, read, told = [f"_key{i}" for i in range(len(keys))], [f"_read{i}" for i in range(len(fold.reads))], [f"_told{i}" for i in range(len(tells))]
    slim = marked.select(
        *[_packed(k, kinds[k]).alias(n) for k, n in zip(keys, own, strict=True)], ts, F.unix_micros(F.col(ts)).alias(_AT), place.alias(_ORDER),
        *[F.col(c).alias(n) for c, n in zip(fold.reads, read, strict=True)], *[_packed(c, kinds[c]).alias(n) for c, n in zip(tells, told, strict=True)],
    )
    new = T._parse_datatype_string(made) if made else T.StructType()
    texts = [T.StructField(n, T.BinaryType() if isinstance(kinds[c], T.BinaryType) else T.StringType()) for c, n in zip(tells, told, strict=True)]
    schema = T.StructType([*texts, *new.fields])
    processor = _InOrder(fold, schema.names, slim.columns, [_AT, _ORDER, *read, *told], bucket_ms, frames)
    grouped = slim.groupBy(*own)
    done = (grouped.transformWithStateInPandas if frames else grouped.transformWithState)(processor, schema, mode, "EventTime")
    return done.select(*[_unpacked(n, kinds[c]).alias(c) for c, n in zip(tells, told, strict=True)], *new.names)


def _micros(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1_000_000)


def _stamped(made: DataFrame, names: list[str]) -> DataFrame:
    """Micros under ``<name>_us`` as timestamps under ``<name>_at``, in place."""
    return made.select(*[F.timestamp_micros(c).alias(f"{c[:-3]}_at") if c.endswith("_us") and c[:-3] in names else c for c in made.columns])


# ---- request limits -----------------------------------------------------------------------------


class _Limit(Fold):
    state_schema = "end long, count long"

    def __init__(self, limit: RateLimit):
        self.limit, self.span = limit.limit, limit.seconds * 1_000_000

    def step(self, key, state, at):
        end, count = state or (at + self.span, 0)
        return (end, count + 1), [(end - self.span, count + 1, count < self.limit)]

    def due(self, state):
        return state[0]


def limit_stream(
    requests: DataFrame, client: str, ts: str, order: str, limit: RateLimit, watermark: str = "1 minute", bucket_ms: int = 1000
) -> DataFrame:
    """Requests with all their columns and their request-anchored window, judged in order of time.

    The state of a client is the end of its window and a count, and goes when the watermark passes that end. Late
    requests are charged to no window: they are dropped and counted.
    """
    made = "window_start long, window_count long, allowed boolean"
    return in_order(requests, [client], ts, F.col(order), _Limit(limit), made, watermark, bucket_ms=bucket_ms, tells=requests.columns)


# ---- watched paths ------------------------------------------------------------------------------


class _Once(Fold):
    state_schema = "created long, last long, touches long, forget long"
    reads = ("kind",)

    def __init__(self, quiet: int, remember: int):
        self.quiet, self.remember = quiet, remember

    def step(self, key, state, at, kind):
        if state is not None and state[3] >= 0:
            return state, ()
        if state is None:
            return ((at, at, 1, -1) if kind == "created" else None), ()
        return (state[0], at, state[2] + 1, -1), ()

    def due(self, state):
        return state[3] if state[3] >= 0 else state[1] + self.quiet

    def tick(self, key, state, at):
        created, last, touches, forget = state
        if forget >= 0:
            return None, ()
        return (created, last, touches, at + self.remember), [(key[0], created, at, touches)]


def debounce_once(
    events: DataFrame, quiet_seconds: int = 5, watermark: str = "10 seconds", remember: str = "30 days", ts: str = "ts", order: str | None = None
) -> DataFrame:
    """``path, created_at, ready_at, touches`` of each path once, when untouched for ``quiet_seconds`` after it was created.

    ``events``: ``path, kind, ts`` and ``order`` for events of one time. A path that has been reported is remembered for
    ``remember`` of event time; then its state goes, and a path that is created again is a new one.
    """
    fold = _Once(quiet_seconds * 1_000_000, _micros(remember))
    told = "path string, created_us long, ready_us long, touches long"
    made = in_order(events, ["path"], ts, F.col(order) if order else F.lit(0), fold, told, watermark)
    return _stamped(made, ["created", "ready"])


# ---- jobs ---------------------------------------------------------------------------------------


class _JobState(Fold):
    state_schema = "status string, started long, completed long, updated long, error string, failures long"
    reads = ("status", "error")

    def __init__(self, remember: int):
        self.remember = remember

    def step(self, key, state, at, new, said):
        status, started, completed, _, error, failures = state or ("", -1, -1, -1, None, 0)
        if new == "cancelled" and status in TERMINAL_STATUSES:
            return state, ()
        if new == "running" and started < 0:
            started = at
        if new in TERMINAL_STATUSES and completed < 0:
            completed = at
        if new in ("failed", "cancelled") and said is not None:
            error = said
        return (new, started, completed, at, error, failures + (new == "failed")), ()

    def due(self, state):
        return state[3] + self.remember if state[0] in TERMINAL_STATUSES else None

    def settled(self, key, state):
        return [] if state is None else [(key[0], *state)]


def job_state_stream(transitions: DataFrame, watermark: str = "1 minute", remember: str = "90 days", max_retries: int = 3) -> DataFrame:
    """State of a job after every micro-batch that released transitions of it, as ``jobs.job_states`` gives it; update mode.

    ``transitions``: ``job_id, status, error, ts, seq``. Cancellations of ended jobs are ignored. The state of an ended
    job goes when nothing came for ``remember`` of event time; what comes later begins anew.
    """
    told = "job_id string, status string, started_us long, completed_us long, updated_us long, error_message string, retry_count long"
    given = transitions.withColumn("job_id", F.col("job_id").cast("string"))
    made = in_order(given, ["job_id"], "ts", F.col("seq"), _JobState(_micros(remember)), told, watermark, "update", frames=False)
    known = made.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in ("started_us", "completed_us")})
    return _stamped(known, ["started", "completed", "updated"]).withColumn(
        "retry_eligible", (F.col("status") == "failed") & (F.col("retry_count") < max_retries))


class _Number(Fold):
    state_schema = "last long"

    def step(self, key, state, at):
        number = (state[0] if state else 0) + 1
        return (number,), [(number,)]


def append_turns_stream(turns: DataFrame, order: str, ts: str, watermark: str = "1 minute") -> DataFrame:
    """Turns with all their columns, numbered on per job by time and ``order``; the state is the job's last number.

    That number has to stay for as long as turns may come, so it is kept.
    """
    return in_order(turns, ["job_id"], ts, F.col(order), _Number(), "sequence long", watermark, tells=turns.columns)


def _says_end() -> Column:
    said = F.coalesce(F.get_json_object("data", "$.status").isin(TERMINAL_STATUSES), F.lit(False))
    return F.col("event_type").isin(TERMINAL_STATUSES) | said


class _Feed(Fold):
    state_schema = "forget long"
    reads = ("_ends",)

    def __init__(self, remember: int):
        self.remember = remember

    def step(self, key, state, at, ends):
        if state is not None:
            return state, ()
        return ((at + self.remember,) if ends else None), [()]

    def due(self, state):
        return state[0]


def job_feed_stream(events: DataFrame, watermark: str = "1 minute", remember: str = "30 days") -> DataFrame:
    """Events of each job, with all their columns, up to and including the one that ends it; later ones are dropped.

    ``events``: ``job_id, event_id, event_type, created_at`` and ``data``, a JSON string whose ``status`` may end the job
    too. Only an ended job has a state, for ``remember`` of event time after its end.
    """
    marked = events.withColumn("_ends", _says_end())
    return in_order(marked, ["job_id"], "created_at", F.col("event_id"), _Feed(_micros(remember)), "", watermark, tells=events.columns)


class _Beats(Fold):
    state_schema = "last long, forget long"
    reads = ("_ends",)

    def __init__(self, idle: int, remember: int):
        self.idle, self.remember = idle, remember

    def step(self, key, state, at, ends):
        if state is not None and state[1] >= 0:
            return state, ()
        out = []
        if state is not None and (beats := (at - state[0] - 1) // self.idle) >= 1:
            out.append((key[0], "heartbeat", state[0] + self.idle, state[0] + beats * self.idle, beats))
        if ends:
            return (at, at + self.remember), [*out, (key[0], "complete", at, at, 1)]
        return (at, -1), out

    def due(self, state):
        return state[1] if state[1] >= 0 else state[0] + self.remember


def heartbeat_stream(events: DataFrame, idle_seconds: int = 15, watermark: str = "1 minute", remember: str = "30 days") -> DataFrame:
    """Idle stretches and ends of jobs as ``watching.heartbeats`` gives them: ``job_id, kind, first_at, last_at, beats``.

    A stretch is known, and told, when it is over. A job that is silent or ended for ``remember`` has no state any more.
    """
    told = "job_id string, kind string, first_us long, last_us long, beats long"
    given = events.withColumns({"job_id": F.col("job_id").cast("string"), "_ends": _says_end()})
    fold = _Beats(idle_seconds * 1_000_000, _micros(remember))
    return _stamped(in_order(given, ["job_id"], "created_at", F.col("event_id"), fold, told, watermark, frames=False), ["first", "last"])


# ---- alerts -------------------------------------------------------------------------------------


class _Held(Fold):
    state_schema = "since long, last long"
    reads = ("tick", "over")

    def __init__(self, hold: int, step: int):
        self.hold, self.every = hold, step

    def step(self, key, state, at, tick, over):
        if not over:
            return None, [(None, False)]
        since = state[0] if state else tick
        return (since, tick), [(since, tick - since >= self.hold)]

    def due(self, state):
        # an evaluation that is not there is false; rows of a tick lie a microsecond before it
        return (state[1] + self.every) * 1_000_000


def rate_alert_stream(
    events: DataFrame, ts: str, failing: Column, threshold: float, window: int = 300, hold: int = 300, labels: list[str] = [],
    step: int = 30, watermark: str = "10 minutes",
) -> DataFrame:
    """``metrics.rate_alert`` as a stream: a sliding window, and after it the runs of evaluations above the threshold.

    Both are stateful and bounded: open windows, and two times per series that is above. Every event moves the clock,
    only ``failing`` ones count. A null label is empty.
    """
    series = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in labels]
    marked = events.withWatermark(ts, watermark).select(ts, *series, failing.alias("_failing"))
    counted = marked.groupBy(F.window(ts, f"{window} seconds", f"{step} seconds"), *labels).agg(F.count_if("_failing").alias("hits"))
    rated = counted.where("hits > 0").select(
        F.window_time("window").alias("_time"), *labels, F.unix_seconds(F.col("window.end")).alias("tick"), "hits",
        (F.col("hits") / window).alias("rate"), (F.col("hits") / window > threshold).alias("over"),
    )
    told = [*labels, "tick", "hits", "rate"]
    keyed = rated if labels else rated.withColumn("_all", F.lit(""))
    made = "pending_since long, firing boolean"
    return in_order(keyed, labels or ["_all"], "_time", F.col("tick"), _Held(hold, step), made, "", tells=told)
