"""Stateful streams over several micro-batches."""

import json
import random
import time
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import types as T

from logsieve.plans import streams
from logsieve.settings import RateLimit
from logsieve.streaming import feeds, matched, ordered, progress, sinks

T0 = datetime(2024, 1, 1)


def batches(spark, tmp_path, schema, parts):
    """A stream whose files are read one to a micro-batch, in the order given."""
    source = tmp_path / "in"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"stage{i}"))
        (source).mkdir(exist_ok=True)
        made = next((tmp_path / f"stage{i}").glob("*.parquet"))
        target = source / f"{i:02d}.parquet"
        target.write_bytes(made.read_bytes())
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))


def collected(stream, tmp_path, mode="append"):
    seen = []
    feeds.run_once(stream, "", str(tmp_path / "state"), mode, lambda batch, _: seen.extend(batch.collect()))
    return seen


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_each_path_is_ready_once(spark, tmp_path):
    """Modifications put the time off, a reported path stays silent, and one that is not yet passed waits."""
    parts = [
        [("a", "created", at(0)), ("b", "modified", at(0)), ("c", "created", at(1))],
        [("a", "modified", at(4)), ("c", "modified", at(30))],
        [("a", "created", at(60)), ("z", "modified", at(100))],
        [("a", "created", at(200)), ("z", "modified", at(300))],
    ]
    stream = batches(spark, tmp_path, "path string, kind string, ts timestamp", parts)
    got = collected(ordered.debounce_once(stream, 5, "1 second"), tmp_path)
    assert sorted((r.path, (r.created_at - T0).total_seconds(), (r.ready_at - T0).total_seconds(), r.touches) for r in got) == [
        ("a", 0.0, 9.0, 2), ("c", 1.0, 6.0, 1)]


def test_a_path_is_forgotten_and_its_state_goes(spark, tmp_path):
    parts = [
        [(f"p{i}", "created", at(i)) for i in range(20)],
        [("p0", "created", at(40)), (None, None, at(100))],
        [("p1", "created", at(400)), (None, None, at(1000))],
        [(None, None, at(5000))],
    ]
    stream = batches(spark, tmp_path, "path string, kind string, ts timestamp", parts)
    seen = []
    query = feeds.run_once(ordered.debounce_once(stream, 5, "1 second", remember="100 seconds"), "", str(tmp_path / "state"), "append",
                           lambda batch, _: seen.extend(batch.collect()))
    ready = sorted((r.path, int((r.created_at - T0).total_seconds())) for r in seen)
    assert ready == sorted([(f"p{i}", i) for i in range(20)] + [("p1", 400)])
    held = [r.state_rows for r in progress.operator_progress(spark, query).orderBy("batch_id").collect()]
    assert max(held) >= 20 and held[-1] < 5


def test_job_states_follow_the_transitions(spark, tmp_path):
    """Rows of a micro-batch come in any order; each batch is written twice and the last one of a job counts."""
    rows = [
        [("a", "failed", "late", at(5), 2), ("b", "running", None, at(0), 1), ("a", "running", None, at(0), 1)],
        [("a", "cancelled", "x", at(6), 3), ("b", "cancelled", "stop", at(7), 2), ("b", "cancelled", "again", at(9), 3)],
        [(None, None, None, at(500), None)],
    ]
    stream = batches(spark, tmp_path, "job_id string, status string, error string, ts timestamp, seq int", rows)
    path, write, states = str(tmp_path / "out"), sinks.latest_writer(str(tmp_path / "out")), ordered.job_state_stream(stream)

    def twice(batch, number):
        write(batch, number)
        write(batch, number)

    feeds.run_once(states, "", str(tmp_path / "state"), "update", twice)
    last = {r.job_id: r for r in sinks.read_latest(spark, path, ["job_id"], states.schema).collect()}
    assert (last["a"].status, last["a"].retry_count, last["a"].error_message) == ("failed", 1, "late")
    assert last["a"].completed_at == at(5) and last["a"].retry_eligible
    assert last["b"].status == "cancelled" and last["b"].completed_at == at(7) and last["b"].error_message == "stop"
    sinks.compact_latest(spark, path, str(tmp_path / "small"), ["job_id"], states.schema)
    assert {r.job_id: r for r in sinks.read_latest(spark, str(tmp_path / "small"), ["job_id"], states.schema).collect()} == last


def test_a_batch_cut_off_between_two_tables_is_not_read(spark, tmp_path):
    path = str(tmp_path / "out")
    broken = {"n": 0}

    def second(batch):
        if broken["n"] == 1:
            raise RuntimeError("executor lost")
        return batch.selectExpr("id * 10 AS id")

    write = sinks.tables_writer(path, {"one": lambda b: b, "two": second})
    write(spark.range(3), 0)
    broken["n"] = 1
    with pytest.raises(RuntimeError):
        write(spark.range(3, 6), 1)
    rows = lambda name: sorted((r.batch_id, r.id) for r in sinks.read_table(spark, path, name, "id long").collect())
    assert rows("one") == [(0, 0), (0, 1), (0, 2)] and rows("two") == [(0, 0), (0, 10), (0, 20)]
    broken["n"] = 0
    write(spark.range(3, 6), 1)
    assert rows("one") == [(0, 0), (0, 1), (0, 2), (1, 3), (1, 4), (1, 5)] and len(rows("two")) == 6


def test_turns_are_numbered_on(spark, tmp_path):
    parts = [[("a", 2, "assistant", at(2)), ("a", 1, "user", at(1))], [("a", 3, "user", at(3)), ("b", 1, "system", at(2))], [(None, None, None, at(900))]]
    stream = batches(spark, tmp_path, "job_id string, n long, role string, ts timestamp", parts)
    got = collected(ordered.append_turns_stream(stream, "n", "ts"), tmp_path)
    assert sorted((r.job_id, r.n, r.sequence) for r in got) == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 1, 1)]


def test_requests_are_judged_in_order_of_time_over_batches(spark, tmp_path):
    parts = [[("a", 1, at(100), "x")], [("b", 9, at(1000), "w")], [("a", 3, at(101), "z"), ("a", 2, at(90), "y")], [(None, None, at(9000), None)]]
    stream = batches(spark, tmp_path, "client string, n long, ts timestamp, path string", parts)
    got = collected(ordered.limit_stream(stream, "client", "ts", "n", RateLimit(1, 60), "920 seconds"), tmp_path)
    assert sorted((r.n, r.path, r.window_count, r.allowed) for r in got) == [(1, "x", 2, False), (2, "y", 1, True), (3, "z", 3, False), (9, "w", 1, True)]


def test_busy_client_in_small_steps(spark, tmp_path):
    """One client sends nearly everything; windows equal those of a plain walk."""
    import random

    rng = random.Random(2)
    times = sorted(rng.sample(range(20_000), 900))
    rows = [("hot" if i % 9 else f"c{i % 4}", i, at(t / 10)) for i, t in enumerate(times)]
    parts = [rows[:300], rows[300:600], rows[600:], [(None, None, at(9000))]]
    for part in parts:
        rng.shuffle(part)
    stream = batches(spark, tmp_path, "client string, n long, ts timestamp", parts)
    got = {r.n: (r.window_start, r.window_count) for r in collected(ordered.limit_stream(stream, "client", "ts", "n", RateLimit(5, 30), "10 seconds"), tmp_path)}
    want, open_ = {}, {}
    for client, n, when in rows:
        us = int((when - datetime(1970, 1, 1)) / timedelta(microseconds=1))
        start, count = open_.get(client, (None, 0))
        start, count = (us, 1) if start is None or us >= start + 30_000_000 else (start, count + 1)
        open_[client] = want[n] = (start, count)
    assert got == want


def test_late_rows_are_counted_for_every_query(spark, tmp_path):
    heard = progress.LateRows()
    spark.streams.addListener(heard)
    try:
        parts = [[("a", 1, at(10_000))], [("a", 2, at(20_000))], [("a", 3, at(1)), ("b", 4, at(2)), ("a", 5, at(20_001))]]
        stream = batches(spark, tmp_path, "client string, n long, ts timestamp", parts)
        query = feeds.run_once(ordered.limit_stream(stream, "client", "ts", "n", RateLimit(1, 60), "1 second"), str(tmp_path / "out"), str(tmp_path / "state"))
        assert progress.operator_progress(spark, query).selectExpr("sum(late_rows) AS n").first().n == 2
        deadline = time.time() + 20
        while time.time() < deadline and sum(heard.totals.values()) < 2:
            time.sleep(0.2)
        assert sum(heard.totals.values()) == 2
    finally:
        spark.streams.removeListener(heard)


def test_heartbeats_of_idle_stretches(spark, tmp_path):
    parts = [[("a", 1, "started", at(0), None), ("a", 2, "progress", at(50), None)],
             [("a", 3, "progress", at(80), '{"status":"completed"}'), ("a", 4, "progress", at(200), None), ("b", 5, "started", at(60), "{}")],
             [(None, None, None, at(900), None)]]
    stream = batches(spark, tmp_path, "job_id string, event_id long, event_type string, created_at timestamp, data string", parts)
    got = collected(ordered.heartbeat_stream(stream, 15), tmp_path)
    assert sorted((r.job_id, r.kind, (r.first_at - T0).total_seconds(), (r.last_at - T0).total_seconds(), r.beats) for r in got) == [
        ("a", "complete", 80.0, 80.0, 1), ("a", "heartbeat", 15.0, 45.0, 3), ("a", "heartbeat", 65.0, 65.0, 1)]


def test_alert_of_a_single_series(spark, tmp_path):
    parts = [[(at(10), True), (at(20), False)], [(at(400), True), (at(2000), False)], [(at(9000), False)]]
    stream = batches(spark, tmp_path, "ts timestamp, bad boolean", parts)
    from pyspark.sql import functions as F

    got = collected(ordered.rate_alert_stream(stream, "ts", F.col("bad"), 0.001, 300, 60, watermark="1 minute"), tmp_path)
    base = int((T0 - datetime(1970, 1, 1)).total_seconds())
    ticks = sorted((r.tick - base, r.hits, r.pending_since - base, r.firing) for r in got)
    assert ticks == [(t, 1, 30, t >= 90) for t in range(30, 301, 30)] + [(t, 1, 420, t >= 480) for t in range(420, 691, 30)]


def test_rows_wait_in_pieces_and_not_one_by_one(spark, tmp_path):
    """Thousands of rows of a key, none within a second of another, are a few entries of the state and come out exact."""
    n = 3000
    big = (1 << 60) + 1
    rows = [("k", None if i == 7 else big + i, at(10 * i)) for i in range(n)]
    parts = [rows[n // 2 :] + rows[: n // 2], [("k", 1, at(10 * n + 5))], [(None, None, at(60 * n))]]
    stream = batches(spark, tmp_path, "client string, n long, ts timestamp", parts)
    seen = []
    query = feeds.run_once(ordered.limit_stream(stream, "client", "ts", "n", RateLimit(1, 15), f"{40 * n} seconds"), "", str(tmp_path / "state"),
                           "append", lambda batch, _: seen.extend(batch.collect()))
    held = [r.state_rows for r in progress.operator_progress(spark, query).orderBy("batch_id").collect()]
    assert 0 < max(held) < n // 50
    told = sorted((r.ts, r.n, r.window_count) for r in seen if r.n is not None)
    assert [t[1] for t in told[:-1]] == [big + i for i in range(n) if i != 7]
    assert [t[2] for t in told[:4]] == [1, 2, 1, 2]


def test_ticket_state_is_on_disk(spark, tmp_path):
    """Tickets and snapshots wait in stores that are not in the memory of the JVM."""
    for name in ("t", "s"):
        (tmp_path / name).mkdir()
    tickets = batches(spark, tmp_path / "t", "platform string, ticket_id string, created_at timestamp, status string, dry_run boolean",
                      [[("jira", "A", at(0), "New", False)], [("", "", at(10**8), None, None)]])
    snaps = batches(spark, tmp_path / "s", "platform string, ticket_id string, seen_at timestamp, version int, raw string",
                    [[("jira", "A", at(5), 1, '{"fields":{"status":{"name":"Done"}}}')], [("", "", at(10**8), None, None)]])
    seen = []
    query = feeds.run_once(feeds.sync_stream(tickets, snaps, "1 day", "1 day"), "", str(tmp_path / "state"), "append",
                           lambda batch, _: seen.extend(batch.collect()))
    assert [(r.ticket_id, r.status) for r in seen] == [("A", "Done")]
    import json

    metrics = [op["customMetrics"] for p in query.recentProgress for op in json.loads(p.json if hasattr(p, "json") else json.dumps(p))["stateOperators"]]
    assert metrics and all(any(name.startswith("rocksdb") for name in m) for m in metrics)


def test_tickets_wait_in_tables_and_not_one_by_one(spark, tmp_path):
    """Thousands of tickets and snapshots are a row of state for each bucket; what is late or out of time is not taken."""
    for name in ("t", "s"):
        (tmp_path / name).mkdir()
    n, said = 4000, '{"fields":{"status":{"name":"%s"}}}'
    rows = [("jira", f"T{i}", at(i % 100), "New", False) for i in range(n)]
    tickets = batches(spark, tmp_path / "t", "platform string, ticket_id string, created_at timestamp, status string, dry_run boolean",
                      [rows, rows[:10] + [("jira", None, at(150), "New", False)], [("jira", "A", at(5), "New", False)], [("", "", at(10**8), None, None)]])
    first = [("jira", f"T{i}", at(i % 100 + 5), v, said % f"{i}-{v}") for i in range(n) for v in (9, 10)]
    more = [("jira", "T1", at(90), 1, said % "later"), ("jira", "T2", at(5000), 1, said % "out"), ("jira", None, at(120), 1, said % "x")]
    snaps = batches(spark, tmp_path / "s", "platform string, ticket_id string, seen_at timestamp, version int, raw string",
                    [first, more, [("jira", "T3", at(50), 1, said % "late")], [("", "", at(10**8), None, None)]])
    seen = []
    query = feeds.run_once(feeds.sync_stream(tickets, snaps, "1000 seconds", "10 seconds", "5 seconds"), "", str(tmp_path / "state"), "append",
                           lambda batch, _: seen.extend(batch.collect()))
    told = progress.operator_progress(spark, query).orderBy("batch_id").collect()
    assert 0 < max(r.state_rows for r in told) <= 1024 and sum(r.late_rows for r in told) == 2
    assert sorted((r.ticket_id or "", r.status) for r in seen) == sorted(
        [("", "New"), *((f"T{i}", "later" if i == 1 else f"{i}-10") for i in range(n))])


@pytest.mark.parametrize("piece, turn", [(7, 1 << 19), (50, 40), (1 << 16, 1 << 19)])
def test_the_latest_is_exact_however_rows_are_merged(monkeypatch, piece, turn):
    """Random rows against plain search, with ties, repeats, null keys and rows out of order."""
    monkeypatch.setattr(matched, "_PIECE", piece)
    monkeypatch.setattr(matched, "_MERGED", turn)

    class State:
        exists, get, hasTimedOut = False, None, False

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.exists = False

        def setTimeoutTimestamp(self, ms):
            assert ms >= self.mark

        def getCurrentWatermarkMs(self):
            return self.mark

    rng = random.Random(piece)
    kind = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DoubleType())])
    early, late = 40_000, 70_000
    step, state, out, waiting, theirs = matched._Latest(kind, early, late), State(), [], set(), []
    for batch in range(12):
        state.mark = 20 * batch  # ms
        rows = []
        for _ in range(rng.randrange(30)):
            key, c = rng.choice(["a", "b", "c", None]), (state.mark + rng.randrange(1, 40)) * 1000
            rows.append((1, True, key, c - early, c + late, f"{key}:{c}", None))
        for _ in range(rng.randrange(120)):
            s = (state.mark + rng.randrange(1, 60)) * 1000
            version = rng.choice([None, {"a": 9, "b": 1.5}, {"a": 10}, {"a": 10, "b": "NaN"}, {"a": 10, "b": 2.0}])
            rows.append((1, False, rng.choice("abc"), s, s, json.dumps({"version": version} if version else {}), rng.choice([None, "x", "y"])))
        waiting |= {r[2:6] for r in rows if r[1]}
        theirs += [r for r in rows if not r[1]]
        frames = [pd.DataFrame(rows[i : i + 16], columns=["bucket", "mine", "key", "low", "high", "what", "raw"]) for i in range(0, len(rows), 16)]
        out += [r for f in step((1,), iter(frames), state) for r in f.itertuples(index=False, name=None)]
    state.mark, state.hasTimedOut = 10**6, True
    out += [r for f in step((1,), iter(()), state) for r in f.itertuples(index=False, name=None)]
    assert not state.exists

    def best(key, low, high):
        def place(r):
            v = json.loads(r[5]).get("version")
            b = (v or {}).get("b")
            return r[3], v is not None, (v or {}).get("a") or -1, b is not None, b == "NaN", 0 if b in (None, "NaN") else b, r[6] or ""
        found = max((r for r in theirs if r[2] == key and low <= r[3] <= high), key=place, default=None)
        return (str(found[3]), found[6]) if found else (None, None)

    wanted = {what: best(key, low, high) for key, low, high, what in waiting}
    assert len(wanted) == len(waiting) == len(out) and {r[0]: r[1:] for r in out} == wanted


def test_a_quarter_in_several_files_is_one_micro_batch(spark, monkeypatch, tmp_path):
    """Also where a quarter has fewer rows than it has files."""
    monkeypatch.setattr(streams, "_FILE", 10)
    monkeypatch.setattr(streams, "scratch_dir", lambda spark, name: str(tmp_path / name))
    counts = [200, 1, 3, 60]
    rows = spark.createDataFrame([(at(100 * q + i * 0.25), i) for q, n in enumerate(counts) for i in range(n)] + [(at(400), 0)], "ts timestamp, n int")
    stream, seen = streams.as_stream(spark, rows, "ts", "quarters", clock="1 day"), []
    feeds.run_once(stream, "", str(tmp_path / "state"), "append", lambda batch, _: seen.append(batch.count()))
    assert seen == [200, 1, 3, 61, 1] and len(list((tmp_path / "quarters").glob("*.parquet"))) == 4 * 6 + 1
