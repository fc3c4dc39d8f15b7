"""Queries over streams: tables replayed a quarter of their time span after the other, to their end.

Where a form holds rows until the watermark has passed them, a last file with a clock signal, a row without a key,
moves the watermark past all rows, as the signals of a live source do. The result then is that of the batch form.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from logsieve.operators import jobs, watching
from logsieve.plans.jobbing import STATE_SQL, _STATS
from logsieve.plans.measuring import _EVENTS, _JOB_TYPES, _rate_sql
from logsieve.plans.registry import REGISTRY, query
from logsieve.plans.ticketing import SYNC_SQL, remote_snapshots
from logsieve.plans.views import view, with_views
from logsieve.plans.watching import _HALF, _MAIN, _OVER, _SAID, _limit_sql, _stamp, _stamp_sql
from logsieve.session import scratch_dir
from logsieve.settings import WatchConfig
from logsieve.streaming import feeds, ordered, progress, sinks

_CLOCK = "30 days"
#: Rows that a file of a replayed table has at least, where there are several to a quarter.
_FILE = 500_000


def as_stream(spark, rows, ts: str, name: str, clock: str | None = None, delay: str = "0", parts: int = 4, keys: tuple[str, ...] = ()):
    """``rows`` written to the scratch folder by quarters of the span of ``ts``, then read a quarter to a micro-batch.

    A quarter is one file, or for large tables as many as any other, so that all tasks share in writing and reading it.
    ``delay`` is SQL for the number of files by which a row comes late; ``clock`` adds a row of nulls that long after the
    last, with empty ``keys`` where a join would drop null ones before they are seen.
    """
    path = scratch_dir(spark, name)
    rows = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    at = F.unix_micros(ts)
    ends = rows.agg(F.min(at).alias("a"), F.max(at).alias("z"), F.count(F.lit(1)).alias("n")).first()
    each = max(1, ends.n // (parts * _FILE))
    start, end = ends.a or 0, ends.z or 0
    due = F.least(F.floor((at - start) * parts / max(1, end - start)), F.lit(parts - 1)) + F.expr(delay)
    files = parts if delay == "0" else parts + 1
    for part in range(files):
        here = due == part if part < files - 1 else due >= part
        # a shuffle, so that the table is scanned by all tasks, whatever part of the quarter each finds
        rows.where(here).repartition(each).write.mode("append").parquet(path)
        # tasks without rows write no file, and the next quarter must not move up
        for _ in range(each * (part + 1) - len(_files(spark, path, rows)) if each > 1 else 0):
            rows.limit(0).coalesce(1).write.mode("append").parquet(path)
    if clock:
        late = (F.timestamp_micros(F.lit(end)) + F.expr(f"INTERVAL {clock}")).cast("timestamp")
        empty = {ts: late} | {k: F.lit("") for k in keys}
        signal = spark.range(1).select(*[empty.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema])
        signal.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(path)


def _files(spark, path: str, rows) -> list[str]:
    return spark.read.schema(rows.schema).parquet(path).inputFiles()


def replayed(spark, stream, mode="append"):
    path = scratch_dir(spark, "stream-out")
    feeds.run_once(stream, path, scratch_dir(spark, "stream-state"), mode)
    return spark.read.schema(stream.schema).parquet(path)


def merged(spark, stream, keys: list[str], mode: str):
    """The end of a stream in update or complete mode, every micro-batch written twice as after a failure."""
    path = scratch_dir(spark, "stream-out")
    write = sinks.latest_writer(path)

    def twice(batch, number):
        write(batch, number)
        write(batch, number)

    feeds.run_once(stream, "", scratch_dir(spark, "stream-state"), mode, twice)
    return sinks.read_latest(spark, path, keys, stream.schema)


@query("stream_counts", "O-MET-01", with_views("requests", """
    , w AS (SELECT endpoint, time_bucket(INTERVAL 1 HOUR, ts) AS s FROM requests),
      m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM requests)
    SELECT endpoint, strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, CAST(count(*) AS BIGINT) AS total
    FROM w, m WHERE s + INTERVAL 1 HOUR <= mark GROUP BY ALL"""))
def stream_counts(spark, sf_dir):
    """Hourly request counts as a stream: all windows the watermark has closed."""
    stream = as_stream(spark, view(spark, sf_dir, "requests").select("ts", "endpoint"), "ts", "requests")
    counted = feeds.windowed_counts(stream, "ts", ["endpoint"], "1 hour")
    return replayed(spark, counted).select(
        "endpoint", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "total"
    )


@query("stream_debounce", "O-WAT-01", with_views("watch_events", f"""
    , g AS (SELECT *, CASE WHEN epoch_us(ts - lag(ts) OVER (PARTITION BY path ORDER BY ts, event_id)) < 3600000000 THEN 0 ELSE 1 END AS opens
            FROM watch_events),
      n AS (SELECT *, sum(opens) OVER (PARTITION BY path ORDER BY ts, event_id) AS nr FROM g),
      m AS (SELECT max(ts) - INTERVAL 10 SECOND AS mark FROM watch_events),
      s AS (SELECT path, nr, min(ts) FILTER (kind = 'created') AS created_at, max(ts) + INTERVAL 3600 SECOND AS ready_at,
                   count(*) AS touches FROM n GROUP BY path, nr)
    SELECT path, {_stamp_sql("created_at")} AS created_at, {_stamp_sql("ready_at")} AS ready_at, CAST(touches AS BIGINT) AS touches
    FROM s, m WHERE created_at IS NOT NULL AND ready_at <= mark"""))
def stream_debounce(spark, sf_dir):
    """Sessions of file events that closed with a create among them."""
    stream = as_stream(spark, view(spark, sf_dir, "watch_events").select("path", "kind", "ts", "event_id"), "ts", "watch_events")
    ready = replayed(spark, feeds.debounce_stream(stream, 3600))
    return ready.withColumns({"created_at": _stamp("created_at"), "ready_at": _stamp("ready_at")})


@query("stream_debounce_once", "O-WAT-01", with_views("watch_events", f"""
    , c AS (SELECT path, min(ts) AS created FROM watch_events WHERE kind = 'created' GROUP BY path),
      a AS (SELECT w.path, w.ts, event_id, created, lead(ts) OVER (PARTITION BY w.path ORDER BY ts, event_id) AS nxt
            FROM watch_events w JOIN c ON c.path = w.path AND ts >= created),
      l AS (SELECT path, min(ts) AS last FROM a WHERE nxt IS NULL OR epoch_us(nxt - ts) >= 3600000000 GROUP BY path),
      t AS (SELECT a.path, count(*) AS touches FROM a JOIN l ON a.path = l.path AND a.ts <= l.last GROUP BY a.path)
    SELECT path, {_stamp_sql("created")} AS created_at, {_stamp_sql("last + INTERVAL 3600 SECOND")} AS ready_at, CAST(touches AS BIGINT) AS touches
    FROM l JOIN c USING (path) JOIN t USING (path)"""))
def stream_debounce_once(spark, sf_dir):
    """Each path once, as the batch form gives it, with a state that is dropped some time after."""
    rows = view(spark, sf_dir, "watch_events").select("path", "kind", "ts", "event_id")
    stream = as_stream(spark, rows, "ts", "watch_events", "2 days")
    ready = replayed(spark, ordered.debounce_once(stream, 3600, remember="60 days", order="event_id"))
    return ready.withColumns({"created_at": _stamp("created_at"), "ready_at": _stamp("ready_at")})


@query("stream_limits", "O-STR-04", with_views("requests", f"""
    , r AS (SELECT event_id, {_HALF} AS client, epoch_us(ts) AS t FROM requests), {_limit_sql("r", "main", _MAIN)}
    SELECT event_id, client, window_start, n AS window_count, n <= {_MAIN.limit} AS allowed, method, endpoint, status_code
    FROM main JOIN (SELECT event_id, method, endpoint, status_code FROM requests) USING (event_id)""", recursive=True))
def stream_limits(spark, sf_dir):
    """The limiter with its window as stream state; one client sends half of all requests."""
    rows = view(spark, sf_dir, "requests").withColumn("client", F.expr(_HALF)).select(
        "ts", "client", "event_id", "method", "endpoint", "status_code")
    stream = as_stream(spark, rows, "ts", "requests", _CLOCK)
    return replayed(spark, ordered.limit_stream(stream, "client", "ts", "event_id", _MAIN)).drop("ts")


@query("stream_late_rows", "O-STR-04 O-MET-01", with_views("requests", """
    , b AS (SELECT epoch_us(ts) AS t, event_id FROM requests), e AS (SELECT min(t) AS a, max(t) AS z FROM b),
      d AS (SELECT t, least(least((t - a) * 4 // greatest(1, z - a), 3) + CASE WHEN event_id % 7 = 0 THEN 3 ELSE 0 END, 4) AS file FROM b, e),
      m AS (SELECT file, max(t) AS top FROM d GROUP BY file),
      w AS (SELECT f.file, max(m.top) // 1000 * 1000 - 600000000 AS mark FROM (SELECT DISTINCT file FROM d) f JOIN m ON m.file <= f.file - 2 GROUP BY f.file)
    SELECT CASE x WHEN 0 THEN 'limit' ELSE 'feed' END AS form, CAST((SELECT count(*) FROM d JOIN w USING (file) WHERE t <= mark) AS BIGINT) AS late_rows
    FROM range(2) r(x)"""))
def stream_late_rows(spark, sf_dir):
    """Every seventh request comes three files late; the forms say how many rows their operator dropped as too late."""
    late = "CASE WHEN event_id % 7 = 0 THEN 3 ELSE 0 END"
    rows = view(spark, sf_dir, "requests").select("ts", "client", "event_id")
    told = None
    for form in ("limit", "feed"):
        stream = as_stream(spark, rows, "ts", "requests", delay=late)
        if form == "limit":
            made = ordered.limit_stream(stream, "client", "ts", "event_id", _MAIN, "10 minutes")
        else:
            events = stream.select(F.col("client").alias("job_id"), "event_id", F.lit("progress").alias("event_type"),
                                   F.col("ts").alias("created_at"), F.lit("{}").alias("data"))
            made = ordered.job_feed_stream(events, "10 minutes")
        done = feeds.run_once(made, scratch_dir(spark, "stream-out"), scratch_dir(spark, "stream-state"))
        counted = progress.operator_progress(spark, done).groupBy(F.lit(form).alias("form")).agg(F.sum("late_rows").alias("late_rows"))
        told = counted if told is None else told.unionByName(counted)
    return told


@query("stream_job_states", "O-JOB-03 O-JOB-04", STATE_SQL.replace("SELECT job_id, status, strftime", "SELECT CAST(job_id AS VARCHAR) AS job_id, status, strftime"))
def stream_job_states(spark, sf_dir):
    """State of every job after the last micro-batch, merged by job and number of batch; each batch is written twice."""
    rows = view(spark, sf_dir, "transitions").select("job_id", "status", "error", "ts", "seq")
    stream = as_stream(spark, rows, "ts", "transitions", _CLOCK)
    states = merged(spark, ordered.job_state_stream(stream, max_retries=20), ["job_id"], "update")
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("started_at", "completed_at")}
    return states.withColumns(shown).drop("updated_at")


def _job_events(spark, sf_dir):
    rows = view(spark, sf_dir, "job_events").withColumn("data", F.expr(_SAID))
    return as_stream(spark, rows.select("job_id", "event_id", "event_type", "created_at", "data"), "created_at", "job_events", _CLOCK)


@query("stream_job_feed", "O-STR-01", with_views("job_events", f"""
    , l AS (SELECT *, min(CASE WHEN {_OVER} THEN (created_at, event_id) END) OVER (PARTITION BY job_id) AS ends FROM job_events)
    SELECT job_id, event_id, event_type, {_SAID} AS data FROM l WHERE ends IS NULL OR (created_at, event_id) <= ends"""))
def stream_job_feed(spark, sf_dir):
    """Live events of every job until the one that ends it."""
    return replayed(spark, ordered.job_feed_stream(_job_events(spark, sf_dir), remember="60 days")).drop("created_at")


@query("stream_heartbeats", "O-STR-02", REGISTRY["feed_heartbeats"].sql.replace("SELECT job_id, 'heartbeat'", "SELECT CAST(job_id AS VARCHAR) AS job_id, 'heartbeat'")
       .replace("SELECT DISTINCT job_id", "SELECT DISTINCT CAST(job_id AS VARCHAR)"))
def stream_heartbeats(spark, sf_dir):
    told = replayed(spark, ordered.heartbeat_stream(_job_events(spark, sf_dir), remember="60 days"))
    return told.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_at", "last_at")})


@query("stream_turns", "O-CNV-01", with_views("turns", """
    SELECT job_id, sequence AS said_at, role, row_number() OVER (PARTITION BY job_id ORDER BY sequence) AS sequence FROM turns"""))
def stream_turns(spark, sf_dir):
    """Turns numbered on as they come, several files to a conversation."""
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("job_id") + F.col("sequence") * 40)
    rows = view(spark, sf_dir, "turns").select("job_id", F.col("sequence").alias("said_at"), "role", at.alias("ts"))
    return replayed(spark, ordered.append_turns_stream(as_stream(spark, rows, "ts", "turns", _CLOCK), "said_at", "ts")).drop("ts")


@query("stream_alert_failures", "O-MET-04", with_views("job_events", _rate_sql(_EVENTS, "event_type = 'failed'", 0.005, 120, _JOB_TYPES)))
def stream_alert_failures(spark, sf_dir):
    """The rule of ``alert_failure_rate`` over live events: sliding windows, then the hold."""
    rows = view(spark, sf_dir, "job_events").select("created_at", "event_type", F.expr(_JOB_TYPES).alias("series"))
    stream = as_stream(spark, rows, "created_at", "job_events", _CLOCK)
    judged = ordered.rate_alert_stream(stream, "created_at", F.col("event_type") == "failed", 0.005, 300, 120, ["series"])
    return replayed(spark, judged).withColumn("rate", F.round("rate", 6))


@query("stream_watch_status", "O-WAT-08", REGISTRY["watch_status"].sql)
def stream_watch_status(spark, sf_dir):
    """The status after the last micro-batch, as an aggregate in complete mode."""
    stream = as_stream(spark, view(spark, sf_dir, "job_events").select("job_id", "event_id", "created_at", "event_type"), "created_at", "job_events")
    status = merged(spark, watching.watch_status(stream, WatchConfig(roots=("/data",))), [], "complete")
    return status.select(
        "enabled", F.array_join("roots", ",").alias("roots"), "auto_create_jobs", "total_events",
        F.col("last_event.event_id").alias("last_event_id"), F.col("last_event.event_type").alias("last_event_type"),
    )


@query("stream_job_statistics", "O-JOB-07", with_views("jobs", f"""
    SELECT 'total' AS breakdown, 'all' AS value, {_STATS} UNION ALL SELECT 'status', status, {_STATS} GROUP BY status
    UNION ALL SELECT 'type', job_type, {_STATS} GROUP BY job_type"""))
def stream_job_statistics(spark, sf_dir):
    """Statistics of all jobs so far after every micro-batch; the last ones are returned."""
    rows = view(spark, sf_dir, "jobs").select("job_id", "status", "job_type", "created_at", "started_at", "completed_at")
    stats = merged(spark, jobs.job_statistics(as_stream(spark, rows, "created_at", "jobs")), [], "complete")
    return stats.withColumns({"success_rate": F.round("success_rate", 6), "avg_duration": F.round("avg_duration", 4)})


@query("stream_ticket_sync", "O-TKT-09", SYNC_SQL)
def stream_ticket_sync(spark, sf_dir):
    """Tickets and remote snapshots as two streams; a ticket is told when no snapshot can follow."""
    mine = view(spark, sf_dir, "tickets").select("platform", "ticket_id", "created_at", "status", "dry_run")
    keys = ("platform", "ticket_id")
    left = as_stream(spark, mine, "created_at", "tickets", "7000 days", keys=keys)
    right = as_stream(spark, remote_snapshots(spark, sf_dir), "seen_at", "snapshots", "7000 days", keys=keys)
    synced = replayed(spark, feeds.sync_stream(left, right, "3000 days", "3000 days"))
    return synced.select("ticket_id", "status", F.col("sync_raw").isNotNull().alias("synced"))


@query("sink_batches", "O-SRC-11", with_views("outcomes", """
    SELECT 'events' AS kind, job_id, 'completed' AS event_type, '{"lines":' || lines || ',"errors":' || errors || '}' AS body FROM outcomes
    UNION ALL SELECT 'outputs', job_id, NULL, '{"severity":"' || CASE WHEN critical > 0 THEN 'critical' WHEN errors > 0 THEN 'high'
           WHEN warnings > 0 THEN 'moderate' ELSE 'low' END || '","critical":' || critical || '}' FROM outcomes"""))
def sink_batches(spark, sf_dir):
    """Events and outputs written from each micro-batch, every batch twice; a batch cut off between both tables is not read."""
    rows = view(spark, sf_dir, "outcomes").withColumn("ended_at", F.to_timestamp("day", "yyyy-MM-dd"))
    path = scratch_dir(spark, "sink")
    severity = F.expr("CASE WHEN critical > 0 THEN 'critical' WHEN errors > 0 THEN 'high' WHEN warnings > 0 THEN 'moderate' ELSE 'low' END")
    made = {
        "events": lambda b: b.select("job_id", F.lit("completed").alias("event_type"), F.to_json(F.struct("lines", "errors")).alias("body")),
        "outputs": lambda b: b.select("job_id", F.to_json(F.struct(severity.alias("severity"), "critical")).alias("body")),
    }
    write = sinks.tables_writer(path, made)

    def twice(batch, number):
        write(batch, number)
        write(batch, number)

    feeds.run_once(as_stream(spark, rows, "ended_at", "outcomes"), "", scratch_dir(spark, "stream-state"), "append", twice)
    made["events"](rows).write.parquet(f"{path}/events/batch=1000000")
    events = sinks.read_table(spark, path, "events", "job_id string, event_type string, body string")
    outputs = sinks.read_table(spark, path, "outputs", "job_id string, body string").withColumn("event_type", F.lit(None).cast("string"))
    return events.withColumn("kind", F.lit("events")).unionByName(outputs.withColumn("kind", F.lit("outputs"))).select(
        "kind", "job_id", "event_type", "body")
