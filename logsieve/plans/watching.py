"""Queries over file events, job feeds and request limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsieve.functions.ordering import time_bucket
from logsieve.operators import limits, watching
from logsieve.plans.registry import query
from logsieve.plans.views import table, view, with_views
from logsieve.settings import RateLimit, WatchConfig

_STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _stamp(column: str):
    return F.date_format(column, _STAMP)


def _stamp_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


@query("watch_debounce", "O-WAT-01", with_views("watch_events", f"""
    , c AS (SELECT path, min(ts) AS created FROM watch_events WHERE kind = 'created' GROUP BY path),
      a AS (SELECT w.path, w.ts, event_id, created, lead(ts) OVER (PARTITION BY w.path ORDER BY ts, event_id) AS nxt
            FROM watch_events w JOIN c ON c.path = w.path AND ts >= created),
      l AS (SELECT path, min(ts) AS last FROM a WHERE nxt IS NULL OR epoch_us(nxt - ts) >= 3600000000 GROUP BY path)
    SELECT path, {_stamp_sql("created")} AS created_at, {_stamp_sql("last + INTERVAL 3600 SECOND")} AS ready_at
    FROM l JOIN c USING (path)"""))
def watch_debounce(spark, sf_dir):
    """An hour of quiet, as the events lie minutes apart."""
    ready = watching.debounce(view(spark, sf_dir, "watch_events"), time_bucket("ts", "day"), 3600)
    return ready.withColumns({"created_at": _stamp("created_at"), "ready_at": _stamp("ready_at")})


@query("watch_screen", "O-WAT-02", with_views("paths", """
    , m AS (SELECT file_id, file_size, CASE file_id % 6 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/plain' WHEN 3 THEN 'text/csv'
              WHEN 4 THEN 'application/json' ELSE 'application/octet-stream' END AS content_type FROM paths)
    SELECT file_id, content_type, CASE WHEN file_size > 104857600 THEN 'exceeds 100 MB'
           WHEN content_type NOT IN ('text/plain', 'application/json') THEN 'content type ' || content_type || ' is not allowed'
           END AS reject_reason FROM m"""))
def watch_screen(spark, sf_dir):
    return watching.screen_files(view(spark, sf_dir, "paths")).select("file_id", "content_type", "reject_reason")


@query("watch_jobs", "O-WAT-05", with_views("paths", """
    , d AS (SELECT *, path || '|' || sha256(text) AS k FROM paths)
    SELECT sha256('job|' || k) AS job_id, sha256('file|' || k) AS file_id, 'rca_analysis' AS job_type, 'file_watcher' AS source_type,
           path AS source_path, '{"files":["' || sha256('file|' || k) || '"]}' AS input_manifest FROM d"""))
def watch_jobs(spark, sf_dir):
    found = view(spark, sf_dir, "paths").withColumn("checksum", F.sha2("text", 256))
    return watching.watched_jobs(found).select(
        "job_id", "file_id", "job_type", F.col("source.type").alias("source_type"),
        F.col("source.path").alias("source_path"), "input_manifest",
    )


@query("watch_batches", "O-WAT-06", with_views("paths", """
    SELECT strftime(time_bucket(INTERVAL 5 SECOND, detected_at, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M:%S') AS batch_start,
           CAST(count(*) AS BIGINT) AS files, min(path) AS first_path FROM paths GROUP BY 1"""))
def watch_batches(spark, sf_dir):
    sizes = watching.batch_sizes(view(spark, sf_dir, "paths"), "detected_at", 5)
    return sizes.withColumn("batch_start", F.date_format("batch_start", "yyyy-MM-dd HH:mm:ss"))


@query("watch_latest", "O-WAT-07", with_views("job_events", """
    SELECT event_id, job_id, event_type FROM job_events ORDER BY created_at DESC, event_id DESC LIMIT 100"""))
def watch_latest(spark, sf_dir):
    return watching.latest_events(view(spark, sf_dir, "job_events"), 100).select("event_id", "job_id", "event_type")


@query("watch_status", "O-WAT-08", with_views("job_events", """
    SELECT true AS enabled, '/data' AS roots, true AS auto_create_jobs, CAST(count(*) AS BIGINT) AS total_events,
           max_by(event_id, (created_at, event_id)) AS last_event_id, max_by(event_type, (created_at, event_id)) AS last_event_type
    FROM job_events"""))
def watch_status(spark, sf_dir):
    status = watching.watch_status(view(spark, sf_dir, "job_events"), WatchConfig(roots=("/data",)))
    return status.select(
        "enabled", F.array_join("roots", ",").alias("roots"), "auto_create_jobs", "total_events",
        F.col("last_event.event_id").alias("last_event_id"), F.col("last_event.event_type").alias("last_event_type"),
    )


# every 97th event says in its data that the job has ended
_SAID = "CASE WHEN event_id % 97 = 0 THEN '{\"status\":\"cancelled\"}' ELSE data END"
_OVER = "(event_type IN ('completed', 'failed', 'cancelled') OR event_id % 97 = 0)"
_FEED = f"""
    , h AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, event_id DESC) AS back
            FROM job_events WHERE created_at <= TIMESTAMP '2024-01-16 00:00:00'),
      l AS (SELECT *, min(CASE WHEN {_OVER} THEN (created_at, event_id) END)
              OVER (PARTITION BY job_id) AS ends FROM job_events WHERE created_at > TIMESTAMP '2024-01-16 00:00:00')"""


@query("feed_job_events", "O-STR-01", with_views("job_events", f"""{_FEED}
    SELECT job_id, event_id, event_type, {_SAID} AS data, 'history' AS phase FROM h WHERE back <= 50
    UNION ALL SELECT job_id, event_id, event_type, {_SAID}, 'live' FROM l WHERE ends IS NULL OR (created_at, event_id) <= ends"""))
def feed_job_events(spark, sf_dir):
    joined = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    events = view(spark, sf_dir, "job_events").withColumn("data", F.expr(_SAID))
    return watching.job_feed(events, joined).select("job_id", "event_id", "event_type", "data", "phase")


@query("feed_heartbeats", "O-STR-02", with_views("job_events", f"""
    , o AS (SELECT *, min(CASE WHEN {_OVER} THEN (created_at, event_id) END) OVER (PARTITION BY job_id) AS ends FROM job_events),
      k AS (SELECT * FROM o WHERE ends IS NULL OR (created_at, event_id) <= ends),
      g AS (SELECT job_id, created_at, lead(created_at) OVER (PARTITION BY job_id ORDER BY created_at, event_id) AS nxt FROM k),
      b AS (SELECT *, (epoch_us(nxt) - epoch_us(created_at) - 1) // 15000000 AS beats FROM g)
    SELECT job_id, 'heartbeat' AS kind, CAST(created_at + to_seconds(15) AS VARCHAR)[1:19] AS first_at,
           CAST(created_at + to_seconds(15 * beats) AS VARCHAR)[1:19] AS last_at, CAST(beats AS BIGINT) AS beats FROM b WHERE beats >= 1
    UNION ALL SELECT DISTINCT job_id, 'complete', CAST(ends[1] AS VARCHAR)[1:19], CAST(ends[1] AS VARCHAR)[1:19], 1 FROM o
    WHERE ends IS NOT NULL"""))
def feed_heartbeats(spark, sf_dir):
    events = view(spark, sf_dir, "job_events").withColumn("data", F.expr(_SAID))
    told = watching.heartbeats(events, time_bucket("created_at"))
    return told.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_at", "last_at")})


_MAIN, _BURST = RateLimit(3, 14400), RateLimit(2, 3600)


def _limit_sql(source: str, out: str, limit: RateLimit) -> str:
    """Request-anchored windows: the chain of window starts per client, then the place in the window."""
    span = limit.seconds * 1_000_000
    return f"""
      {out}_s AS (
        SELECT client, min(t) AS s FROM {source} GROUP BY client
        UNION ALL
        SELECT c.client, min(r.t) FROM {out}_s c JOIN {source} r ON r.client = c.client AND r.t >= c.s + {span} GROUP BY c.client),
      {out}_w AS (SELECT r.*, c.s AS window_start FROM {source} r ASOF JOIN {out}_s c ON r.client = c.client AND r.t >= c.s),
      {out} AS (SELECT *, row_number() OVER (PARTITION BY client, window_start ORDER BY t, event_id) AS n FROM {out}_w)"""


_LIMITED = with_views("requests", f"""
    , r AS (SELECT event_id, client, epoch_us(ts) AS t FROM requests), {_limit_sql("r", "main", _MAIN)},
      p AS (SELECT event_id, client, t FROM main WHERE n <= {_MAIN.limit}), {_limit_sql("p", "burst", _BURST)}
    SELECT main.event_id, main.client, main.window_start,
           CASE WHEN main.n > {_MAIN.limit} THEN 'main' WHEN burst.n > {_BURST.limit} THEN 'burst' END AS rejected_by,
           CAST(CASE WHEN main.n > {_MAIN.limit} THEN 0 WHEN burst.n > {_BURST.limit} THEN 0
                ELSE least({_MAIN.limit} - main.n, {_BURST.limit} - burst.n) END AS BIGINT) AS remaining,
           CASE WHEN main.n > {_MAIN.limit} THEN main.window_start + {_MAIN.seconds * 1_000_000}
                WHEN burst.n > {_BURST.limit} THEN burst.window_start + {_BURST.seconds * 1_000_000}
                ELSE least(main.window_start + {_MAIN.seconds * 1_000_000}, burst.window_start + {_BURST.seconds * 1_000_000})
                END AS reset
    FROM main LEFT JOIN burst USING (event_id)""", recursive=True)


@query("limit_requests", "O-STR-04", _LIMITED.replace("main.window_start,\n           CASE", "CASE"))
def limit_requests(spark, sf_dir):
    """Main and burst limit of every client."""
    judged = limits.enforce(view(spark, sf_dir, "requests"), "client", "ts", "event_id", _MAIN, _BURST)
    return judged.select("event_id", "client", "rejected_by", "remaining", "reset")


_HALF = "CASE WHEN event_id % 2 = 0 THEN 'busy' ELSE client END"


@query("limit_busy_clients", "O-STR-04", with_views("requests", f"""
    , r AS (SELECT event_id, {_HALF} AS client, epoch_us(ts) AS t FROM requests), {_limit_sql("r", "main", _MAIN)}
    SELECT event_id, client, window_start, n AS window_count, n <= {_MAIN.limit} AS allowed FROM main""", recursive=True))
def limit_busy_clients(spark, sf_dir):
    """One client sends half of all requests."""
    sent = view(spark, sf_dir, "requests").withColumn("client", F.expr(_HALF))
    seen = limits.fixed_window(sent, ["client"], "ts", "event_id", _MAIN)
    return seen.select("event_id", "client", "window_start", "window_count", "allowed")


@query("limit_clock_windows", "O-STR-04", with_views("requests", f"""
    SELECT client, epoch_us(ts) // {_MAIN.seconds * 1_000_000} * {_MAIN.seconds * 1_000_000} AS window_start,
           CAST(count(*) AS BIGINT) AS requests, CAST(greatest(0, count(*) - {_MAIN.limit}) AS BIGINT) AS rejected
    FROM requests GROUP BY ALL"""))
def limit_clock_windows(spark, sf_dir):
    return limits.clock_window(view(spark, sf_dir, "requests"), ["client"], "ts", _MAIN)
