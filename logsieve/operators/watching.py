"""File events of watched folders, and the event feed of a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.ordering import following, top_per_key
from logsieve.functions.text import extension
from logsieve.settings import TERMINAL_STATUSES, WatchConfig

# Content types by extension.
MIME_TYPES = {
    "log": "text/plain", "txt": "text/plain", "json": "application/json", "xml": "application/xml",
    "csv": "text/csv", "yaml": "application/yaml", "yml": "application/yaml",
}
# End of fixed values.


def debounce(events: DataFrame, bucket: Column, quiet_seconds: int = 5) -> DataFrame:
    """When each path is ready: untouched for ``quiet_seconds`` after it was created.

    ``events``: ``path, kind (created or modified), ts, event_id``. Modifications extend the wait but
    do not start one, and each path is ready once. Gives ``path, created_at, ready_at``.
    """
    started = events.where(F.col("kind") == "created").groupBy("path").agg(F.min("ts").alias("created_at"))
    with_next = following(events, ["path"], ["ts", "event_id"], bucket, F.col("ts"), "_next")
    gap = F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("_next"))
    quiet = with_next.where(F.col("_next").isNull() | (gap >= quiet_seconds * 1_000_000)).select("path", "ts")
    settled = quiet.join(started, "path").where(F.col("ts") >= F.col("created_at"))
    return settled.groupBy("path", "created_at").agg(F.min("ts").alias("_last")).select(
        "path", "created_at", (F.col("_last") + F.make_dt_interval(secs=F.lit(quiet_seconds))).alias("ready_at")
    )


def screen_files(files: DataFrame, config: WatchConfig = WatchConfig()) -> DataFrame:
    """Adds ``content_type`` and ``reject_reason`` by size and allowed content types."""
    pairs = [F.lit(part) for pair in MIME_TYPES.items() for part in pair]
    kind = F.coalesce(
        F.element_at(F.create_map(*pairs), extension(F.col("path"))), F.lit("application/octet-stream")
    )
    limit = config.max_file_size_mb * 1024 * 1024
    reason = F.when(F.col("file_size") > limit, F.lit(f"exceeds {config.max_file_size_mb} MB")).when(
        ~F.col("content_type").isin(list(config.allowed_mime_types)),
        F.concat(F.lit("content type "), F.col("content_type"), F.lit(" is not allowed")),
    )
    return files.withColumn("content_type", kind).withColumn("reject_reason", reason)


def watched_jobs(detected: DataFrame, config: WatchConfig = WatchConfig()) -> DataFrame:
    """A job row for every detected file, with the file it belongs to; none when the config says so.

    ``detected``: ``path, checksum, detected_at``. Ids come from path and checksum, so a replay of the
    same detection gives the same job.
    """
    file_id = F.sha2(F.concat_ws("|", F.lit("file"), "path", "checksum"), 256)
    job_id = F.sha2(F.concat_ws("|", F.lit("job"), "path", "checksum"), 256)
    source = F.struct(
        F.lit("file_watcher").alias("type"), F.col("path"), F.col("checksum"), F.col("detected_at")
    )
    rows = detected.select(
        job_id.alias("job_id"), file_id.alias("file_id"), F.lit("rca_analysis").alias("job_type"),
        F.to_json(F.struct(F.array(file_id).alias("files"))).alias("input_manifest"),
        source.alias("source"), F.lit("pending").alias("status"),
    )
    return rows if config.auto_create_jobs else rows.where(F.lit(False))


def batch_windows(files: DataFrame, ts: str, seconds: int = 5) -> DataFrame:
    """Adds the clock window a file falls into; files of one window are handled together."""
    return files.withColumn("batch_start", F.window(F.col(ts), f"{seconds} seconds")["start"])


def batch_sizes(files: DataFrame, ts: str, seconds: int = 5) -> DataFrame:
    return batch_windows(files, ts, seconds).groupBy("batch_start").agg(
        F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path")
    )


def latest_events(events: DataFrame, limit: int = 100) -> DataFrame:
    """The last ``limit`` events over all, in time order."""
    newest = events.orderBy(F.desc("created_at"), F.desc("event_id")).limit(limit)
    return newest.orderBy("created_at", "event_id")


def watch_status(events: DataFrame, config: WatchConfig = WatchConfig()) -> DataFrame:
    """One row: the config in force, the number of events and the last of them."""
    return events.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.max_by(F.struct(*events.columns), F.struct("created_at", "event_id")).alias("last_event"),
    ).withColumns({
        "enabled": F.lit(config.enabled),
        "roots": F.array(*[F.lit(r) for r in config.roots]),
        "auto_create_jobs": F.lit(config.auto_create_jobs),
    })


def _ends(event_type: Column, data: Column) -> Column:
    """Whether an event ends its job, by its type or by the status in its data."""
    return event_type.isin(TERMINAL_STATUSES) | F.coalesce(
        F.get_json_object(data, "$.status").isin(TERMINAL_STATUSES), F.lit(False)
    )


def job_feed(events: DataFrame, connected_at, history: int = 50) -> DataFrame:
    """What a listener that joins at ``connected_at`` gets: ``phase`` history or live.

    The last ``history`` events before it in time order, then live events up to and including the
    first that ends the job. Terminal is an event of that type or with that status.
    """
    before = F.col("created_at") <= F.lit(connected_at)
    past = top_per_key(
        events.where(before), ["job_id"], [F.desc("created_at"), F.desc("event_id")], history, "_rank"
    ).drop("_rank").withColumn("phase", F.lit("history"))
    live = events.where(~before)
    at = F.struct("created_at", "event_id")
    ends = live.where(_ends(F.col("event_type"), F.col("data"))).groupBy("job_id").agg(F.min(at).alias("_end"))
    heard = live.join(ends, "job_id", "left").where(F.col("_end").isNull() | (at <= F.col("_end"))).drop("_end")
    return past.unionByName(heard.withColumn("phase", F.lit("live")))


def heartbeats(events: DataFrame, bucket: Column, idle_seconds: int = 15) -> DataFrame:
    """``job_id, kind, first_at, last_at, beats``: the idle times of each job up to its end, and its completion.

    A ``heartbeat`` row stands for the ``beats`` signals, every ``idle_seconds``, between two events without any other,
    so rows follow the events and not the time that passes. A job that has ended gets one ``complete`` row.
    """
    at = F.struct("created_at", "event_id")
    ended = events.where(_ends(F.col("event_type"), F.col("data"))).groupBy("job_id").agg(F.min(at).alias("_end"))
    lived = events.join(ended, "job_id", "left").where(F.col("_end").isNull() | (at <= F.col("_end"))).drop("_end")
    with_next = following(lived, ["job_id"], ["created_at", "event_id"], bucket, F.col("created_at"), "_next")
    gap = F.timestamp_diff("MICROSECOND", F.col("created_at"), F.col("_next"))
    beats = F.floor((gap - 1) / (idle_seconds * 1_000_000))
    after = lambda n: F.col("created_at") + n * F.make_dt_interval(secs=F.lit(idle_seconds))
    idle = with_next.withColumn("beats", beats).where("beats >= 1").select(
        "job_id", F.lit("heartbeat").alias("kind"), after(F.lit(1)).alias("first_at"),
        after(F.col("beats")).alias("last_at"), "beats",
    )
    done = ended.select(
        "job_id", F.lit("complete").alias("kind"), F.col("_end.created_at").alias("first_at"),
        F.col("_end.created_at").alias("last_at"), F.lit(1).cast("long").alias("beats"),
    )
    return idle.unionByName(done)
