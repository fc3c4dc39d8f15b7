"""Streaming forms by built-in operators. Each takes a streaming DataFrame with an event-time column.

``watermark`` bounds the state and decides which late rows are dropped; ``progress`` counts them. Forms that have to
see the rows of a key in order are in ``ordered``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logsieve.operators.tickets import with_remote_status
from logsieve.streaming.matched import latest_within

#: State on local disk; the memory of all stores of an executor together is bounded. Set for the session, before a start.
STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "1000",
}


def drop_duplicate_files(files: DataFrame, ts: str = "created_at", watermark: str = "1 day") -> DataFrame:
    """First file of every checksum seen within the watermark."""
    return files.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["checksum"])


def debounce_stream(events: DataFrame, quiet_seconds: int = 5, watermark: str = "10 seconds") -> DataFrame:
    """Sessions of file events that close after ``quiet_seconds``; only those with a create are ready.

    All built-in, and a path that is created again later is ready again; ``ordered.debounce_once`` is exact.
    """
    sessions = events.withWatermark("ts", watermark).groupBy(
        F.session_window("ts", f"{quiet_seconds} seconds"), "path"
    ).agg(
        F.min(F.when(F.col("kind") == "created", F.col("ts"))).alias("created_at"),
        F.count(F.lit(1)).alias("touches"),
    )
    return sessions.where(F.col("created_at").isNotNull()).select(
        "path", "created_at", F.col("session_window.end").alias("ready_at"), "touches"
    )


def windowed_counts(
    events: DataFrame, ts: str, labels: list[str], width: str = "5 minutes", slide: str | None = None,
    watermark: str = "10 minutes",
) -> DataFrame:
    """Counters per label set and window; sliding when ``slide`` is given."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, watermark).groupBy(window, *labels).agg(F.count(F.lit(1)).alias("total")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *labels, "total"
    )


def batch_windows_stream(files: DataFrame, ts: str, seconds: int = 5, watermark: str = "1 minute") -> DataFrame:
    return windowed_counts(files, ts, [], f"{seconds} seconds", None, watermark)


def sync_stream(
    tickets: DataFrame, snapshots: DataFrame, after: str = "365 days", before: str = "0 days", watermark: str = "1 day"
) -> DataFrame:
    """``tickets.sync_status`` as a stream: each ticket once, with the last of its snapshots up to ``after`` its creation.

    ``tickets``: ``platform, ticket_id, created_at`` and more; ``snapshots``: ``platform, ticket_id, raw, seen_at, version``,
    the latter telling snapshots of one time apart. Tickets are kept for the time ``after`` them and of their snapshots
    those that may be the last, also of tickets that may come within ``before`` them; a ticket is told when the watermark
    has passed its time, also if it was never seen. Snapshots later than the watermark, or outside those times, are not
    taken. The state is kept by RocksDB, on the disks of the executors and within a bound of memory for all stores of one
    of them, in tables of a bucket of tickets (``matched``).
    """
    for name, value in STATE_ON_DISK.items():
        tickets.sparkSession.conf.set(name, value)
    names = ["platform", "ticket_id"]
    rows = tickets.select(*names, *[c for c in tickets.columns if c not in names])
    return with_remote_status(latest_within(
        rows, snapshots, names, "created_at", "seen_at", "version", "raw", before=before, after=after, watermark=watermark))


def run_once(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
    writer: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Everything available now, then stop: to Parquet at ``path``, or through ``writer`` per batch."""
    sink = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = sink.foreachBatch(writer).start() if writer else sink.format("parquet").option("path", path).start()
    query.awaitTermination()
    return query
