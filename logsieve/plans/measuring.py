"""Queries over metrics and alert rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsieve.functions.text import extension
from logsieve.operators import metrics
from logsieve.plans.registry import query
from logsieve.plans.views import view, with_views
from logsieve.settings import HISTOGRAM_BOUNDS
from logsieve.sources import files


@query("metric_counters", "O-MET-01", with_views("requests", """
    SELECT method, endpoint, status_code, CAST(count(*) AS BIGINT) AS total FROM requests GROUP BY ALL"""))
def metric_counters(spark, sf_dir):
    return metrics.counter(view(spark, sf_dir, "requests"), ["method", "endpoint", "status_code"])


@query("metric_job_counters", "O-MET-01", with_views("jobs", """
    SELECT job_type, status, CAST(count(*) AS BIGINT) AS total FROM jobs GROUP BY ALL"""))
def metric_job_counters(spark, sf_dir):
    return metrics.counter(view(spark, sf_dir, "jobs"), ["job_type", "status"])


@query("metric_file_counters", "O-MET-01", with_views("uploads", """
    , f AS (SELECT file_size, lower(regexp_extract(regexp_extract(filename, '([^/]*)/*$', 1), '^.+\\.([^.]+)$', 1)) AS file_type FROM uploads),
      g AS (SELECT *, CASE WHEN file_type IN ('log', 'txt', 'json', 'xml', 'csv', 'yaml', 'yml') AND file_size <= 104857600
                      THEN 'accepted' ELSE 'rejected' END AS status FROM f)
    SELECT file_type, status, CAST(count(*) AS BIGINT) AS total, CAST(sum(file_size) AS BIGINT) AS bytes FROM g GROUP BY ALL"""))
def metric_file_counters(spark, sf_dir):
    """Files and bytes by type and by what the check of their name and size said."""
    checked = files.precheck(view(spark, sf_dir, "uploads"))
    said = checked.select(extension(F.col("filename")).alias("file_type"), "file_size", F.when(F.col("is_allowed"), "accepted").otherwise("rejected").alias("status"))
    labels = ["file_type", "status"]
    sizes = metrics.counter(said, labels, F.col("file_size")).withColumnRenamed("total", "bytes")
    return metrics.counter(said, labels).join(sizes, labels)


@query("metric_embedding_counters", "O-MET-01", with_views("model_calls", """
    SELECT provider, CAST(sum(asked) AS BIGINT) AS total FROM model_calls WHERE status = 'success' GROUP BY provider"""))
def metric_embedding_counters(spark, sf_dir):
    """Embeddings by provider; a call gives as many as it asked for."""
    calls = view(spark, sf_dir, "model_calls").where("status = 'success'")
    return metrics.counter(calls, ["provider"], F.col("asked"))


@query("metric_error_counters", "O-MET-01", with_views("requests model_calls", """
    SELECT CASE WHEN status_code >= 500 THEN 'server' ELSE 'client' END AS error_type, endpoint AS component,
           CAST(count(*) AS BIGINT) AS total FROM requests WHERE status_code >= 400 GROUP BY ALL
    UNION ALL SELECT 'inference', provider, CAST(count(*) AS BIGINT) FROM model_calls WHERE status = 'error' GROUP BY provider"""))
def metric_error_counters(spark, sf_dir):
    """Errors by type and component: failed requests by endpoint, failed model calls by provider."""
    failed = view(spark, sf_dir, "requests").where("status_code >= 400").select(
        F.when(F.col("status_code") >= 500, "server").otherwise("client").alias("error_type"), F.col("endpoint").alias("component"))
    calls = view(spark, sf_dir, "model_calls").where("status = 'error'").select(F.lit("inference").alias("error_type"), F.col("provider").alias("component"))
    return metrics.counter(failed.unionByName(calls), ["error_type", "component"])


@query("metric_histogram", "O-MET-02", with_views("requests", f"""
    , b AS (SELECT unnest([{', '.join(map(str, HISTOGRAM_BOUNDS))}, CAST('inf' AS DOUBLE)]) AS bound)
    SELECT method, endpoint, CASE WHEN isinf(bound) THEN '+Inf' ELSE CAST(bound AS VARCHAR) END AS le,
           CAST(count(*) FILTER (seconds <= bound) AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS count,
           round(sum(seconds), 4) AS sum FROM requests, b GROUP BY method, endpoint, bound"""))
def metric_histogram(spark, sf_dir):
    made = metrics.histogram(view(spark, sf_dir, "requests"), ["method", "endpoint"], "seconds")
    return made.drop("bound").withColumn("sum", F.round("sum", 4))


@query("metric_gauges", "O-MET-03", with_views("gauges", """
    SELECT host, name, max_by(value, ts) AS value, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts FROM gauges GROUP BY host, name"""))
def metric_gauges(spark, sf_dir):
    latest = metrics.last_values(view(spark, sf_dir, "gauges"), ["host", "name"])
    return latest.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("metric_queue", "O-MET-03", with_views("jobs", """
    SELECT job_type, CAST(count(*) FILTER (status = 'pending') AS BIGINT) AS queue_size,
           CAST(count(*) FILTER (status = 'running') AS BIGINT) AS in_progress FROM jobs GROUP BY job_type"""))
def metric_queue(spark, sf_dir):
    return metrics.queue_gauges(view(spark, sf_dir, "jobs"))


def _grid_sql(columns: dict[str, str], window: int, hold: int, source: str, series: str = "''") -> str:
    """Rolling sums of each series on the 30 second grid, straight from a range over the grid."""
    steps = ", ".join(f"count(*) FILTER ({flag}) AS {name}" for name, flag in columns.items())
    filled = ", ".join(f"coalesce({name}, 0) AS {name}" for name in columns)
    rolled = ", ".join(
        f"sum({name}) OVER (PARTITION BY series ORDER BY g.tick ROWS BETWEEN {window // 30 - 1} PRECEDING AND CURRENT ROW) AS {name}"
        for name in columns
    )
    return f"""
    , st AS (SELECT {series} AS series, (epoch_us(ts) // 30000000 + 1) * 30 AS tick, {steps} FROM {source} GROUP BY ALL),
      gr AS (SELECT series, unnest(generate_series(min(tick), max(tick) + {window + hold}, 30)) AS tick FROM st GROUP BY series),
      g AS (SELECT gr.series, gr.tick, {filled} FROM gr LEFT JOIN st USING (series, tick)),
      ev AS (SELECT g.series, g.tick, {rolled} FROM g)"""


def _held_sql(condition: str, hold: int) -> str:
    """True at every evaluation of the hold: islands of consecutive true evaluations."""
    return f"""
      ok AS (SELECT *, coalesce({condition}, false) AS ok FROM ev),
      isl AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY tick) AS island FROM ok),
      held AS (SELECT *, CASE WHEN ok THEN min(tick) FILTER (ok) OVER (PARTITION BY series, island) END AS pending_since FROM isl),
      fired AS (SELECT *, ok AND coalesce(tick - pending_since >= {hold}, false) AS firing FROM held)"""


def _rate_sql(source: str, failing: str, threshold: float, hold: int, series: str) -> str:
    return f"""
    {_grid_sql({"hits": failing}, 300, hold, source, series)},
    {_held_sql(f"hits / 300 > {threshold}", hold)}
    SELECT series, tick, CAST(hits AS BIGINT) AS hits, round(hits / 300, 6) AS rate, pending_since, firing FROM fired WHERE hits > 0"""


_JOB_TYPES = "CASE job_id % 3 WHEN 0 THEN 'rca_analysis' WHEN 1 THEN 'log_analysis' ELSE '' END"
_EVENTS = "(SELECT created_at AS ts, event_type, job_id FROM job_events)"


def _rates(spark, sf_dir, failing, threshold, hold, series):
    """Rates of failing events per series, at thresholds that the data reaches."""
    events = view(spark, sf_dir, "job_events").withColumn("series", F.expr(series))
    judged = metrics.rate_alert(events, "created_at", F.expr(failing), threshold, 300, hold, ["series"])
    return judged.withColumn("rate", F.round("rate", 6))


@query("alert_failure_rate", "O-MET-04", with_views("job_events", _rate_sql(_EVENTS, "event_type = 'failed'", 0.005, 120, _JOB_TYPES)))
def alert_failure_rate(spark, sf_dir):
    return _rates(spark, sf_dir, "event_type = 'failed'", 0.005, 120, _JOB_TYPES)


@query("alert_critical_rate", "O-MET-04", with_views("job_events", _rate_sql(_EVENTS, "event_type = 'failed'", 0.006, 30, "''")))
def alert_critical_rate(spark, sf_dir):
    """The sharper rule: a higher rate, a shorter hold, all jobs one series."""
    return _rates(spark, sf_dir, "event_type = 'failed'", 0.006, 30, "''")


@query("alert_ticket_failures", "O-MET-04", with_views("job_events", _rate_sql(
    _EVENTS, "event_type IN ('failed', 'cancelled')", 0.01, 60, "CASE job_id % 2 WHEN 0 THEN 'jira' ELSE 'servicenow' END")))
def alert_ticket_failures(spark, sf_dir):
    """Failed deliveries per platform; events of even jobs stand for one platform."""
    return _rates(spark, sf_dir, "event_type IN ('failed', 'cancelled')", 0.01, 60, "CASE job_id % 2 WHEN 0 THEN 'jira' ELSE 'servicenow' END")


@query("alert_latency", "O-MET-05", with_views("requests", f"""
    {_grid_sql({**{f"b{i}": f"seconds <= {b}" for i, b in enumerate(HISTOGRAM_BOUNDS)}, "n": "true"}, 300, 300, "requests")
        .replace("ev AS (", "e0 AS (")},
      ev AS (SELECT series, tick, n, CASE WHEN n = 0 THEN NULL ELSE q END AS q FROM (SELECT *, CASE
        {' '.join(
            f"WHEN b{i} >= 0.95 * n THEN "
            + (f"{HISTOGRAM_BOUNDS[i - 1]} + ({b} - {HISTOGRAM_BOUNDS[i - 1]}) * (0.95 * n - b{i - 1}) / nullif(b{i} - b{i - 1}, 0)"
               if i else f"{b} * (0.95 * n) / nullif(b0, 0)")
            for i, b in enumerate(HISTOGRAM_BOUNDS))} ELSE 10.0 END AS q FROM e0)),
    {_held_sql("q > 2.0", 300)}
    SELECT tick, round(q, 6) AS quantile, pending_since, firing FROM fired WHERE n > 0"""))
def alert_latency(spark, sf_dir):
    judged = metrics.latency_alert(view(spark, sf_dir, "requests"), "ts", "seconds")
    return judged.withColumn("quantile", F.round("quantile", 6))


@query("alert_stalled_watcher", "O-MET-06", with_views("watch_events", f"""
    {_grid_sql({"detected": "kind = 'created'", "ingested": "kind = 'modified'"}, 600, 600, "watch_events")},
    {_held_sql("detected > 0 AND ingested = 0", 600)}
    SELECT tick, CAST(detected AS BIGINT) AS detected, CAST(ingested AS BIGINT) AS ingested, pending_since, firing FROM fired
    WHERE detected + ingested > 0"""))
def alert_stalled_watcher(spark, sf_dir):
    return metrics.stalled_alert(
        view(spark, sf_dir, "watch_events"), "ts", F.col("kind") == "created", F.col("kind") == "modified"
    )


_STALE, _STEP, _HOLDS = 7200, 300, {"high_memory": 1200, "low_disk": 1200, "down": 600}


@query("alert_gauges", "O-MET-07", with_views("gauges", f"""
    , k AS (SELECT host, name, value, epoch_us(ts) AS us FROM gauges),
      t AS (SELECT host, unnest(generate_series((min(us) // 1000000 // {_STEP}) * {_STEP}, max(us) // 1000000 + {_STALE + _STEP}, {_STEP})) AS tick
            FROM k GROUP BY host),
      n AS (SELECT DISTINCT host, name FROM k),
      l AS (SELECT t.host, t.tick, k.name, k.value FROM (SELECT * FROM t JOIN n USING (host)) t
            ASOF JOIN k ON t.host = k.host AND t.name = k.name AND t.tick::BIGINT * 1000000 >= k.us
            WHERE t.tick::BIGINT * 1000000 < k.us + {_STALE * 1_000_000}),
      w AS (SELECT host, tick, max(value) FILTER (name = 'memory_total') AS mt, max(value) FILTER (name = 'memory_available') AS ma,
              max(value) FILTER (name = 'disk_available') AS da, max(value) FILTER (name = 'disk_size') AS ds,
              max(value) FILTER (name = 'up') AS up FROM l GROUP BY ALL),
      r AS (SELECT host, tick, 'high_memory' AS rule, (mt - ma) / nullif(mt, 0) AS value, (mt - ma) / nullif(mt, 0) > 0.9 AS c FROM w
            UNION ALL SELECT host, tick, 'low_disk', da / nullif(ds, 0), da / nullif(ds, 0) < 0.1 FROM w
            UNION ALL SELECT host, tick, 'down', up, up = 0 FROM w),
      ok AS (SELECT *, coalesce(c, false) AS ok FROM r),
      isl AS (SELECT *, tick - {_STEP} * row_number() OVER (PARTITION BY host, rule, ok ORDER BY tick) AS island FROM ok),
      held AS (SELECT *, CASE WHEN ok THEN min(tick) OVER (PARTITION BY host, rule, ok, island) END AS pending_since FROM isl)
    SELECT host, rule, tick, round(value, 6) AS value, pending_since, ok AND tick - pending_since >=
           CASE rule WHEN 'down' THEN {_HOLDS["down"]} ELSE {_HOLDS["low_disk"]} END AS firing FROM held WHERE value IS NOT NULL"""))
def alert_gauges(spark, sf_dir):
    """The gauge rules with holds and staleness that samples this far apart can reach."""
    judged = metrics.gauge_alerts(view(spark, sf_dir, "gauges"), _HOLDS, _STALE, _STEP)
    return judged.withColumn("value", F.round("value", 6))


@query("request_analytics", "O-MET-08", with_views("requests", """
    SELECT method, endpoint, CAST(count(*) AS BIGINT) AS requests, round(avg(CASE WHEN status_code >= 500 THEN 1.0 ELSE 0.0 END), 6) AS error_share,
           round(avg(duration_ms), 4) AS mean_ms, round(quantile_disc(duration_ms, 0.95), 4) AS p95_ms FROM requests GROUP BY ALL"""))
def request_analytics(spark, sf_dir):
    made = metrics.latency_by_endpoint(view(spark, sf_dir, "requests"))
    return made.withColumns({
        "error_share": F.round("error_share", 6), "mean_ms": F.round("mean_ms", 4), "p95_ms": F.round("p95_ms", 4)
    })
