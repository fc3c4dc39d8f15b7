"""Queries over jobs, their events, and the declared constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsieve.functions.ordering import time_bucket
from logsieve.operators import jobs, quality
from logsieve.plans.registry import query
from logsieve.plans.views import table, view, with_views

_AS_OF = "1998-06-01 00:00:00"
_DURATION = "epoch_us(completed_at - started_at) / 1e6"


@query("jobs_list", "O-JOB-01", with_views("jobs", """
    SELECT job_id, user_id, status FROM jobs WHERE status = 'completed' ORDER BY created_at DESC, job_id LIMIT 50 OFFSET 100"""))
def jobs_list(spark, sf_dir):
    page = jobs.list_jobs(view(spark, sf_dir, "jobs"), status="completed", limit=50, offset=100)
    return page.select("job_id", "user_id", "status")


@query("jobs_queue_head", "O-JOB-02", with_views("jobs", """
    SELECT job_id, priority FROM jobs WHERE status = 'pending' AND retry_count < max_retries
    ORDER BY priority DESC, created_at, job_id LIMIT 100"""))
def jobs_queue_head(spark, sf_dir):
    return jobs.queue(view(spark, sf_dir, "jobs"), 100).select("job_id", "priority")


@query("jobs_queue", "O-JOB-02", with_views("jobs", """
    SELECT job_id, priority FROM jobs WHERE status = 'pending' AND retry_count < max_retries"""))
def jobs_queue(spark, sf_dir):
    return jobs.queue(view(spark, sf_dir, "jobs")).select("job_id", "priority")


_EFFECTIVE = """
    , b AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, seq) AS before FROM transitions),
      e AS (SELECT * FROM b WHERE NOT (status = 'cancelled' AND coalesce(before, '') IN ('completed', 'failed', 'cancelled')))"""


STATE_SQL = with_views("transitions", f"""{_EFFECTIVE},
      s AS (SELECT job_id, max_by(status, (ts, seq)) AS status, min(ts) FILTER (status = 'running') AS started_at,
              min(ts) FILTER (status IN ('completed', 'failed', 'cancelled')) AS completed_at,
              max_by(error, (ts, seq)) FILTER (status IN ('failed', 'cancelled') AND error IS NOT NULL) AS error_message,
              CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS retry_count FROM e GROUP BY job_id)
    SELECT job_id, status, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at,
           strftime(completed_at, '%Y-%m-%d %H:%M:%S') AS completed_at, error_message, retry_count,
           status = 'failed' AND retry_count < 20 AS retry_eligible FROM s""")


@query("jobs_state", "O-JOB-03", STATE_SQL)
def jobs_state(spark, sf_dir):
    states = jobs.job_states(view(spark, sf_dir, "transitions"), time_bucket("ts", "day"), max_retries=20)
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("started_at", "completed_at")}
    return states.withColumns(shown).drop("updated_at")


@query("jobs_effective_transitions", "O-JOB-04", with_views("transitions", f"{_EFFECTIVE} SELECT job_id, seq, status FROM e"))
def jobs_effective_transitions(spark, sf_dir):
    kept = jobs.effective_transitions(view(spark, sf_dir, "transitions"), time_bucket("ts", "day"))
    return kept.select("job_id", "seq", "status")


@query("jobs_recent_events", "O-JOB-05", with_views("job_events", """
    , r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, event_id DESC) AS rank
            FROM job_events WHERE event_type = 'failed')
    SELECT job_id, event_id, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5"""))
def jobs_recent_events(spark, sf_dir):
    recent = jobs.recent_events(view(spark, sf_dir, "job_events"), 5, event_type="failed")
    return recent.select("job_id", "event_id", "rank")


@query("jobs_events_since", "O-JOB-06", with_views("job_events", """
    , r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, event_id DESC) AS rank
            FROM job_events WHERE created_at > TIMESTAMP '2024-01-15 12:00:00')
    SELECT job_id, event_id, event_type FROM r WHERE rank <= 10"""))
def jobs_events_since(spark, sf_dir):
    since = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return jobs.events_since(view(spark, sf_dir, "job_events"), since, 10).select("job_id", "event_id", "event_type")


_STATS = f"""CAST(count(*) AS BIGINT) AS jobs, round(CASE WHEN count(*) FILTER (status IN ('completed', 'failed')) = 0 THEN 0.0
        ELSE count(*) FILTER (status = 'completed') / count(*) FILTER (status IN ('completed', 'failed')) * 100 END, 6) AS success_rate,
        round(coalesce(avg({_DURATION}) FILTER (status = 'completed' AND {_DURATION} <> 0), 0.0), 4) AS avg_duration FROM jobs"""


@query("jobs_statistics", "O-JOB-07", with_views("jobs", f"""
    SELECT 'total' AS breakdown, 'all' AS value, {_STATS} UNION ALL SELECT 'status', status, {_STATS} GROUP BY status
    UNION ALL SELECT 'type', job_type, {_STATS} GROUP BY job_type"""))
def jobs_statistics(spark, sf_dir):
    stats = jobs.job_statistics(view(spark, sf_dir, "jobs"))
    return stats.withColumns({
        "success_rate": F.round("success_rate", 6), "avg_duration": F.round("avg_duration", 4)
    })


@query("jobs_duration", "O-JOB-08 O-JOB-14", with_views("jobs", f"""
    SELECT job_id, {_DURATION} AS duration, status IN ('completed', 'failed', 'cancelled') AS is_terminal FROM jobs"""))
def jobs_duration(spark, sf_dir):
    return view(spark, sf_dir, "jobs").select(
        "job_id", jobs.duration_seconds().alias("duration"), jobs.is_terminal(F.col("status")).alias("is_terminal")
    )


_EXPIRED = f"""
    , x AS (SELECT job_id FROM jobs WHERE status IN ('completed', 'failed', 'cancelled')
            AND completed_at < TIMESTAMP '{_AS_OF}' - INTERVAL 30 DAY)"""


@query("jobs_retention", "O-JOB-09", with_views("jobs", f"""{_EXPIRED}
    SELECT 'jobs' AS kind, CAST(count(*) AS BIGINT) AS removed, CAST((SELECT count(*) FROM jobs) - count(*) AS BIGINT) AS kept FROM x
    UNION ALL SELECT 'children', CAST(count(*) FILTER (l_orderkey IN (SELECT job_id FROM x)) AS BIGINT),
           CAST(count(*) FILTER (l_orderkey NOT IN (SELECT job_id FROM x)) AS BIGINT) FROM lineitem
    UNION ALL SELECT 'unlinked', CAST(count(*) FILTER (l_orderkey IN (SELECT job_id FROM x)) AS BIGINT),
           CAST(count(*) FILTER (l_orderkey NOT IN (SELECT job_id FROM x)) AS BIGINT) FROM lineitem"""))
def jobs_retention(spark, sf_dir):
    """Expired jobs with their child rows; once with the rows deleted, once with only the link cut."""
    every = view(spark, sf_dir, "jobs")
    children = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_linenumber")
    expired = jobs.expired_jobs(every, F.lit(_AS_OF).cast("timestamp_ntz"))

    def counted(kind, rows, gone):
        return rows.agg(
            F.lit(kind).alias("kind"), F.count_if(gone).alias("removed"), F.count_if(~gone).alias("kept")
        )

    def marked(rows, left):
        return rows.withColumn("_gone", F.lit(False)).unionByName(left.withColumn("_gone", F.lit(True)))

    jobs_left = jobs.remove_expired(expired, every)
    lost = children.join(expired.select("job_id"), "job_id", "left_semi")
    unlinked = jobs.unlink_expired(expired, children)
    return (
        counted("jobs", marked(jobs_left, expired), F.col("_gone"))
        .unionByName(counted("children", marked(jobs.remove_expired(expired, children), lost), F.col("_gone")))
        .unionByName(counted("unlinked", unlinked, F.col("job_id").isNull()))
    )


@query("jobs_with_children", "O-JOB-10", with_views("jobs", """
    , c AS (SELECT l_orderkey AS job_id, CAST(l_linenumber AS BIGINT) AS child_id, 'line' AS child_kind,
                   md5('{"l_partkey":' || l_partkey || ',"l_suppkey":' || l_suppkey || '}') AS child FROM lineitem
            UNION ALL SELECT conv_id, turn, 'turn', md5(text) FROM conversations)
    SELECT job_id, status, child_id, child_kind, child FROM jobs LEFT JOIN c USING (job_id)"""))
def jobs_with_children(spark, sf_dir):
    """Every job with its line items as JSON and its turns as text; the payload is shown by its digest."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("long").alias("child_id"),
        F.to_json(F.struct("l_partkey", "l_suppkey")).alias("child"),
    )
    turns = view(spark, sf_dir, "turns").select(
        "job_id", F.col("sequence").alias("child_id"), F.col("content").alias("child")
    )
    every = view(spark, sf_dir, "jobs").select("job_id", "status")
    return jobs.jobs_with_children(every, {"line": lines, "turn": turns}).withColumn("child", F.md5(F.col("child").cast("binary")))


@query("jobs_child_counts", "O-JOB-10", with_views("jobs", """
    SELECT job_id, CAST(coalesce(l.n, 0) AS BIGINT) AS lines, CAST(coalesce(t.n, 0) AS BIGINT) AS turns FROM jobs
    LEFT JOIN (SELECT l_orderkey AS job_id, count(*) AS n FROM lineitem GROUP BY 1) l USING (job_id)
    LEFT JOIN (SELECT conv_id AS job_id, count(*) AS n FROM conversations GROUP BY 1) t USING (job_id)"""))
def jobs_child_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"))
    return jobs.child_counts(
        view(spark, sf_dir, "jobs").select("job_id"), {"lines": lines, "turns": view(spark, sf_dir, "turns")}
    )


def _documented(spark, sf_dir):
    """Jobs whose outcome document sits in each of the places it may sit in."""
    return view(spark, sf_dir, "jobs").withColumns({
        "outputs": F.expr("""CASE job_id % 5
            WHEN 0 THEN concat('{"markdown":"# m","html":"<p>","json":{"severity":"high","n":', job_id, '}}')
            WHEN 1 THEN concat('{"severity":"low","n":', job_id, '}') WHEN 2 THEN '{}' END"""),
        "result_data": F.expr("""CASE job_id % 5
            WHEN 2 THEN concat('{"analysis_type":"rca_analysis","outputs":{"json":{"severity":"critical","n":', job_id, '}}}')
            WHEN 3 THEN concat('{"metrics":{"errors":', job_id % 10, '},"outputs":{"severity":"moderate","n":', job_id, '}}')
            WHEN 0 THEN '{"analysis_type":"log_analysis","generated_at":"2024-01-01T00:00:00+00:00","metrics":{"errors":3}}' END"""),
    })


@query("jobs_context", "O-JOB-11", with_views("jobs", """
    SELECT job_id, user_id, CASE WHEN job_id % 5 = 4 AND job_id % 3 = 2 THEN '{"job":null,"n":1}' ELSE
           '{' || CASE job_id % 5 WHEN 0 THEN '"severity":"high","n":' || job_id || ','
           WHEN 1 THEN '"severity":"low","n":' || job_id || ',' WHEN 2 THEN '"severity":"critical","n":' || job_id || ','
           WHEN 3 THEN '"severity":"moderate","n":' || job_id || ',' ELSE '' END
           || '"job":{"id":"' || job_id || '","user_id":"' || user_id || '"}}' END AS context FROM jobs"""))
def jobs_context(spark, sf_dir):
    """Documents in all places; among the jobs without one some have a list, a text or a document with a null job."""
    odd = F.when(F.col("job_id") % 5 != 4, F.col("outputs")).when(F.col("job_id") % 3 == 0, "[1, 2]").when(
        F.col("job_id") % 3 == 1, '"text"').otherwise('{"job":null,"n":1}')
    return jobs.job_context(_documented(spark, sf_dir).withColumn("outputs", odd)).select("job_id", "user_id", "context")


@query("jobs_summary", "O-JOB-12", with_views("jobs", """
    SELECT job_id, CASE WHEN job_id % 5 NOT IN (0, 1) THEN 'Summary outputs not available for this job' END AS reject_reason,
           CASE job_id % 5 WHEN 0 THEN 'log_analysis' WHEN 2 THEN 'rca_analysis' ELSE job_type END AS analysis_type,
           CASE job_id % 5 WHEN 0 THEN '2024-01-01T00:00:00+00:00' END AS generated_at,
           CASE job_id % 5 WHEN 0 THEN '# m' ELSE '' END AS markdown, CASE job_id % 5 WHEN 0 THEN '<p>' ELSE '' END AS html,
           CASE job_id % 5 WHEN 0 THEN '{"severity":"high","n":' || job_id || '}' ELSE '{}' END AS json,
           CASE job_id % 5 WHEN 0 THEN '{"errors":3}' WHEN 3 THEN '{"errors":' || job_id % 10 || '}' END AS metrics FROM jobs"""))
def jobs_summary(spark, sf_dir):
    return jobs.job_summaries(_documented(spark, sf_dir))


@query("jobs_access", "O-JOB-13", with_views("jobs", """
    SELECT r.l_orderkey AS job_id, r.l_linenumber AS line, j.user_id = l_suppkey OR coalesce(c_acctbal > 9000, false) AS allowed
    FROM lineitem r JOIN jobs j ON j.job_id = r.l_orderkey LEFT JOIN customer ON c_custkey = l_suppkey"""))
def jobs_access(spark, sf_dir):
    """Line items as requests by the supplier number; rich customers are superusers."""
    asked = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("requested_by")
    )
    users = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 9000).alias("is_superuser")
    )
    return jobs.accessible(view(spark, sf_dir, "jobs"), asked, users).select("job_id", "line", "allowed")


@query("jobs_create", "O-JOB-15", """
    SELECT o_orderkey AS job_id, CASE WHEN o_custkey % 3 = 0 THEN 'anonymous' ELSE CAST(o_custkey AS VARCHAR) END AS user_id,
           'ollama' AS provider, CASE WHEN o_custkey % 2 = 0 THEN 'llama2' ELSE 'large' END AS model,
           CAST(o_orderkey % 13 AS INT) AS priority, 'pending' AS status,
           CASE WHEN o_orderkey % 7 = 0 THEN 'job_type is required'
                WHEN o_orderkey % 13 > 10 THEN 'priority must be between 0 and 10'
                WHEN o_orderkey % 11 = 0 THEN 'input_manifest must be JSON' END AS reject_reason,
           '{}' AS model_config, CASE WHEN o_orderkey % 5 = 0 THEN '{"platforms":["jira"]}' ELSE '{}' END AS ticketing,
           CASE WHEN o_orderkey % 3 = 0 THEN '{"type":"watcher"}' END AS source, 3 AS max_retries, 0 AS retry_count,
           CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 13 <= 10 AND o_orderkey % 11 <> 0 THEN '{"input_manifest":'
                || CASE WHEN o_custkey % 2 = 0 THEN '{"files":["f' || o_custkey || '"]}' ELSE '{}' END || '}' END AS event
    FROM orders""")
def jobs_create(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey").cast("string")).alias("user_id"),
        F.when(F.col("o_orderkey") % 7 != 0, "rca_analysis").alias("job_type"),
        F.lit(None).cast("string").alias("provider"),
        F.when(F.col("o_orderkey") % 11 == 0, "{no json").when(
            F.col("o_custkey") % 2 == 0, F.concat(F.lit('{"files":["f'), "o_custkey", F.lit('"]}'))
        ).alias("input_manifest"),
        F.when(F.col("o_orderkey") % 5 == 0, '{"platforms":["jira"]}').alias("ticketing"),
        F.when(F.col("o_orderkey") % 3 == 0, '{"type":"watcher"}').alias("source"),
        F.when(F.col("o_custkey") % 2 != 0, "large").alias("model"),
        (F.col("o_orderkey") % 13).cast("int").alias("priority"),
    )
    made = jobs.create_jobs(asked)
    events = jobs.created_events(made).select("job_id", F.col("data").alias("event"))
    return made.join(events, "job_id", "left").select(
        "job_id", "user_id", "provider", "model", "priority", "status", "reject_reason", "event", "model_config",
        "ticketing", "source", "max_retries", "retry_count",
    )


@query("jobs_unknown_type", "O-LOG-10 O-REL-01", with_views("jobs", """
    SELECT job_id, CASE WHEN user_id % 4 = 0 THEN 'Unknown job type: triage' END AS dispatch_error FROM jobs"""))
def jobs_unknown_type(spark, sf_dir):
    odd = F.when(F.col("user_id") % 4 == 0, "triage").otherwise(F.col("job_type"))
    return jobs.dispatchable(view(spark, sf_dir, "jobs").withColumn("job_type", odd)).select("job_id", "dispatch_error")


# ---- constraints ----------------------------------------------------------------------------


@query("check_job_status", "O-REL-01", """
    SELECT o_orderkey AS job_id, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'O'""")
def check_job_status(spark, sf_dir):
    """Raw order codes, of which only one has been translated."""
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.when(F.col("o_orderstatus") == "O", "running").otherwise(F.col("o_orderstatus")).alias("status"),
    )
    return quality.bad_status(raw)


@query("check_event_type", "O-REL-02", """
    SELECT event_id, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS event_type, event_type <> 'view' AS closed
    FROM events WHERE true""")
def check_event_type(spark, sf_dir):
    """Empty types break the open rule, all raw types the closed list."""
    raw = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("").alias("event_type")
    )
    empty = quality.bad_event_type(raw).select("event_id", F.lit(True).alias("_empty"))
    return quality.bad_event_type(raw, closed=True).join(empty, "event_id", "left").select(
        "event_id", "event_type", F.col("_empty").isNull().alias("closed")
    )


@query("check_file_size", "O-REL-03", "SELECT doc_id AS file_id, n_chars - 100 AS file_size FROM documents WHERE n_chars <= 100")
def check_file_size(spark, sf_dir):
    sized = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), (F.col("n_chars") - 100).alias("file_size")
    )
    return quality.bad_file_size(sized)


@query("check_platform", "O-REL-04", """
    SELECT c_custkey AS profile, lower(c_mktsegment) AS platform FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')""")
def check_platform(spark, sf_dir):
    names = {"BUILDING": "servicenow", "MACHINERY": "jira"}
    platform = F.lower("c_mktsegment")
    for segment, name in names.items():
        platform = F.when(F.col("c_mktsegment") == segment, name).otherwise(platform)
    return quality.bad_platform(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile"), platform.alias("platform")))


@query("check_unique", "O-REL-05", """
    SELECT sha256(text) AS checksum, CAST(count(*) AS BIGINT) AS rows FROM documents GROUP BY 1 HAVING count(*) > 1""")
def check_unique(spark, sf_dir):
    sums = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("checksum"))
    return quality.not_unique(sums, ["checksum"])


@query("check_orphans", "O-REL-05", """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def check_orphans(spark, sf_dir):
    """Line items whose order does not count as created yet."""
    parents = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return quality.orphans(rows, parents, "l_orderkey")


@query("check_columns", "O-REL-06", """
    SELECT doc_id AS file_id, concat_ws('; ', CASE WHEN length(source || repeat('/folder', CAST(n_chars % 50 AS INT))) > 255
               THEN 'filename: longer than 255' END, CASE WHEN lang = 'fr' THEN 'checksum: null' END) AS violations FROM documents""")
def check_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), F.col("source").alias("job_id"),
        F.expr("concat(source, repeat('/folder', cast(n_chars % 50 as int)))").alias("filename"),
        F.when(F.col("lang") != "fr", F.sha2("text", 256)).alias("checksum"), F.col("n_chars").alias("file_size"),
    )
    broken = quality.column_violations(rows, quality.FILE_COLUMNS)
    return broken.select("file_id", F.array_join("violations", "; ").alias("violations"))
