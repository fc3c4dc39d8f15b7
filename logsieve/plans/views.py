"""The driver tables seen as the engine's tables.

Every view is one SELECT that Spark and DuckDB both read; ``@name`` stands for a driver table and
``SECS(n)`` for an interval of n seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # one line of a log per event
    "lines": """
        SELECT user_id AS file_id, user_id % 10 AS job_id, event_id AS line_no, ts,
               concat(DAYTIME(ts), ' ',
                      CASE WHEN event_type = 'error' AND value >= 150 THEN 'CRITICAL'
                           WHEN event_type = 'error' THEN 'ERROR'
                           WHEN event_type = 'signup' THEN 'WARNING' ELSE 'INFO' END,
                      ' ', event_type, ' handler finished in ', CAST(floor(value) AS BIGINT), ' ms') AS line
        FROM @events""",
    # one file per document
    "files": """
        SELECT doc_id AS file_id, source AS job_id, concat('file-', doc_id, '.log') AS filename, text, lang,
               TIMESTAMP '2024-01-01 00:00:00' + SECS(doc_id) AS created_at
        FROM @documents""",
    # names as they are uploaded: folders, capitals, no extension, rotated logs
    "uploads": """
        SELECT doc_id AS file_id, source AS job_id, text, n_chars * 4000 AS file_size,
               TIMESTAMP '2024-01-01 00:00:00' + SECS(doc_id) AS created_at,
               CASE doc_id % 8 WHEN 0 THEN 'app.log' WHEN 1 THEN 'logs/app.log' WHEN 2 THEN 'app.log.1'
                    WHEN 3 THEN 'Report final.TXT' WHEN 4 THEN 'data.json' WHEN 5 THEN '.hidden'
                    WHEN 6 THEN 'setup.exe' ELSE 'trace' END AS filename
        FROM @documents""",
    "paths": """
        SELECT doc_id AS file_id, n_chars * 4000 AS file_size,
               TIMESTAMP '2024-01-01 00:00:00' + SECS(doc_id) AS detected_at, text,
               concat('/data/', source, '/', CASE doc_id % 6 WHEN 0 THEN 'a.log' WHEN 1 THEN '~b.log'
                      WHEN 2 THEN 'c.tmp' WHEN 3 THEN 'd.csv' WHEN 4 THEN 'sub/e.json' ELSE 'f.bin' END) AS path
        FROM @documents""",
    "jobs": """
        SELECT o_orderkey AS job_id, o_custkey AS user_id,
               CASE o_orderkey % 3 WHEN 0 THEN 'rca_analysis' WHEN 1 THEN 'log_analysis'
                    ELSE 'embedding_generation' END AS job_type,
               CASE o_orderstatus WHEN 'F' THEN CASE o_orderkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'cancelled'
                    ELSE 'completed' END WHEN 'O' THEN 'running' ELSE 'pending' END AS status,
               10 - 2 * CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority,
               CAST(o_orderkey % 4 AS INT) AS retry_count, 3 AS max_retries,
               o_orderdate AS created_at,
               CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + SECS(o_orderkey % 3600) END AS started_at,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate
                    + SECS(o_orderkey % 3600 + CAST(floor(o_totalprice / 100) AS BIGINT)) END AS completed_at
        FROM @orders""",
    "job_events": """
        SELECT user_id AS job_id, event_id, ts AS created_at, props AS data,
               CASE event_type WHEN 'view' THEN 'progress' WHEN 'click' THEN 'started' WHEN 'purchase' THEN 'completed'
                    WHEN 'signup' THEN 'created' ELSE 'failed' END AS event_type
        FROM @events""",
    "transitions": """
        SELECT user_id AS job_id, event_id AS seq, ts,
               CASE event_type WHEN 'view' THEN 'cancelled' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed'
                    WHEN 'signup' THEN 'pending' ELSE 'failed' END AS status,
               CASE event_type WHEN 'view' THEN 'User cancelled'
                    WHEN 'error' THEN concat('code ', CAST(floor(value) AS BIGINT)) END AS error
        FROM @events""",
    "requests": """
        SELECT event_id, ts, CAST(user_id % 50 AS STRING) AS client, value * 10 AS duration_ms, value / 100 AS seconds,
               CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
               concat('/api/', event_type) AS endpoint,
               CASE WHEN event_type = 'error' THEN CASE WHEN value >= 100 THEN 500 ELSE 404 END ELSE 200 END AS status_code
        FROM @events""",
    "watch_events": """
        SELECT event_id, ts, value,
               CASE WHEN event_type IN ('signup', 'purchase') THEN 'created' ELSE 'modified' END AS kind,
               concat('/watch/', user_id % 40, CASE user_id % 5 WHEN 0 THEN '.log' WHEN 1 THEN '.txt'
                      WHEN 2 THEN '.json' WHEN 3 THEN '.tmp' ELSE '.bin' END) AS path
        FROM @events""",
    "model_calls": """
        SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'ollama'
                    ELSE 'bedrock' END AS provider,
               concat('model-', user_id % 3) AS model, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
               value / 100 AS duration, CAST(floor(value) AS BIGINT) AS asked, event_id % 97 AS told,
               CASE WHEN event_type = 'error' THEN '{}'
                    WHEN user_id % 4 = 0 THEN concat('{"prompt_tokens":', CAST(floor(value) AS BIGINT),
                         ',"completion_tokens":', event_id % 97, ',"total_tokens":', CAST(floor(value) AS BIGINT) + event_id % 97, '}')
                    WHEN user_id % 4 = 1 THEN concat('{"input_tokens":', CAST(floor(value) AS BIGINT),
                         ',"output_tokens":', event_id % 97, '}')
                    WHEN user_id % 4 = 2 THEN concat('{"prompt_eval_count":', CAST(floor(value) AS BIGINT),
                         ',"eval_count":', event_id % 97, '}')
                    ELSE concat('{"inputTextTokenCount":', CAST(floor(value) AS BIGINT),
                         ',"results":[{"tokenCount":', event_id % 97, '}]}') END AS usage
        FROM @events""",
    "gauges": """
        SELECT concat('host-', user_id % 20) AS host, ts,
               CASE event_type WHEN 'view' THEN 'memory_total' WHEN 'click' THEN 'memory_available'
                    WHEN 'purchase' THEN 'disk_available' WHEN 'signup' THEN 'disk_size' ELSE 'up' END AS name,
               CASE WHEN event_type IN ('view', 'signup') THEN 500.0 WHEN event_type = 'error'
                    THEN CASE WHEN value < 25 THEN 0.0 ELSE 1.0 END ELSE value END AS value
        FROM @events""",
    "turns": """
        SELECT conv_id AS job_id, turn AS sequence, role, text AS content FROM @conversations""",
    "tickets": """
        SELECT o_custkey AS job_id, o_orderdate AS created_at,
               CASE WHEN o_orderkey % 2 = 0 THEN 'servicenow' ELSE 'jira' END AS platform,
               concat(CASE WHEN o_orderkey % 2 = 0 THEN 'INC' ELSE 'OPS-' END, o_orderkey) AS ticket_id,
               CASE o_orderkey % 7 WHEN 0 THEN 'New' WHEN 1 THEN 'In Progress' WHEN 2 THEN 'Resolved'
                    WHEN 3 THEN 'Closed' WHEN 4 THEN 'dry-run' WHEN 5 THEN 'Done' ELSE 'sync failed' END AS status,
               o_orderkey % 7 = 4 AS dry_run,
               concat('{"summary":"', o_orderpriority, '"}') AS payload,
               CASE WHEN o_orderkey % 14 = 4 THEN '{"error":"timeout"}' ELSE '{}' END AS metadata
        FROM @orders""",
    # findings per file and day of the log lines
    "outcomes": """
        SELECT concat(file_id, '-', DAYDATE(ts)) AS job_id, file_id, DAYDATE(ts) AS day,
               CAST(count(*) AS BIGINT) AS lines,
               CAST(sum(CASE WHEN lower(line) LIKE '%error%' THEN 1 ELSE 0 END) AS BIGINT) AS errors,
               CAST(sum(CASE WHEN lower(line) LIKE '%warning%' THEN 1 ELSE 0 END) AS BIGINT) AS warnings,
               CAST(sum(CASE WHEN lower(line) LIKE '%critical%' THEN 1 ELSE 0 END) AS BIGINT) AS critical
        FROM (@@lines) AS l GROUP BY file_id, DAYDATE(ts)""",
}


TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

_SPARK = {"SECS(": "make_dt_interval(0, 0, 0, ", "DAYTIME(ts)": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')",
          "DAYDATE(ts)": "date_format(ts, 'yyyy-MM-dd')"}
_DUCK = {"SECS(": "to_seconds(", "DAYTIME(ts)": "strftime(ts, '%Y-%m-%d %H:%M:%S')",
         "DAYDATE(ts)": "strftime(ts, '%Y-%m-%d')"}


def _expand(name: str, words: dict[str, str]) -> str:
    text = VIEWS[name]
    for other in VIEWS:
        if f"@@{other}" in text:
            text = text.replace(f"@@{other}", _expand(other, words))
    for word, local in words.items():
        text = text.replace(word, local)
    return text


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; Spark prunes what the caller does not use."""
    text = _expand(name, {**_SPARK, "TIMESTAMP '": "TIMESTAMP_NTZ '"})
    for table_name in TABLES:
        text = text.replace(f"@{table_name}", f"parquet.`{sf_dir.rstrip('/')}/{table_name}.parquet`")
    return spark.sql(text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """DuckDB text: the named views as common table expressions in front of ``body``.

    A body that starts with ``,`` goes on with expressions of its own.
    """
    parts = []
    for name in names.split():
        text = _expand(name, _DUCK)
        for table_name in TABLES:
            text = text.replace(f"@{table_name}", table_name)
        parts.append(f"{name} AS ({text.strip()})")
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + f"\n{body.strip()}"
