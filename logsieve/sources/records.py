"""JSON records: payload columns and structured application logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Field names of a structured log record.
LOG_RECORD = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("logger", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("module", T.StringType()),
    T.StructField("function", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("app", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("environment", T.StringType()),
    T.StructField("process_id", T.LongType()),
    T.StructField("thread_id", T.LongType()),
    T.StructField("exception", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("client", T.StringType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("duration_ms", T.DoubleType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("job_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def parse_payload(df: DataFrame, column: str, schema: str | T.StructType, into: str = "payload") -> DataFrame:
    """A JSON column as a struct of the given schema; unreadable JSON gives nulls."""
    return df.withColumn(into, F.from_json(column, schema))


def payload_field(column: str, path: str, kind: str = "string") -> Column:
    """One field of an open JSON document, null when absent or of another type."""
    return F.try_variant_get(F.try_parse_json(F.col(column)), path, kind)


def parse_log_records(df: DataFrame, column: str = "line") -> DataFrame:
    """Structured log lines as columns; a line that is no such record is kept in ``_corrupt_record``."""
    parsed = F.from_json(column, LOG_RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    kept = [c for c in df.columns if c not in LOG_RECORD.names]
    return df.withColumn("_record", parsed).select(*kept, "_record.*").withColumn(
        "timestamp", F.try_to_timestamp("timestamp")
    )
