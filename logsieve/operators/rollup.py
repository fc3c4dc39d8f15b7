"""From file summaries to the findings of a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.ordering import top_per_key
from logsieve.functions.text import split_lines, strip
from logsieve.settings import DEFAULT_ACTION

METRICS = ["files", "lines", "errors", "warnings", "critical", "chunks"]


def job_metrics(summaries: DataFrame, keys: list[str] = ["job_id"]) -> DataFrame:
    """Totals per job over its file summaries."""
    chunks = F.sum("chunk_count") if "chunk_count" in summaries.columns else F.lit(0).cast("long")
    return summaries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("line_count").alias("lines"),
        F.sum("error_count").alias("errors"),
        F.sum("warning_count").alias("warnings"),
        F.sum("critical_count").alias("critical"),
        chunks.alias("chunks"),
    )


def severity(critical: Column, errors: Column, warnings: Column) -> Column:
    return (
        F.when(critical > 0, "critical").when(errors > 0, "high").when(warnings > 0, "moderate").otherwise("low")
    )


def add_severity(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("severity", severity(F.col("critical"), F.col("errors"), F.col("warnings")))


def categories(mode: Column) -> Column:
    """Sorted labels of a job from its mode and metrics."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(
        mode,
        F.lit("rca"),
        F.when(F.col("critical") > 0, "priority-incident"),
        F.when(F.col("errors") > 0, "error-detected"),
        F.when(F.col("warnings") > 0, "warning-detected"),
    ))))


def job_tags(summaries: DataFrame, keys: list[str] = ["job_id"], per_file: int = 3, n: int = 10) -> DataFrame:
    """The first ``n`` in the alphabet of the leading keywords of all files of a job.

    Distinct words are cut to ``n`` per task before the shuffle, so nothing grows with the files.
    """
    words = summaries.select(
        *keys, F.explode(F.slice("top_keywords", 1, per_file)).alias("word")
    ).distinct()
    return top_per_key(words, keys, [F.asc("word")], n).groupBy(*keys).agg(
        F.array_sort(F.collect_list("word")).alias("tags")
    )


def suspected_error_logs(summaries: DataFrame) -> DataFrame:
    """Files with errors or criticals in file order, one row each: a job may have any number."""
    return (
        summaries.where((F.col("error_count") > 0) | (F.col("critical_count") > 0))
        .select("job_id", "created_at", "file_id", "filename")
        .orderBy("job_id", "created_at", "file_id")
    )


def extract_actions(summary: Column) -> Column:
    """Bullet lines of a summary text without their bullets."""
    lines = F.transform(split_lines(summary), strip)
    bullets = F.filter(lines, lambda line: line.rlike("^[-*]"))
    stripped = F.transform(bullets, lambda line: strip(F.regexp_replace(line, "^[-* ]+", "")))
    return F.filter(stripped, lambda action: action != "")


def recommended_actions(summary: Column) -> Column:
    """Bullet lines, or the standing advice when there are none."""
    found = extract_actions(F.coalesce(summary, F.lit("")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(DEFAULT_ACTION)))


def jobs_without_input(jobs: DataFrame, files: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Jobs that cannot be analysed, with the reason: no files, or no documents to embed."""
    embeds = F.col("job_type") == "embedding_generation"
    lacking = (
        jobs.where(~embeds)
        .join(files.select("job_id").distinct(), "job_id", "left_anti")
        .withColumn("reject_reason", F.lit("No files uploaded for analysis"))
    )
    if documents is None:
        return lacking
    return lacking.unionByName(
        jobs.where(embeds)
        .join(documents.select("job_id").distinct(), "job_id", "left_anti")
        .withColumn("reject_reason", F.lit("No documents available to embed"))
    )


def lifecycle_events(summaries: DataFrame, metrics: DataFrame, mode: str = "rca_analysis") -> DataFrame:
    """The events a run leaves behind: phases of the job, and start and end of each file.

    ``phase_order`` puts the events of a job in the order they happen; files follow ``file_id``.
    """
    label = {"log_analysis": "log-analysis"}.get(mode)
    tagged = [F.lit(label).alias("mode")] if label else []

    def phase(order: int, name: str, status: str, *extra: Column) -> DataFrame:
        data = F.to_json(F.struct(F.lit(name).alias("phase"), *tagged, F.lit(status).alias("status"), *extra))
        return metrics.select(
            "job_id", F.lit(order).alias("phase_order"), F.lit(None).cast("string").alias("file_id"),
            F.lit("analysis-phase").alias("event_type"), data.alias("data"),
        )

    def per_file(order: int, event: str, *fields: Column) -> DataFrame:
        return summaries.select(
            "job_id", F.lit(order).alias("phase_order"), F.col("file_id").cast("string").alias("file_id"),
            F.lit(event).alias("event_type"),
            F.to_json(F.struct(F.col("file_id"), F.col("filename"), *fields)).alias("data"),
        )

    started = per_file(2, "file-processing-started", F.col("file_size").alias("size"))
    finished = per_file(
        3, "file-processing-completed",
        F.col("chunk_count").alias("chunks"), F.col("error_count").alias("errors"),
        F.col("warning_count").alias("warnings"), F.col("critical_count").alias("critical"),
        F.col("redaction_applied").alias("pii_redacted"), F.col("redaction_counts").alias("redaction_hits"),
    )
    events = [
        phase(1, "ingestion", "started"), started, finished,
        phase(4, "ingestion", "completed", F.col("files"), F.col("chunks")),
        phase(5, "llm", "started"), phase(6, "llm", "completed"),
    ]
    out = events[0]
    for more in events[1:]:
        out = out.unionByName(more)
    return out
