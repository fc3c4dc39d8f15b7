"""Declared constraints as checks that report the rows breaking them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.settings import CLOSED_EVENT_TYPES, JOB_STATUSES, PLATFORMS


def _violates(ok: Column) -> Column:
    return ~F.coalesce(ok, F.lit(False))


def bad_status(jobs: DataFrame) -> DataFrame:
    return jobs.where(_violates(F.col("status").isin(JOB_STATUSES)))


def bad_event_type(events: DataFrame, closed: bool = False) -> DataFrame:
    """Events without a type, or with one outside the closed list."""
    kind = F.col("event_type")
    return events.where(_violates(kind.isin(CLOSED_EVENT_TYPES) if closed else F.length(kind) > 0))


def bad_file_size(files: DataFrame) -> DataFrame:
    return files.where(_violates(F.col("file_size") > 0))


def bad_platform(rows: DataFrame) -> DataFrame:
    return rows.where(_violates(F.col("platform").isin(PLATFORMS)))


def not_unique(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Values borne by more than one row, with how many."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent does not exist; a null link is no orphan."""
    return children.where(F.col(key).isNotNull()).join(parents.select(key), key, "left_anti")


@dataclass(frozen=True)
class ColumnRule:
    required: bool = False
    max_length: int | None = None


# Declared lengths and not-null columns.
JOB_COLUMNS = {
    "job_type": ColumnRule(True, 50), "status": ColumnRule(True, 20), "user_id": ColumnRule(True, 100),
    "input_manifest": ColumnRule(True), "provider": ColumnRule(True, 50), "model": ColumnRule(True, 100),
    "priority": ColumnRule(True), "retry_count": ColumnRule(True), "max_retries": ColumnRule(True),
    "created_at": ColumnRule(True),
}
FILE_COLUMNS = {
    "job_id": ColumnRule(True), "filename": ColumnRule(True, 255), "original_filename": ColumnRule(False, 255),
    "file_path": ColumnRule(True, 1024), "content_type": ColumnRule(False, 100), "file_size": ColumnRule(True),
    "checksum": ColumnRule(True, 128), "created_at": ColumnRule(True),
}
TICKET_COLUMNS = {
    "platform": ColumnRule(True, 50), "ticket_id": ColumnRule(True, 128), "url": ColumnRule(False, 512),
    "status": ColumnRule(True, 50), "profile_name": ColumnRule(False, 100), "dry_run": ColumnRule(True),
}
# End of fixed values.


def column_violations(rows: DataFrame, rules: dict[str, ColumnRule]) -> DataFrame:
    """Adds ``violations`` from one description of the columns; columns the table lacks are skipped."""
    found = []
    for name, rule in rules.items():
        if name not in rows.columns:
            continue
        if rule.required:
            found.append(F.when(F.col(name).isNull(), F.lit(f"{name}: null")))
        if rule.max_length is not None:
            too_long = F.length(F.col(name).cast("string")) > rule.max_length
            found.append(F.when(too_long, F.lit(f"{name}: longer than {rule.max_length}")))
    return rows.withColumn("violations", F.array_compact(F.array(*found)))
