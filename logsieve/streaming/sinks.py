"""Sinks for ``foreachBatch`` that may see a micro-batch twice: every batch owns its folders and counts once it is closed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DONE = "closed"


def _close(spark: SparkSession, path: str, batch_id: int) -> None:
    """One row that says the batch is whole, written after all its tables."""
    spark.range(1).select(F.lit(batch_id).cast("long").alias("batch_id")).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/{_DONE}/batch={batch_id}")


def tables_writer(path: str, tables: dict[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """Writes several tables from each batch, all under its number, and closes the batch when all are there.

    A batch that is run again overwrites its own folders. One that was cut off between two tables is not closed, so
    ``read_table`` leaves it out of all of them until it is run again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, made in tables.items():
                made(batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        finally:
            batch.unpersist()
        _close(batch.sparkSession, path, batch_id)

    return write


def closed_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("batch_id long").parquet(f"{path}/{_DONE}/*")


def read_table(spark: SparkSession, path: str, name: str, schema) -> DataFrame:
    """Rows of the closed batches of a table, with the number of their batch."""
    rows = spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(f"{path}/{name}/batch=*")
    numbered = rows.withColumn("batch_id", F.col("batch").cast("long")).drop("batch")
    return numbered.join(closed_batches(spark, path), "batch_id", "left_semi")


def latest_writer(path: str) -> Callable[[DataFrame, int], None]:
    """For update and complete mode: keeps each batch, so that ``read_latest`` can merge by key and number of batch."""
    return tables_writer(path, {"rows": lambda batch: batch})


def read_latest(spark: SparkSession, path: str, keys: list[str], schema) -> DataFrame:
    """The row of the last closed batch that has the key; without keys all rows of the last batch (complete mode)."""
    rows = read_table(spark, path, "rows", schema)
    if not keys:
        last = closed_batches(spark, path).agg(F.max("batch_id").alias("batch_id"))
        return rows.join(last, "batch_id").drop("batch_id")
    names = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch_id").alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{n}").alias(n) for n in names])


def compact_latest(spark: SparkSession, path: str, target: str, keys: list[str], schema) -> None:
    """The merged rows as batch 0 of ``target``, a folder of the same kind, so that old batches can be dropped."""
    read_latest(spark, path, keys, schema).write.mode("overwrite").parquet(f"{target}/rows/batch=0")
    _close(spark, target, 0)
