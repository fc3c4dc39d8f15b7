"""Tables the engine writes: chunks, file metadata, events, outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(
    df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "append",
    spread_by: str | None = None, files_per_folder: int = 4,
) -> None:
    """Parquet under ``path``. Give partition columns with few values (a date, a job bucket).

    Rows of a folder meet in ``files_per_folder`` tasks, by a hash of ``spread_by``, so the number of files does not
    grow with that of tasks, and a folder with a third of the rows is not one task.
    """
    if not partition_by:
        df.write.mode(mode).parquet(path)
        return
    if spread_by:
        df = df.repartition(*partition_by, F.pmod(F.xxhash64(spread_by), F.lit(files_per_folder)))
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_pieces(pieces: DataFrame, path: str, mode: str = "append") -> None:
    """Documents in pieces (``job_id, piece_no, text``) so that files read in name order give them in order.

    Pieces are dealt by range, so a job of any size is spread over as many files as it needs.
    """
    ordered = pieces.repartitionByRange("job_id", "piece_no").sortWithinPartitions("job_id", "piece_no")
    ordered.write.mode(mode).parquet(path)


def with_job_bucket(df: DataFrame, buckets: int = 256) -> DataFrame:
    """A bounded partition column: job ids have too many values to be folders."""
    return df.withColumn("job_bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int"))
