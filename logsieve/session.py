"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "logsieve", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators count on; nothing here depends on data size.

    Shuffle width is left to adaptive execution: ``spark.sql.shuffle.partitions`` is only the upper
    bound, so set it for the cluster (2-3 per core) and let small stages coalesce.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Executors have to reach it. Only a local session may do without the setting, and then takes Spark's warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            root = current.get()
    if not root:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


_WRITTEN: dict[str, list[str]] = {}


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back: cuts lineage and survives executor loss."""
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._scratch_path = path
    return made


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote for ``df``, once nothing that is still to run reads it."""
    spark, path = df.sparkSession, df._scratch_path
    _delete(spark, path)
    _WRITTEN[spark.sparkContext.applicationId].remove(path)


def clear_scratch(spark: SparkSession) -> int:
    """Delete all that ``materialise`` wrote for this application and is still there; results read from it are gone then.

    For the end of a job, when its results are stored: intermediate tables may hold texts.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)
