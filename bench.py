"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES``
a comma-separated choice of query names.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from logsieve.plans import load_all
from logsieve.plans.registry import REGISTRY
from logsieve.plans.views import TABLES
from logsieve.session import build_session, scratch_dir

HEADLINE = [
    "pii_redact", "pii_audit", "log_severity", "log_file_summary", "log_top_keywords", "log_line_samples", "chunk_lines",
    "report_markdown", "source_duplicates", "vector_embed", "vector_top_k_cosine", "vector_lists_all_probed",
    "jobs_statistics", "jobs_queue_head", "jobs_state", "jobs_with_children", "ticket_dispatch", "metric_histogram",
    "alert_failure_rate", "limit_requests", "watch_debounce", "stream_counts",
]


def laid_out(spark, sf_dir: str, parts: int) -> str:
    """The tables as a cluster writes them: several files. One row group in one file is one task, whatever the cores."""
    folder = scratch_dir(spark, "bench")
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(parts).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    load_all()
    spark = build_session(
        "logsieve-bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=str(2 * int(cpus)),
        spark__ui__enabled="false", spark__driver__memory="20g",
        spark__checkpoint__dir=os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    given, sf_dir = sf_dir, laid_out(spark, sf_dir, int(cpus))  # before the clock starts
    for name in ("log_severity", "pii_redact"):  # start the engine and its Python-free text path before the clock
        REGISTRY[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    started = spark.range(0, 8 * int(cpus), 1, int(cpus)).mapInArrow(lambda batches: batches, "id long")
    started.write.format("noop").mode("overwrite").save()  # and the Python workers
    took: dict[str, float] = {}
    for name in chosen.split(",") if chosen else HEADLINE:
        start = time.perf_counter()
        REGISTRY[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    text_mb = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(octet_length(text)) / 1e6").first()[0]
    rates = {f"{name}_mb_per_sec": round(text_mb / took[name], 2)
             for name in ("pii_redact", "log_file_summary", "chunk_lines") if name in took}
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": given.rstrip("/").rsplit("sf", 1)[-1], "rates": rates,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
