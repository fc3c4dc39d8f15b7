"""Queries over sources, sinks and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsieve.functions.ordering import time_bucket
from logsieve.operators import chunks, privacy
from logsieve.plans.registry import query
from logsieve.plans.views import table, view, with_views
from logsieve.session import materialise, scratch_dir
from logsieve.settings import FilePolicy, PrivacyPolicy, WatchConfig
from logsieve.sources import files, records

_EXT = "lower(regexp_extract(regexp_extract(filename, '([^/]*)/*$', 1), '^.+\\.([^.]+)$', 1))"
_ALLOWED = "('log', 'txt', 'json', 'xml', 'csv', 'yaml', 'yml')"


_KEPT = """regexp_matches(path, '\\.(log|txt|json|csv)$') AND NOT regexp_matches(path, '/~[^/]*$') AND NOT path LIKE '%.tmp'"""


@query("source_paths", "O-SRC-01", with_views("paths", f"SELECT file_id, path FROM paths WHERE {_KEPT}"))
def source_paths(spark, sf_dir):
    return files.matching_paths(view(spark, sf_dir, "paths"), WatchConfig()).select("file_id", "path")


def _write_files(rows, folder: str) -> None:
    """One file per row (``file_id, path, content``) below ``folder``, which the executors share."""

    def run(batches):
        import pyarrow.fs

        store, root = pyarrow.fs.FileSystem.from_uri(folder) if ":/" in folder else (pyarrow.fs.LocalFileSystem(), folder)
        for batch in batches:
            for number, path, content in zip(*[c.to_pylist() for c in batch.columns]):
                name = f"{root}/{number % 100}/{number}{path}"
                store.create_dir(name.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(name) as out:
                    out.write(content)
            yield batch.slice(0, 0)

    slim = rows.select("file_id", "path", "content")
    slim.mapInArrow(run, slim.schema).write.format("noop").mode("overwrite").save()


@query("source_discover", "O-SRC-01", with_views("paths", f"""
    SELECT file_id, path, CAST(octet_length(encode(text)) AS BIGINT) AS length, sha256(text) AS checksum FROM paths
    WHERE {_KEPT} AND octet_length(encode(text)) <= 1048576"""))
def source_discover(spark, sf_dir):
    """Every document written as a file, and those found that a watched folder takes, up to a megabyte."""
    folder = scratch_dir(spark, "watched")
    _write_files(view(spark, sf_dir, "paths").withColumn("content", F.col("text").cast("binary")), folder)
    found = files.discover(spark, WatchConfig(roots=(folder,), max_file_size_mb=1))
    own = r"/[0-9]+/([0-9]+)(/data/.*)$"
    return found.select(
        F.regexp_extract("path", own, 1).cast("long").alias("file_id"), F.regexp_extract("path", own, 2).alias("path"),
        "length", F.sha2("content", 256).alias("checksum"),
    )


@query("source_precheck", "O-SRC-02", with_views("uploads", f"""
    , e AS (SELECT *, {_EXT} AS ext FROM uploads)
    SELECT file_id, ext IN {_ALLOWED} AND file_size <= 104857600 AS is_allowed,
           concat_ws('; ',
             CASE WHEN ext NOT IN {_ALLOWED} THEN 'Unsupported file extension: .' || CASE WHEN ext = '' THEN '<none>' ELSE ext END END,
             CASE WHEN file_size > 104857600 THEN 'File size ' || file_size || ' exceeds limit of 104857600 bytes' END) AS reasons
    FROM e"""))
def source_precheck(spark, sf_dir):
    checked = files.precheck(view(spark, sf_dir, "uploads"), FilePolicy())
    return checked.select("file_id", "is_allowed", F.array_join("reasons", "; ").alias("reasons"))


def _odd_uploads(spark, sf_dir):
    """All uploads, every 13th behind a head that does not print, and an empty file beside every 11th."""
    uploads = view(spark, sf_dir, "uploads")
    odd = F.when(F.col("file_id") % 13 == 0, F.concat(F.lit("é" * 2048), F.col("text"))).otherwise(F.col("text"))
    empty = uploads.where("file_id % 11 = 0").withColumns({"file_id": -F.col("file_id") - 1, "content": F.lit("").cast("binary")})
    return uploads.withColumn("content", odd.cast("binary")).unionByName(empty)


@query("source_upload_gate", "O-SRC-03", with_views("uploads", f"""
    , c AS (SELECT file_id, {_EXT} AS ext, encode(CASE WHEN file_id % 13 = 0 THEN repeat('é', 2048) || text ELSE text END) AS content FROM uploads
            UNION ALL SELECT -file_id - 1, {_EXT}, encode('') FROM uploads WHERE file_id % 11 = 0),
      s AS (SELECT *, regexp_extract_all(substr(hex(content), 1, 8192), '..') AS bytes FROM c)
    SELECT file_id, CASE WHEN ext <> '' AND ext NOT IN {_ALLOWED} THEN 'Unsupported file extension ''.' || ext || ''''
        WHEN octet_length(content) = 0 THEN 'Empty files are not allowed'
        WHEN len(list_filter(bytes, lambda x: (x >= '20' AND x <= '7E') OR x IN ('09', '0A', '0D'))) / len(bytes) < 0.6
        THEN 'File appears to be binary data which is not supported' END AS reject_reason
    FROM s"""))
def source_upload_gate(spark, sf_dir):
    return files.upload_gate(_odd_uploads(spark, sf_dir)).select("file_id", "reject_reason")


@query("source_decode", "O-SRC-04", with_views("files", """
    , c AS (SELECT file_id, replace(text, chr(10), chr(13) || chr(10)) AS t FROM files),
      d AS (SELECT file_id, CASE WHEN file_id % 3 = 0 THEN array_to_string(list_transform(
                regexp_extract_all(hex(encode(t)) || 'E9', '..'), lambda x: chr(CAST('0x' || x AS INT))), '') ELSE t END AS t FROM c)
    SELECT file_id, md5(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest,
           CAST(length(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS INT) AS chars
    FROM d"""))
def source_decode(spark, sf_dir):
    raw = F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")).cast("binary")
    broken = F.concat(raw, F.unhex(F.lit("E9")))
    stored = view(spark, sf_dir, "files").select(
        "file_id", F.when(F.col("file_id") % 3 == 0, broken).otherwise(raw).alias("content")
    )
    decoded = files.decode_text(stored)
    return decoded.select("file_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").alias("chars"))


@query("source_checksum", "O-SRC-05", with_views("files", """
    SELECT file_id, sha256(text) AS checksum, CAST(octet_length(encode(text)) AS INT) AS file_size FROM files"""))
def source_checksum(spark, sf_dir):
    stored = view(spark, sf_dir, "files").withColumn("content", F.col("text").cast("binary"))
    return files.add_checksum(stored).select("file_id", "checksum", "file_size")


@query("source_duplicates", "O-SRC-06", with_views("files", """
    SELECT file_id, job_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY created_at, file_id) > 1 AS is_duplicate
    FROM files"""))
def source_duplicates(spark, sf_dir):
    every = files.add_checksum(view(spark, sf_dir, "files").withColumn("content", F.col("text").cast("binary")))
    sums = materialise(every.select("file_id", "job_id", "created_at", "checksum"), "checksums")
    marked = files.reject_duplicates(sums)
    return marked.select("file_id", "job_id", "is_duplicate")


@query("source_store_names", "O-SRC-07", with_views("uploads", """
    , n AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(filename, '([^/]*)/*$', 1), '[^a-zA-Z0-9._-]', '_', 'g'),
                   '^[._]+|[._]+$', '', 'g') AS safe FROM uploads),
      r AS (SELECT *, row_number() OVER (PARTITION BY job_id, safe ORDER BY created_at, file_id) AS nth FROM n),
      t AS (SELECT job_id, regexp_extract(safe, '^(.*)\\.[1-9][0-9]*$', 1) AS safe,
                   list(DISTINCT CAST(regexp_extract(safe, '\\.([1-9][0-9]*)$', 1) AS INT)) AS taken
            FROM n WHERE regexp_matches(safe, '\\.[1-9][0-9]*$') GROUP BY ALL)
    SELECT r.file_id, CASE WHEN nth = 1 THEN r.safe ELSE r.safe || '.' || list_filter(range(1, nth + 3),
               lambda x: NOT list_contains(coalesce(taken, []), x))[nth - 1] END AS stored_name
    FROM r LEFT JOIN t ON r.job_id = t.job_id AND r.safe = t.safe"""))
def source_store_names(spark, sf_dir):
    named = files.store_names(view(spark, sf_dir, "uploads"), time_bucket("created_at"))
    return named.select("file_id", "stored_name")


@query("source_job_files", "O-SRC-08", with_views("files", """
    SELECT job_id, file_id, filename, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM files"""))
def source_job_files(spark, sf_dir):
    listed = files.job_files(view(spark, sf_dir, "files"))
    return listed.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query("source_payloads", "O-SRC-09", """
    SELECT event_type, CAST(count(*) AS BIGINT) AS events, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS k_sum,
           max(CAST(props->>'$.k' AS BIGINT)) AS k_max
    FROM events GROUP BY event_type""")
def source_payloads(spark, sf_dir):
    parsed = records.parse_payload(table(spark, sf_dir, "events"), "props", "k long")
    opened = parsed.withColumn("k_open", records.payload_field("props", "$.k", "long"))
    return opened.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.sum("payload.k").alias("k_sum"), F.max("k_open").alias("k_max")
    )


@query("source_log_records", "O-SRC-10", with_views("requests", """
    SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE 'api' END AS logger,
           CASE WHEN event_id % 50 = 0 THEN NULL ELSE method END AS method,
           CASE WHEN event_id % 50 = 0 THEN NULL ELSE endpoint END AS path,
           CASE WHEN event_id % 50 = 0 THEN NULL ELSE status_code END AS status_code,
           CASE WHEN event_id % 50 = 0 THEN NULL ELSE client END AS user_id,
           CASE WHEN event_id % 50 = 0 THEN 'plain text ' || event_id END AS corrupt
    FROM requests"""))
def source_log_records(spark, sf_dir):
    record = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.lit("INFO").alias("level"),
        F.lit("api").alias("logger"), F.col("method"), F.col("endpoint").alias("path"), F.col("status_code"),
        F.col("duration_ms"), F.col("client").alias("user_id"),
    ))
    lines = view(spark, sf_dir, "requests").select(
        "event_id",
        F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("plain text "), "event_id")).otherwise(record).alias("line"),
    )
    parsed = records.parse_log_records(lines)
    return parsed.select(
        "event_id", "logger", "method", "path", "status_code", "user_id", F.col("_corrupt_record").alias("corrupt")
    )


# redaction in SQL: RE2 knows only ASCII word boundaries, so accented letters are set between marks
# that are word characters while the numeric rules run
_ACCENTED = "[\\x{00AA}\\x{00B5}\\x{00BA}\\x{00C0}-\\x{00D6}\\x{00D8}-\\x{00F6}\\x{00F8}-\\x{024F}]"
_EMAIL, *_NUMERIC = [regex for _, regex in PrivacyPolicy().rules]
_LABELS = [label for label, _ in PrivacyPolicy().rules]


def _redacted_sql() -> str:
    def quoted(text: str) -> str:
        return text.replace("'", "''")

    steps = [
        f"r0 AS (SELECT *, len(regexp_extract_all(text, '{quoted(_EMAIL)}')) AS h0, regexp_replace(regexp_replace(text, "
        f"'{quoted(_EMAIL)}', '[REDACTED]', 'g'), '({_ACCENTED})', 'qZq\\1qZq', 'g') AS t0 FROM files)"
    ]
    for i, regex in enumerate(_NUMERIC, start=1):
        steps.append(
            f"r{i} AS (SELECT *, len(regexp_extract_all(t{i - 1}, '{quoted(regex)}')) AS h{i}, "
            f"regexp_replace(t{i - 1}, '{quoted(regex)}', '[REDACTED]', 'g') AS t{i} FROM r{i - 1})"
        )
    last = len(_NUMERIC)
    hits = ", ".join(f"CAST(h{i} AS INT) AS {label}" for i, label in enumerate(_LABELS))
    steps.append(
        f"redacted AS (SELECT file_id, job_id, filename, lang, created_at, text AS original, {hits}, "
        f"regexp_replace(t{last}, 'qZq({_ACCENTED})qZq', '\\1', 'g') AS text FROM r{last})"
    )
    return ", " + ",\n".join(steps)


REDACTED = _redacted_sql()
HITS = " + ".join(_LABELS)
HIT_ROWS = " UNION ALL ".join(
    f"SELECT file_id, job_id, '{label}' AS label, {label} AS hits FROM redacted WHERE {label} > 0" for label in _LABELS
)


@query("pii_redact", "O-PII-02", with_views("files", f"""{REDACTED}
    SELECT file_id, md5(text) AS digest, CAST(length(text) AS INT) AS chars, {HITS} > 0 AS redacted FROM redacted"""))
def pii_redact(spark, sf_dir):
    done = privacy.redact(view(spark, sf_dir, "files"))
    return done.select(
        "file_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").alias("chars"),
        F.col("redaction_applied").alias("redacted"),
    )


@query("pii_hits", "O-PII-03", with_views("files", f"""{REDACTED}
    SELECT file_id, label, hits FROM ({HIT_ROWS})"""))
def pii_hits(spark, sf_dir):
    done = privacy.redact(view(spark, sf_dir, "files"))
    return privacy.redaction_hits(done, ["file_id"])


@query("pii_switched_off", "O-PII-04", with_views("files", """
    SELECT file_id, md5(text) AS digest, CAST(0 AS INT) AS labels, false AS redacted FROM files"""))
def pii_switched_off(spark, sf_dir):
    done = privacy.redact(view(spark, sf_dir, "files"), PrivacyPolicy(enabled=False))
    return done.select(
        "file_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.size("redaction_counts").alias("labels"),
        F.col("redaction_applied").alias("redacted"),
    )


@query("pii_metadata", "O-PII-05", with_views("files", f"""{REDACTED}
    SELECT file_id, {HITS} > 0 AS chunk_flag, CASE WHEN {HITS} > 0 THEN true END AS applied,
           CASE WHEN {HITS} > 0 THEN '[REDACTED]' END AS replacement,
           CASE WHEN {HITS} > 0 THEN {HITS} END AS hits
    FROM redacted"""))
def pii_metadata(spark, sf_dir):
    """The flag of a file as it arrives at its chunks, with the struct stored for the file."""
    done = materialise(privacy.redaction_metadata(privacy.redact(view(spark, sf_dir, "files"))), "redacted")
    flags = chunks.chunk_rows(done).groupBy("file_id").agg(F.bool_or("metadata.pii_redacted").alias("chunk_flag"))
    total = F.aggregate(F.map_values("pii_redaction.counts"), F.lit(0), lambda a, x: a + x)
    return done.select(
        "file_id", F.col("pii_redaction.applied").alias("applied"),
        F.col("pii_redaction.replacement").alias("replacement"), total.alias("hits"),
    ).join(flags, "file_id")


@query("pii_audit", "O-PII-06", with_views("files", f"""{REDACTED}
    SELECT job_id, label, CAST(sum(hits) AS BIGINT) AS hits, CAST(count(*) AS BIGINT) AS files
    FROM ({HIT_ROWS}) GROUP BY job_id, label"""))
def pii_audit(spark, sf_dir):
    return privacy.redaction_audit(privacy.redact(view(spark, sf_dir, "files")))
