"""Queries over line profiles, job findings, reports and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsieve.functions.ordering import time_bucket
from logsieve.operators import chunks, privacy, profiling, reports, rollup
from logsieve.plans.ingest import HITS, REDACTED
from logsieve.plans.registry import query
from logsieve.plans.views import table, view, with_views
from logsieve.session import materialise, scratch_dir
from logsieve.sources import sinks

_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{0085}\\x{2028}\\x{2029}]"


def split_sql(text: str) -> str:
    """Lines of a text in DuckDB."""
    parts = f"regexp_split_to_array({text}, '{_BREAK}')"
    return f"CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END"


def digest(column) -> F.Column:
    return F.md5(column.cast("binary"))


_SIGNALS = """CAST(count(*) AS BIGINT) AS line_count,
    CAST(count(*) FILTER (contains(lower(line), 'error')) AS BIGINT) AS error_count,
    CAST(count(*) FILTER (contains(lower(line), 'warning')) AS BIGINT) AS warning_count,
    CAST(count(*) FILTER (contains(lower(line), 'critical')) AS BIGINT) AS critical_count,
    CAST(count(*) FILTER (contains(lower(line), 'info')) AS BIGINT) AS info_count"""
_SEVERITY = """CASE WHEN critical > 0 THEN 'critical' WHEN errors > 0 THEN 'high' WHEN warnings > 0 THEN 'moderate'
    ELSE 'low' END"""


@query("log_severity", "O-LOG-02 O-LOG-08 O-LOG-09", with_views("lines", f"""
    , f AS (SELECT file_id, strftime(ts, '%Y-%m-%d') AS day, {_SIGNALS} FROM lines GROUP BY ALL),
      m AS (SELECT file_id, day, line_count AS lines, error_count AS errors, warning_count AS warnings,
                   critical_count AS critical FROM f)
    SELECT *, {_SEVERITY} AS severity FROM m"""))
def log_severity(spark, sf_dir):
    """Severity of each file and day; all four levels occur."""
    lines = view(spark, sf_dir, "lines").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    counted = profiling.signal_counts(lines, ["file_id", "day"])
    totals = rollup.job_metrics(counted, ["file_id", "day"]).drop("files", "chunks")
    return rollup.add_severity(totals)


@query("log_split_lines", "O-LOG-01", with_views("files", f"""
    , l AS (SELECT file_id, unnest({split_sql("text")}) AS line FROM files)
    SELECT file_id, CAST(count(*) AS BIGINT) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars,
           CAST(max(length(line)) AS INT) AS longest FROM l GROUP BY file_id"""))
def log_split_lines(spark, sf_dir):
    lines = profiling.to_lines(view(spark, sf_dir, "files").select("file_id", "text"))
    return lines.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"),
        F.max(F.length("line")).alias("longest"),
    )


@query("log_line_count", "O-LOG-03", with_views("files", f"""
    SELECT file_id, CAST(len({split_sql("text")}) AS INT) AS line_count FROM files"""))
def log_line_count(spark, sf_dir):
    return profiling.profile_texts(view(spark, sf_dir, "files")).select("file_id", "line_count")


@query("log_signal_counts", "O-LOG-02", with_views("lines", f"""
    SELECT job_id, file_id, {_SIGNALS} FROM lines GROUP BY job_id, file_id"""))
def log_signal_counts(spark, sf_dir):
    return profiling.signal_counts(view(spark, sf_dir, "lines"), ["job_id", "file_id"])


@query("log_text_signals", "O-LOG-02", f"""
    WITH p AS (SELECT page_id, unnest({split_sql("html")}) AS line FROM pages)
    SELECT page_id AS file_id, {_SIGNALS.replace("BIGINT", "INT")} FROM p GROUP BY page_id""")
def log_text_signals(spark, sf_dir):
    """The same on whole texts, without exploding them: pages as uploaded files."""
    texts = table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.col("html").alias("text"))
    counts = [f"{c}_count" for c in ("line", "error", "warning", "critical", "info")]
    return profiling.profile_texts(texts).select("file_id", *counts)


@query("log_keywords", "O-LOG-04", with_views("files", """
    , w AS (SELECT job_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM files)
    SELECT job_id, word, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY job_id, word"""))
def log_keywords(spark, sf_dir):
    words = profiling.words_of_texts(view(spark, sf_dir, "files"), ["job_id"])
    return profiling.keyword_counts(words, ["job_id"]).select("job_id", "word", "n")


_TOP_WORDS = """
    , w AS (SELECT file_id, unnest(words) AS word, generate_subscripts(words, 1) AS place
            FROM (SELECT file_id, regexp_extract_all(lower(text), '[a-z]{4,}') AS words FROM SOURCE)),
      c AS (SELECT file_id, word, count(*) AS n, min(place) AS first_place FROM w GROUP BY file_id, word),
      k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, first_place) AS rank FROM c),
      keywords AS (SELECT file_id, list(word ORDER BY rank) AS top_keywords FROM k WHERE rank <= 10 GROUP BY file_id)"""


@query("log_top_keywords", "O-LOG-05", with_views("files", f"""{_TOP_WORDS.replace("SOURCE", "files")}
    SELECT file_id, word, CAST(n AS BIGINT) AS n, CAST(rank AS INT) AS rank FROM k WHERE rank <= 10"""))
def log_top_keywords(spark, sf_dir):
    return profiling.top_text_keywords(view(spark, sf_dir, "files"), ["file_id"]).select("file_id", "word", "n", "rank")


@query("log_line_keywords", "O-LOG-05", with_views("lines", """
    , w AS (SELECT file_id, line_no, unnest(words) AS word, generate_subscripts(words, 1) AS place
            FROM (SELECT file_id, line_no, regexp_extract_all(lower(line), '[a-z]{4,}') AS words FROM lines)),
      c AS (SELECT file_id, word, count(*) AS n, min((line_no, place)) AS first_place FROM w GROUP BY file_id, word),
      k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, first_place) AS rank FROM c)
    SELECT file_id, word, CAST(n AS BIGINT) AS n, CAST(rank AS INT) AS rank FROM k WHERE rank <= 10"""))
def log_line_keywords(spark, sf_dir):
    words = profiling.words_of_lines(view(spark, sf_dir, "lines"), ["file_id"])
    return profiling.top_keywords(words, ["file_id"]).select("file_id", "word", "n", "rank")


@query("log_sketched_keywords", "O-LOG-05", with_views("files", """
    , w AS (SELECT job_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM files),
      c AS (SELECT job_id, word, count(*) AS n, sum(count(*)) OVER (PARTITION BY job_id) AS words FROM w GROUP BY job_id, word)
    SELECT job_id, word, CAST(n AS BIGINT) AS n, CAST(words AS BIGINT) AS words, true AS exact FROM c WHERE 500 * n >= words"""))
def log_sketched_keywords(spark, sf_dir):
    """Words that are two in a thousand of a job's, from sketches kept per hour and combined."""
    texts = view(spark, sf_dir, "files").withColumn("hour", F.date_format("created_at", "yyyy-MM-dd-HH"))
    path = scratch_dir(spark, "sketches")
    made = profiling.keyword_sketches(profiling.words_of_texts(texts, ["job_id", "hour"]), ["job_id", "hour"], 200_000)
    sinks.write_table(made, path, ["hour"])
    kept = profiling.combine_sketches(spark.read.parquet(path), ["job_id"], 200_000)
    return profiling.sketched_keywords(kept, ["job_id"], 500, 200_000).where("500 * n >= words")


@query("log_samples", "O-LOG-06", with_views("files", f"""
    , l AS (SELECT file_id, {split_sql("text")} AS lines FROM files)
    SELECT file_id, md5(array_to_string(lines[1:5], chr(10))) AS head,
           CASE WHEN len(lines) > 5 THEN md5(array_to_string(lines[-5:], chr(10))) ELSE md5('') END AS tail FROM l"""))
def log_samples(spark, sf_dir):
    profiled = profiling.profile_texts(view(spark, sf_dir, "files"))
    return profiled.select(
        "file_id", digest(F.array_join("sample_head", "\n")).alias("head"),
        digest(F.array_join("sample_tail", "\n")).alias("tail"),
    )


@query("log_line_samples", "O-LOG-06", with_views("lines", """
    , l AS (SELECT file_id, list(line ORDER BY line_no) AS lines FROM lines GROUP BY file_id)
    SELECT file_id, array_to_string(lines[1:5], chr(10)) AS head,
           CASE WHEN len(lines) > 5 THEN array_to_string(lines[-5:], chr(10)) ELSE '' END AS tail FROM l"""))
def log_line_samples(spark, sf_dir):
    samples = profiling.line_samples(view(spark, sf_dir, "lines"), ["file_id"])
    return samples.select(
        "file_id", F.array_join("sample_head", "\n").alias("head"), F.array_join("sample_tail", "\n").alias("tail")
    )


def _summaries(spark, sf_dir):
    """File summaries of the documents: redacted, profiled, chunks counted.

    The redacted text is written once, as profile and keywords both read it.
    """
    given = view(spark, sf_dir, "files").drop("lang").withColumns({
        "checksum": F.sha2("text", 256), "content_type": F.lit("text/plain"),
    })
    done = materialise(privacy.redact(given), "redacted")
    sized = done.withColumns({
        "file_size": F.octet_length("text"),
        "chunk_count": chunks.count_chunks(F.col("text")),
    })
    return profiling.file_summaries(sized)


_CHUNKED = f"""
    , ln AS (SELECT file_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i
             FROM (SELECT file_id, {split_sql("text")} AS lines FROM SOURCE)),
      cum AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY file_id ORDER BY i) AS upto,
                     count(*) OVER (PARTITION BY file_id) AS n FROM ln),
      packed AS (
        SELECT file_id, 0 AS chunk_index, 1::BIGINT AS s, coalesce(min(i) FILTER (upto >= 2000), max(n))::BIGINT AS e,
               max(n)::BIGINT AS n FROM cum GROUP BY file_id
        UNION ALL
        SELECT p.file_id, max(p.chunk_index) + 1, max(p.e)::BIGINT + 1,
               coalesce(min(c.i) FILTER (c.upto - b.upto >= 2000), max(p.n))::BIGINT, max(p.n)
        FROM packed p JOIN cum b ON b.file_id = p.file_id AND b.i = p.e
             JOIN cum c ON c.file_id = p.file_id AND c.i > p.e
        WHERE p.e < p.n GROUP BY p.file_id),
      chunked AS (
        SELECT p.file_id, p.chunk_index, array_to_string(list(c.line ORDER BY c.i), chr(10)) AS content
        FROM packed p JOIN cum c ON c.file_id = p.file_id AND c.i BETWEEN p.s AND p.e GROUP BY p.file_id, p.chunk_index)"""

# summary of every redacted document
_SUMMARY_SQL = f"""{REDACTED}{_TOP_WORDS.replace("SOURCE", "redacted")}{_CHUNKED.replace("SOURCE", "redacted")},
      summaries AS (
        SELECT r.*, lines, CAST(len(lines) AS INT) AS line_count, coalesce(top_keywords, []) AS top_keywords,
               CAST(len(list_filter(lines, lambda x: contains(lower(x), 'error'))) AS INT) AS error_count,
               CAST(len(list_filter(lines, lambda x: contains(lower(x), 'warning'))) AS INT) AS warning_count,
               CAST(len(list_filter(lines, lambda x: contains(lower(x), 'critical'))) AS INT) AS critical_count,
               CAST(len(list_filter(lines, lambda x: contains(lower(x), 'info'))) AS INT) AS info_count,
               lines[1:5] AS sample_head, CASE WHEN len(lines) > 5 THEN lines[-5:] ELSE [] END AS sample_tail,
               CAST(chunk_count AS INT) AS chunk_count
        FROM (SELECT *, {split_sql("text")} AS lines FROM redacted) r LEFT JOIN keywords USING (file_id)
             JOIN (SELECT file_id, count(*) AS chunk_count FROM chunked GROUP BY file_id) USING (file_id))"""


@query("log_file_summary", "O-LOG-07 O-CHK-03", with_views("files", f"""{_SUMMARY_SQL}
    SELECT file_id, filename, CAST(octet_length(encode(text)) AS INT) AS file_size, line_count, error_count, warning_count,
           critical_count, info_count, chunk_count, array_to_string(top_keywords, ',') AS top_keywords,
           md5(array_to_string(sample_head, chr(10))) AS head, md5(array_to_string(sample_tail, chr(10))) AS tail,
           {HITS} > 0 AS redaction_applied, sha256(f.text) AS checksum, 'text/plain' AS content_type
    FROM summaries JOIN (SELECT file_id, text FROM files) f USING (file_id)""".replace("encode(text)", "encode(summaries.text)"), recursive=True))
def log_file_summary(spark, sf_dir):
    made = profiling.analysis_metadata(_summaries(spark, sf_dir))
    return made.select(
        "file_id", "filename", "file_size", "analysis_summary.line_count", "error_count", "warning_count",
        "critical_count", "info_count", "chunk_count",
        F.array_join("analysis_summary.top_keywords", ",").alias("top_keywords"),
        digest(F.array_join("sample_head", "\n")).alias("head"), digest(F.array_join("sample_tail", "\n")).alias("tail"),
        "redaction_applied", "checksum", "content_type",
    )


_LINE_FILES = f"""
    , f AS (SELECT job_id, file_id, min(ts) AS created_at, {_SIGNALS} FROM lines GROUP BY job_id, file_id)"""
_LINE_JOBS = f"""{_LINE_FILES},
      m AS (SELECT job_id, CAST(count(*) AS BIGINT) AS files, CAST(sum(line_count) AS BIGINT) AS lines,
                   CAST(sum(error_count) AS BIGINT) AS errors, CAST(sum(warning_count) AS BIGINT) AS warnings,
                   CAST(sum(critical_count) AS BIGINT) AS critical, CAST(0 AS BIGINT) AS chunks FROM f GROUP BY job_id)"""


def _line_files(spark, sf_dir):
    return profiling.signal_counts(view(spark, sf_dir, "lines"), ["job_id", "file_id"])


@query("log_job_metrics", "O-LOG-08", with_views("lines", f"{_LINE_JOBS} SELECT * FROM m"))
def log_job_metrics(spark, sf_dir):
    return rollup.job_metrics(_line_files(spark, sf_dir))


@query("log_categories", "O-LOG-10", with_views("outcomes", f"""
    SELECT job_id, {_SEVERITY} AS severity, array_to_string(list_sort(list_distinct(list_filter(['log_analysis', 'rca',
             CASE WHEN critical > 0 THEN 'priority-incident' END, CASE WHEN errors > 0 THEN 'error-detected' END,
             CASE WHEN warnings > 0 THEN 'warning-detected' END], lambda x: x IS NOT NULL))), ',') AS categories
    FROM outcomes"""))
def log_categories(spark, sf_dir):
    rated = rollup.add_severity(view(spark, sf_dir, "outcomes"))
    return rated.select(
        "job_id", "severity", F.array_join(rollup.categories(F.lit("log_analysis")), ",").alias("categories")
    )


_TAGS = """
      tagged AS (SELECT DISTINCT job_id, unnest(top_keywords[1:3]) AS word FROM OF),
      tags AS (SELECT job_id, list_sort(list(word))[1:10] AS tags FROM tagged GROUP BY job_id)"""


@query("log_tags", "O-LOG-11", with_views("files", f"""{_TOP_WORDS.replace("SOURCE", "files")},
      s AS (SELECT * FROM files JOIN keywords USING (file_id)), {_TAGS.replace("OF", "s")}
    SELECT job_id, array_to_string(tags, ',') AS tags FROM tags"""))
def log_tags(spark, sf_dir):
    texts = view(spark, sf_dir, "files")
    keywords = profiling.ranked_lists(profiling.top_text_keywords(texts, ["file_id"]), ["file_id"])
    tagged = rollup.job_tags(texts.select("job_id", "file_id").join(keywords, "file_id"))
    return tagged.select("job_id", F.array_join("tags", ",").alias("tags"))


@query("log_suspected_files", "O-LOG-12", with_views("outcomes", """
    SELECT file_id AS job_id, concat(day, '.log') AS filename FROM outcomes WHERE errors > 0 OR critical > 0"""))
def log_suspected_files(spark, sf_dir):
    """Each day of a file as a log of its own."""
    days = view(spark, sf_dir, "outcomes").select(
        F.col("file_id").alias("job_id"), F.col("job_id").alias("file_id"), F.col("day").alias("created_at"),
        F.concat("day", F.lit(".log")).alias("filename"), F.col("errors").alias("error_count"),
        F.col("critical").alias("critical_count"),
    )
    return rollup.suspected_error_logs(days).select("job_id", "filename")


_BULLETED = "replace(replace(text, ', ', chr(10) || ' - '), '. ', chr(10) || '* ')"


@query("log_actions", "O-LOG-13", with_views("files", f"""
    , l AS (SELECT file_id, list_transform({split_sql(_BULLETED)}, lambda x: trim(x, ' ' || chr(9))) AS lines FROM files),
      a AS (SELECT file_id, list_filter(list_transform(list_filter(lines, lambda x: x[1] IN ('-', '*')),
                   lambda x: trim(ltrim(x, '-* '), ' ' || chr(9))), lambda x: x <> '') AS actions FROM l)
    SELECT file_id, CAST(greatest(len(actions), 1) AS INT) AS n, md5(CASE WHEN len(actions) = 0
           THEN 'Review the generated summary and log excerpts for next steps.' ELSE array_to_string(actions, chr(10)) END) AS digest
    FROM a"""))
def log_actions(spark, sf_dir):
    """Documents as summaries, their clauses turned into bullet lines."""
    bulleted = F.replace(F.replace(F.col("text"), F.lit(", "), F.lit("\n - ")), F.lit(". "), F.lit("\n* "))
    found = view(spark, sf_dir, "files").select("file_id", rollup.recommended_actions(bulleted).alias("actions"))
    return found.select("file_id", F.size("actions").alias("n"), digest(F.array_join("actions", "\n")).alias("digest"))


@query("jobs_without_input", "O-LOG-18", with_views("jobs", """
    SELECT job_id, CASE WHEN job_type = 'embedding_generation' THEN 'No documents available to embed'
                        ELSE 'No files uploaded for analysis' END AS reject_reason
    FROM jobs WHERE job_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)"""))
def jobs_without_input(spark, sf_dir):
    children = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"))
    empty = rollup.jobs_without_input(view(spark, sf_dir, "jobs"), children, children)
    return empty.select("job_id", "reject_reason")


@query("log_lifecycle", "O-LOG-20", with_views("files", f"""{_SUMMARY_SQL},
      per_job AS (SELECT job_id, count(*) AS files, sum(chunk_count) AS chunks FROM summaries GROUP BY job_id),
      mode AS (SELECT '"mode":"log-analysis",' AS m)
    SELECT job_id, 1 AS phase_order, NULL AS file_id, 'analysis-phase' AS event_type,
           '{{"phase":"ingestion",' || m || '"status":"started"}}' AS data FROM per_job, mode
    UNION ALL SELECT job_id, 4, NULL, 'analysis-phase', '{{"phase":"ingestion",' || m || '"status":"completed","files":' || files
           || ',"chunks":' || chunks || '}}' FROM per_job, mode
    UNION ALL SELECT job_id, 5, NULL, 'analysis-phase', '{{"phase":"llm",' || m || '"status":"started"}}' FROM per_job, mode
    UNION ALL SELECT job_id, 6, NULL, 'analysis-phase', '{{"phase":"llm",' || m || '"status":"completed"}}' FROM per_job, mode
    UNION ALL SELECT job_id, 2, CAST(file_id AS VARCHAR), 'file-processing-started', '{{"file_id":' || file_id || ',"filename":"'
           || filename || '","size":' || octet_length(encode(text)) || '}}' FROM summaries
    UNION ALL SELECT job_id, 3, CAST(file_id AS VARCHAR), 'file-processing-completed', '{{"file_id":' || file_id || ',"filename":"'
           || filename || '","chunks":' || chunk_count || ',"errors":' || error_count || ',"warnings":' || warning_count
           || ',"critical":' || critical_count || ',"pii_redacted":' || ({HITS} > 0) || ',"redaction_hits":{{'
           || concat_ws(',', CASE WHEN email > 0 THEN '"email":' || email END, CASE WHEN phone > 0 THEN '"phone":' || phone END,
                CASE WHEN ssn > 0 THEN '"ssn":' || ssn END, CASE WHEN credit_card > 0 THEN '"credit_card":' || credit_card END,
                CASE WHEN ip_address > 0 THEN '"ip_address":' || ip_address END) || '}}}}' FROM summaries""", recursive=True))
def log_lifecycle(spark, sf_dir):
    made = materialise(_summaries(spark, sf_dir), "summaries")
    return rollup.lifecycle_events(made, rollup.job_metrics(made), "log_analysis")


# ---- reports ------------------------------------------------------------------------------------


def report_inputs(spark, sf_dir):
    """Log files as jobs of files: rows for the jobs and for their files.

    The summaries, one row per file, are written once: jobs, tags and every report read them.
    """
    lines = view(spark, sf_dir, "lines")
    born = lines.groupBy("job_id", "file_id").agg(F.min("ts").alias("created_at"))
    made = (
        profiling.line_file_summaries(lines, ["job_id", "file_id"])
        .join(born, ["job_id", "file_id"])
        .withColumns({
            "filename": F.concat(F.lit("node <"), "file_id", F.lit(">.log")), "chunk_count": F.lit(1),
        })
    )
    made = materialise(made, "summaries")
    advice = F.lit("Signals & causes:\n- Check the <error> handler\n* Watch 'signup' warnings")
    jobs = (
        rollup.add_severity(rollup.job_metrics(made))
        .join(rollup.job_tags(made), "job_id", "left")
        .withColumns({
            "mode": F.lit("log_analysis"),
            "summary": advice,
            "recommended_actions": rollup.recommended_actions(advice),
        })
    )
    return jobs.withColumn("categories", rollup.categories(F.col("mode"))), made


REPORT_SQL = f"""
    , w AS (SELECT file_id, line_no, unnest(words) AS word, generate_subscripts(words, 1) AS place
            FROM (SELECT file_id, line_no, regexp_extract_all(lower(line), '[a-z]{{4,}}') AS words FROM lines)),
      c AS (SELECT file_id, word, count(*) AS n, min((line_no, place)) AS first_place FROM w GROUP BY file_id, word),
      k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, first_place) AS rank FROM c),
      keywords AS (SELECT file_id, list(word ORDER BY rank) AS top_keywords FROM k WHERE rank <= 10 GROUP BY file_id),
      f AS (SELECT job_id, file_id, min(ts) AS created_at, list(line ORDER BY line_no) AS lines, {_SIGNALS}
            FROM lines GROUP BY job_id, file_id),
      s AS (SELECT *, 'node <' || file_id || '>.log' AS filename, lines[1:5] AS head,
                   CASE WHEN len(lines) > 5 THEN lines[-5:] ELSE [] END AS tail,
                   row_number() OVER (PARTITION BY job_id ORDER BY created_at, file_id) - 1 AS nth
            FROM f JOIN keywords USING (file_id)), {_TAGS.replace("OF", "s")},
      m AS (SELECT job_id, count(*) AS files, sum(line_count) AS lines, sum(error_count) AS errors,
                   sum(warning_count) AS warnings, sum(critical_count) AS critical FROM s GROUP BY job_id),
      j AS (SELECT m.*, tags, {_SEVERITY} AS severity FROM m JOIN tags USING (job_id)),
      listed AS (SELECT job_id, list(BLOCK ORDER BY nth) AS blocks FROM s GROUP BY job_id),
      p AS (SELECT * FROM listed JOIN j USING (job_id))"""
_ADVICE_SQL = "'Signals & causes:' || chr(10) || '- Check the <error> handler' || chr(10) || '* Watch ''signup'' warnings'"
_TITLED = "upper(severity[1]) || severity[2:]"


def _report_sql(block: str, body: str) -> str:
    return with_views("lines", REPORT_SQL.replace("BLOCK", block) + body)


@query("log_prompt", "O-LOG-14", _report_sql(
    """'- ' || filename || ' (lines=' || line_count || ', errors=' || error_count || ', warnings=' || warning_count
       || ', critical=' || critical_count || ', top_keywords=' || array_to_string(top_keywords[1:5], ', ') || ')'""",
    """SELECT job_id, 'Job ID: ' || job_id || chr(10) || 'Scenario: log_analysis'
           || chr(10) || chr(10) || 'Provide a concise root cause assessment and remediation plan based on the following file summaries:'
           || chr(10) || array_to_string(blocks, chr(10)) || chr(10) || chr(10)
           || 'Focus on likely causes, impacted areas, and actionable remediation steps.' AS prompt FROM p"""))
def log_prompt(spark, sf_dir):
    jobs, made = report_inputs(spark, sf_dir)
    return reports.whole(reports.prompts(jobs, made, time_bucket("created_at")), "prompt")


@query("report_pieces", "O-LOG-14", _report_sql(
    """'- ' || filename || ' (lines=' || line_count || ', errors=' || error_count || ', warnings=' || warning_count
       || ', critical=' || critical_count || ', top_keywords=' || array_to_string(top_keywords[1:5], ', ') || ')'""",
    """SELECT job_id, CAST(unnest(range(0, len(x))) AS BIGINT) AS piece_no, md5(unnest(x)) AS digest FROM (SELECT job_id, list_concat(
             ['Job ID: ' || job_id || chr(10) || 'Scenario: log_analysis' || chr(10) || chr(10)
              || 'Provide a concise root cause assessment and remediation plan based on the following file summaries:'],
             list_transform(blocks, lambda b: chr(10) || b),
             [chr(10) || chr(10) || 'Focus on likely causes, impacted areas, and actionable remediation steps.']) AS x FROM p)"""))
def report_pieces(spark, sf_dir):
    """The prompt of every job written in pieces, which no task has to hold together, and read back."""
    jobs, made = report_inputs(spark, sf_dir)
    path = scratch_dir(spark, "pieces")
    sinks.write_pieces(reports.prompts(jobs, made, time_bucket("created_at")), path)
    return spark.read.parquet(path).select("job_id", "piece_no", digest(F.col("text")).alias("digest"))


@query("report_markdown", "O-LOG-15", _report_sql(
    """concat_ws(chr(10), '### ' || filename, '- Lines: ' || line_count || ', Errors: ' || error_count || ', Warnings: '
       || warning_count || ', Critical: ' || critical_count, '- Top Keywords: ' || array_to_string(top_keywords[1:5], ', '),
       '- Sample Head:', array_to_string(list_transform(head, lambda x: '  - `' || x || '`'), chr(10)),
       CASE WHEN len(tail) > 0 THEN '- Sample Tail:' || chr(10)
            || array_to_string(list_transform(tail, lambda x: '  - `' || x || '`'), chr(10)) END, '')""",
    f"""SELECT job_id, rtrim(t, chr(10)) AS markdown FROM (
        SELECT *, concat_ws(chr(10), '# RCA Summary – Job ' || job_id, '', '- **Mode:** log_analysis',
          '- **Severity:** ' || {_TITLED}, '- **Files Analysed:** ' || files, '- **Errors:** ' || errors,
          '- **Warnings:** ' || warnings, '- **Critical Events:** ' || critical, '- **Tags:** ' || array_to_string(tags, ', '),
          '', '## LLM Summary', 'Signals & causes:', '- Check the <error> handler', '* Watch ''signup'' warnings', '',
          '## Recommended Actions', '- Check the <error> handler', '- Watch ''signup'' warnings', '', '## File Highlights', '')
          || array_to_string(blocks, chr(10)) AS t FROM p)"""))
def report_markdown(spark, sf_dir):
    jobs, made = report_inputs(spark, sf_dir)
    return reports.whole(reports.markdown_reports(jobs, made, time_bucket("created_at")), "markdown")


@query("report_html", "O-LOG-16", _report_sql(
    """'<tr><td>' || replace(replace(filename, '<', '&lt;'), '>', '&gt;') || '</td><td>' || line_count || '</td><td>'
       || error_count || '</td><td>' || warning_count || '</td><td>' || critical_count || '</td></tr>'""",
    f"""SELECT job_id, '<article><h1>RCA Summary – Job ' || job_id || '</h1><section>'
          || '<p><strong>Mode:</strong> log_analysis</p><p><strong>Severity:</strong> ' || {_TITLED} || '</p>'
          || '<p><strong>Files Analysed:</strong> ' || files || '</p><p><strong>Errors:</strong> ' || errors || '</p>'
          || '<p><strong>Warnings:</strong> ' || warnings || '</p><p><strong>Critical Events:</strong> ' || critical || '</p>'
          || '<p><strong>Tags:</strong> ' || array_to_string(tags, ', ') || '</p></section><section><h2>LLM Summary</h2><p>'
          || 'Signals &amp; causes:' || chr(10) || '- Check the &lt;error&gt; handler' || chr(10)
          || '* Watch &#x27;signup&#x27; warnings</p></section><section><h2>Recommended Actions</h2><ul>'
          || '<li>Check the &lt;error&gt; handler</li><li>Watch &#x27;signup&#x27; warnings</li></ul></section>'
          || '<section><h2>File Highlights</h2><table><thead><tr><th>File</th><th>Lines</th><th>Errors</th><th>Warnings</th>'
          || '<th>Critical</th></tr></thead><tbody>' || array_to_string(blocks, '')
          || '</tbody></table></section></article>' AS html FROM p"""))
def report_html(spark, sf_dir):
    jobs, made = report_inputs(spark, sf_dir)
    return reports.whole(reports.html_reports(jobs, made, time_bucket("created_at")), "html")


@query("report_json", "O-LOG-17", _report_sql(
    "filename || ':' || line_count || ':' || error_count || ':' || array_to_string(top_keywords, ' ')",
    f"""SELECT CAST(job_id AS VARCHAR) AS job_id, 'log_analysis' AS analysis_type, '2024-02-01T00:00:00+00:00' AS generated_at,
              severity, CAST(files AS BIGINT) AS n_files, CAST(lines AS BIGINT) AS n_lines, CAST(errors AS BIGINT) AS errors,
              CAST(warnings AS BIGINT) AS warnings, CAST(critical AS BIGINT) AS critical, array_to_string(tags, ',') AS tags,
              array_to_string(blocks, ',') AS files, {_ADVICE_SQL} AS summary, 'openai' AS llm_provider, 'large' AS llm_model,
              {_ADVICE_SQL} AS llm_summary, 'Check the <error> handler,Watch ''signup'' warnings' AS actions FROM p"""))
def report_json(spark, sf_dir):
    """The whole bundle, read back field by field."""
    jobs, made = report_inputs(spark, sf_dir)
    jobs = jobs.withColumn("llm", F.struct(F.lit("openai").alias("provider"), F.lit("large").alias("model"), "summary"))
    pieces = reports.json_bundles(jobs, made, time_bucket("created_at"), "2024-02-01T00:00:00+00:00")
    read = F.from_json(
        "json",
        "job_id string, analysis_type string, severity string, generated_at string, tags array<string>, "
        "metrics struct<files: long, lines: long, errors: long, warnings: long, critical: long>, "
        "files array<struct<filename: string, line_count: long, error_count: long, top_keywords: array<string>>>, "
        "summary string, llm struct<provider: string, model: string, summary: string>, recommended_actions array<string>",
    )
    named = F.transform("r.files", lambda f: F.concat_ws(
        ":", f["filename"], f["line_count"], f["error_count"], F.array_join(f["top_keywords"], " ")
    ))
    return reports.whole(pieces, "json").select(read.alias("r")).select(
        "r.job_id", "r.analysis_type", "r.generated_at", "r.severity", F.col("r.metrics.files").alias("n_files"),
        F.col("r.metrics.lines").alias("n_lines"), "r.metrics.errors", "r.metrics.warnings", "r.metrics.critical",
        F.array_join("r.tags", ",").alias("tags"), F.array_join(named, ",").alias("files"), "r.summary",
        F.col("r.llm.provider").alias("llm_provider"), F.col("r.llm.model").alias("llm_model"),
        F.col("r.llm.summary").alias("llm_summary"), F.array_join("r.recommended_actions", ",").alias("actions"),
    )


# ---- chunks -------------------------------------------------------------------------------------


@query("chunk_lines", "O-CHK-01 O-CHK-02", with_views("files", f"""{_CHUNKED.replace("SOURCE", "files")}
    SELECT file_id, CAST(chunk_index AS INT) AS chunk_index, md5(content) AS digest, CAST(length(content) AS INT) AS chunk_size
    FROM chunked""", recursive=True))
def chunk_lines(spark, sf_dir):
    rows = chunks.chunk_rows(view(spark, sf_dir, "files"))
    return rows.select("file_id", "chunk_index", digest(F.col("content")).alias("digest"), "chunk_size")


@query("sink_chunk_table", "O-SRC-11", with_views("files", f"""{REDACTED}{_CHUNKED.replace("SOURCE", "redacted")}
    SELECT job_id, file_id, CAST(chunk_index AS INT) AS chunk_index, CAST(length(content) AS INT) AS chunk_size, md5(content) AS digest
    FROM chunked JOIN redacted USING (file_id)""", recursive=True))
def sink_chunk_table(spark, sf_dir):
    """Chunks of the redacted files written as a table with a bounded number of folders and files, and read back."""
    path = scratch_dir(spark, "chunks")
    made = sinks.with_job_bucket(chunks.chunk_rows(privacy.redact(view(spark, sf_dir, "files"))), 16)
    sinks.write_table(made, path, ["job_bucket"], spread_by="file_id")
    return spark.read.parquet(path).select(
        "job_id", "file_id", "chunk_index", "chunk_size", digest(F.col("content")).alias("digest")
    )


@query("sink_file_table", "O-SRC-11", with_views("files", f"""{_SUMMARY_SQL}
    SELECT job_id, summaries.file_id, filename, line_count, error_count, chunk_count, {HITS} > 0 AS redaction_applied, sha256(f.text) AS checksum
    FROM summaries JOIN (SELECT file_id, text FROM files) f USING (file_id)""", recursive=True))
def sink_file_table(spark, sf_dir):
    """What is known of every file written as a table beside the chunks, and read back."""
    path = scratch_dir(spark, "file-metadata")
    made = sinks.with_job_bucket(profiling.analysis_metadata(_summaries(spark, sf_dir)), 16)
    sinks.write_table(made, path, ["job_bucket"], spread_by="file_id")
    return spark.read.parquet(path).select(
        "job_id", "file_id", "filename", "analysis_summary.line_count", "error_count", "chunk_count", "redaction_applied", "checksum"
    )


@query("chunk_counts", "O-CHK-03", with_views("files", f"""{_CHUNKED.replace("SOURCE", "files")}
    SELECT job_id, CAST(count(*) AS BIGINT) AS chunk_count FROM chunked JOIN files USING (file_id) GROUP BY job_id""",
    recursive=True))
def chunk_counts(spark, sf_dir):
    return chunks.chunk_counts(chunks.chunk_rows(view(spark, sf_dir, "files")), ["job_id"])
