"""Markdown, HTML and JSON reports, and the analysis prompt.

A report lists every file of its job, and a job may have any number of files. Every report comes in the same pieces,
whatever its size: one that opens it (``piece_no`` 0), one per file, and one that closes it where the form has an end.
The texts of a job's pieces, in order and without separator, are its document. ``whole`` puts them together where a
document has to be one value; ``sinks.write_pieces`` writes them in order without that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.ordering import numbered
from logsieve.functions.text import html_escape, title_case
from logsieve.settings import NO_SUMMARY, SYSTEM_PROMPT


def _pieces(
    jobs: DataFrame, summaries: DataFrame, bucket: Column, opening: Column, file: Column, closing: Column | None,
    first: str = "", between: str = "",
) -> DataFrame:
    """``job_id, piece_no, text``. Files are numbered bucket by bucket, so no task ever holds a whole job."""
    placed = numbered(
        summaries.select("job_id", "created_at", "file_id", file.alias("_text")),
        ["job_id"], ["created_at", "file_id"], bucket, "_nth",
    )
    lead = F.when(F.col("_nth") == 1, F.lit(first)).otherwise(F.lit(between))
    pieces = jobs.select("job_id", F.lit(0).cast("long").alias("piece_no"), opening.alias("text")).unionByName(
        placed.select("job_id", F.col("_nth").cast("long").alias("piece_no"), F.concat(lead, "_text").alias("text"))
    )
    if closing is None:
        return pieces
    last = jobs.select("job_id", (F.col("files") + 1).cast("long").alias("piece_no"), closing.alias("text"))
    return pieces.unionByName(last)


def whole(pieces: DataFrame, name: str) -> DataFrame:
    """``job_id`` and the document of each job, which is one value and so has to fit a row."""
    ordered = F.sort_array(F.collect_list(F.struct("piece_no", "text")))
    return pieces.groupBy("job_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias(name))


def _lines(*parts: Column) -> Column:
    """Joined by line ends; null parts are left out."""
    return F.concat_ws("\n", *parts)


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value.cast("string"))


def prompts(jobs: DataFrame, summaries: DataFrame, bucket: Column) -> DataFrame:
    """The analysis request per job, in pieces. ``jobs``: ``job_id, mode, files``."""
    line = F.concat(
        F.lit("- "), F.col("filename"), _labelled(" (lines=", F.col("line_count")),
        _labelled(", errors=", F.col("error_count")), _labelled(", warnings=", F.col("warning_count")),
        _labelled(", critical=", F.col("critical_count")),
        F.lit(", top_keywords="), F.array_join(F.slice("top_keywords", 1, 5), ", "), F.lit(")"),
    )
    # Wording of the request.
    opening = _lines(
        _labelled("Job ID: ", F.col("job_id")), _labelled("Scenario: ", F.col("mode")), F.lit(""),
        F.lit("Provide a concise root cause assessment and remediation plan based on the following file summaries:"),
    )
    closing = F.lit("\n\nFocus on likely causes, impacted areas, and actionable remediation steps.")
    # End of fixed values.
    return _pieces(jobs, summaries, bucket, opening, line, closing, "\n", "\n")


def messages(asked: DataFrame) -> DataFrame:
    """The messages of each request (``job_id, prompt``): the system's, then the user's."""
    both = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")),
    )
    return asked.select("job_id", F.posexplode(both).alias("sequence", "m")).select("job_id", "sequence", "m.*")


def markdown_reports(jobs: DataFrame, summaries: DataFrame, bucket: Column) -> DataFrame:
    """Markdown per job, in pieces. ``jobs``: ``job_id, mode, severity, files, errors, warnings, critical, tags,
    summary, recommended_actions``."""

    def sample(title: str, column: str) -> Column:
        quoted = F.transform(column, lambda x: F.concat(F.lit("  - `"), x, F.lit("`")))
        return F.when(F.size(column) > 0, _lines(F.lit(title), F.array_join(quoted, "\n")))

    block = _lines(
        F.concat(F.lit("### "), F.col("filename")),
        F.concat(
            _labelled("- Lines: ", F.col("line_count")), _labelled(", Errors: ", F.col("error_count")),
            _labelled(", Warnings: ", F.col("warning_count")), _labelled(", Critical: ", F.col("critical_count")),
        ),
        F.when(
            F.size("top_keywords") > 0,
            F.concat(F.lit("- Top Keywords: "), F.array_join(F.slice("top_keywords", 1, 5), ", ")),
        ),
        sample("- Sample Head:", "sample_head"),
        sample("- Sample Tail:", "sample_tail"),
    )
    actions = F.array_join(F.transform("recommended_actions", lambda a: F.concat(F.lit("- "), a)), "\n")
    # Layout of the report.
    opening = _lines(
        _labelled("# RCA Summary – Job ", F.col("job_id")),
        F.lit(""),
        _labelled("- **Mode:** ", F.col("mode")),
        _labelled("- **Severity:** ", title_case(F.col("severity"))),
        _labelled("- **Files Analysed:** ", F.col("files")),
        _labelled("- **Errors:** ", F.col("errors")),
        _labelled("- **Warnings:** ", F.col("warnings")),
        _labelled("- **Critical Events:** ", F.col("critical")),
        F.when(F.size("tags") > 0, F.concat(F.lit("- **Tags:** "), F.array_join("tags", ", "))),
        F.lit(""),
        F.lit("## LLM Summary"),
        F.coalesce("summary", F.lit(NO_SUMMARY)),
        F.lit(""),
        F.lit("## Recommended Actions"),
        actions,
        F.lit(""),
        F.lit("## File Highlights"),
    )
    # End of fixed values.
    ended = F.regexp_replace(block, "(?U)[\\s\\x1c-\\x1f]+$", "")
    return _pieces(jobs, summaries, bucket, opening, ended, None, "\n", "\n\n")


def html_reports(jobs: DataFrame, summaries: DataFrame, bucket: Column) -> DataFrame:
    """HTML per job, in pieces, every value escaped; input as for Markdown."""

    def cell(value: Column) -> Column:
        return F.concat(F.lit("<td>"), value, F.lit("</td>"))

    counts = [cell(F.col(c).cast("string")) for c in ("line_count", "error_count", "warning_count", "critical_count")]
    row = F.concat(F.lit("<tr>"), cell(html_escape(F.col("filename"))), *counts, F.lit("</tr>"))

    def fact(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"<p><strong>{label}:</strong> "), value.cast("string"), F.lit("</p>"))

    tags = fact("Tags", F.array_join(F.transform("tags", html_escape), ", "))
    actions = F.array_join(
        F.transform("recommended_actions", lambda a: F.concat(F.lit("<li>"), html_escape(a), F.lit("</li>"))), ""
    )
    # Layout of the report.
    opening = F.concat(
        F.lit("<article><h1>RCA Summary – Job "), html_escape(F.col("job_id").cast("string")),
        F.lit("</h1><section>"),
        fact("Mode", html_escape(F.col("mode"))),
        fact("Severity", html_escape(title_case(F.col("severity")))),
        fact("Files Analysed", F.col("files")), fact("Errors", F.col("errors")),
        fact("Warnings", F.col("warnings")), fact("Critical Events", F.col("critical")),
        F.when(F.size("tags") > 0, tags).otherwise(""),
        F.lit("</section><section><h2>LLM Summary</h2><p>"),
        html_escape(F.coalesce("summary", F.lit(NO_SUMMARY))),
        F.lit("</p></section><section><h2>Recommended Actions</h2><ul>"), actions,
        F.lit("</ul></section><section><h2>File Highlights</h2><table><thead><tr><th>File</th><th>Lines</th>"
              "<th>Errors</th><th>Warnings</th><th>Critical</th></tr></thead><tbody>"),
    )
    closing = F.lit("</tbody></table></section></article>")
    # End of fixed values.
    return _pieces(jobs, summaries, bucket, opening, row, closing)


def json_bundles(jobs: DataFrame, summaries: DataFrame, bucket: Column, generated_at: str) -> DataFrame:
    """The structured bundle per job, in pieces: the job's fields, each file's object, the rest.

    ``llm`` (what the model gave besides the summary) and ``ticketing`` are columns of ``jobs`` where there are any.
    """
    fields = [c for c in summaries.columns if c not in ("job_id", "created_at")]
    held = F.struct("files", "lines", "errors", "warnings", "critical", "chunks")
    none = F.create_map().cast("map<string,string>")
    first = F.to_json(F.struct(
        F.col("job_id").cast("string").alias("job_id"), F.col("mode").alias("analysis_type"),
        F.lit(generated_at).alias("generated_at"), F.col("severity"), F.col("categories"), F.col("tags"),
        held.alias("metrics"),
    ))
    llm = F.col("llm") if "llm" in jobs.columns else F.struct("summary")
    ticketing = F.col("ticketing") if "ticketing" in jobs.columns else none
    rest = F.to_json(F.struct(
        F.col("summary"), llm.alias("llm"), F.col("recommended_actions"), ticketing.alias("ticketing")
    ))
    opening = F.concat(F.regexp_replace(first, "\\}$", ""), F.lit(',"files":['))
    closing = F.concat(F.lit("],"), F.regexp_replace(rest, "^\\{", ""))
    return _pieces(jobs, summaries, bucket, opening, F.to_json(F.struct(*fields)), closing, "", ",")
