"""Queries over conversations, model usage and inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsieve.functions.ordering import block_bucket, time_bucket
from logsieve.operators import conversations, inference, reports
from logsieve.plans import findings
from logsieve.plans.registry import query
from logsieve.plans.views import view, with_views

_APPENDED = """
    , n AS (SELECT t.*, coalesce(l.last, 0) + row_number() OVER (PARTITION BY job_id ORDER BY sequence) AS seq
            FROM turns t LEFT JOIN (SELECT job_id, max(sequence) AS last FROM turns WHERE role <> 'assistant'
                 GROUP BY job_id) l USING (job_id) WHERE role = 'assistant')"""


def _appended(spark, sf_dir):
    """Answers appended behind what was said before."""
    turns = view(spark, sf_dir, "turns")
    answers = turns.where("role = 'assistant'").withColumnRenamed("sequence", "said_at")
    return conversations.append_turns(turns.where("role <> 'assistant'"), answers, "said_at", block_bucket("said_at", 4))


@query("turns_append", "O-CNV-01", with_views("turns", f"{_APPENDED} SELECT job_id, sequence AS said_at, seq AS sequence FROM n"))
def turns_append(spark, sf_dir):
    return _appended(spark, sf_dir).select("job_id", "said_at", "sequence")


@query("turns_conversation", "O-CNV-02", with_views("turns", """
    , r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY sequence) AS nth FROM turns)
    SELECT job_id, sequence, role, md5(content) AS digest FROM r WHERE nth <= 3"""))
def turns_conversation(spark, sf_dir):
    kept = conversations.conversation(view(spark, sf_dir, "turns"), limit=3)
    return kept.select("job_id", "sequence", "role", F.md5(F.col("content").cast("binary")).alias("digest"))


@query("turns_append_events", "O-CNV-03", with_views("turns", """
    SELECT job_id, sequence // 2 AS call, CAST(count(*) AS BIGINT) AS count, max(sequence) AS latest_sequence,
           'conversation-turn' AS event_type, string_agg(role, ',' ORDER BY sequence) AS roles
    FROM turns GROUP BY job_id, sequence // 2"""))
def turns_append_events(spark, sf_dir):
    """Question and answer as one call."""
    calls = view(spark, sf_dir, "turns").withColumn("call", F.floor(F.col("sequence") / 2))
    return conversations.append_events(calls, ["call"]).withColumn("roles", F.array_join("roles", ","))


@query("tokens_estimate", "O-CNV-04", with_views("turns", """
    SELECT job_id, sequence, CAST(length(content) // 4 AS BIGINT) AS tokens FROM turns"""))
def tokens_estimate(spark, sf_dir):
    return view(spark, sf_dir, "turns").select(
        "job_id", "sequence", conversations.estimate_tokens(F.col("content")).alias("tokens")
    )


@query("usage_normalise", "O-CNV-05", with_views("model_calls", """
    SELECT event_id, CASE WHEN status = 'error' THEN 0 ELSE asked END AS prompt_tokens,
           CASE WHEN status = 'error' THEN 0 ELSE told END AS completion_tokens,
           CASE WHEN status = 'error' THEN 0 ELSE asked + told END AS total_tokens FROM model_calls"""))
def usage_normalise(spark, sf_dir):
    calls = conversations.normalise_usage(view(spark, sf_dir, "model_calls"))
    return calls.select("event_id", "prompt_tokens", "completion_tokens", "total_tokens")


@query("usage_requests", "O-CNV-06", with_views("model_calls", """
    SELECT provider, model, status, CAST(count(*) AS BIGINT) AS requests, round(sum(duration), 4) AS duration_sum
    FROM model_calls GROUP BY ALL"""))
def usage_requests(spark, sf_dir):
    totals = conversations.usage_totals(view(spark, sf_dir, "model_calls"))
    return totals.withColumn("duration_sum", F.round("duration_sum", 4))


@query("usage_tokens", "O-CNV-06", with_views("model_calls", """
    , t AS (SELECT provider, model, sum(asked) AS i, sum(told) AS o FROM model_calls WHERE status <> 'error' GROUP BY ALL)
    SELECT provider, model, 'input' AS type, CAST(i AS BIGINT) AS tokens FROM t
    UNION ALL SELECT provider, model, 'output', CAST(o AS BIGINT) FROM t"""))
def usage_tokens(spark, sf_dir):
    calls = view(spark, sf_dir, "model_calls")
    told = F.col("status") != "error"
    return conversations.token_totals(calls.withColumns({
        "input_tokens": F.when(told, F.col("asked")), "output_tokens": F.when(told, F.col("told"))
    }))


_ODD_ROLE = "CASE WHEN sequence = 6 THEN 'tool' ELSE role END"
_ODD_TEXT = "CASE WHEN sequence = 5 THEN '' ELSE content END"


def _odd_turns(spark, sf_dir):
    """Turns with an unknown role and an empty text in the longer conversations."""
    return view(spark, sf_dir, "turns").withColumns({"role": F.expr(_ODD_ROLE), "content": F.expr(_ODD_TEXT)})


@query("messages_check", "O-CNV-07", with_views("turns", f"""
    , o AS (SELECT job_id, sequence, {_ODD_ROLE} AS role, {_ODD_TEXT} AS content FROM turns)
    SELECT job_id, sequence, concat_ws('; ', CASE WHEN role NOT IN ('system', 'user', 'assistant')
               THEN 'Invalid message role: ' || role END,
           CASE WHEN content = '' THEN 'Message content cannot be empty' END) AS reasons FROM o"""))
def messages_check(spark, sf_dir):
    checked = conversations.check_messages(_odd_turns(spark, sf_dir))
    return checked.select("job_id", "sequence", F.array_join("reject_reasons", "; ").alias("reasons"))


@query("messages_check_jobs", "O-CNV-07", with_views("turns jobs", f"""
    , o AS (SELECT job_id, count(*) AS n, bool_and({_ODD_ROLE} IN ('system', 'user', 'assistant') AND {_ODD_TEXT} <> '') AS ok
            FROM turns GROUP BY job_id)
    SELECT job_id, CAST(coalesce(n, 0) AS BIGINT) AS messages, coalesce(ok, false) AS is_valid
    FROM jobs LEFT JOIN o USING (job_id)"""))
def messages_check_jobs(spark, sf_dir):
    return conversations.check_conversations(view(spark, sf_dir, "jobs"), _odd_turns(spark, sf_dir))


_PROMPTED = findings.REPORT_SQL.replace(
    "BLOCK", "'- ' || filename || ' (lines=' || line_count || ', errors=' || error_count || ', warnings=' || warning_count "
    "|| ', critical=' || critical_count || ', top_keywords=' || array_to_string(top_keywords[1:5], ', ') || ')'"
)


@query("inference_answers", "O-CNV-08", with_views("lines", _PROMPTED + """
    , b AS (SELECT job_id, length('Job ID: ' || job_id || chr(10) || 'Scenario: log_analysis' || chr(10)
              || chr(10) || 'Provide a concise root cause assessment and remediation plan based on the following file summaries:'
              || chr(10) || array_to_string(blocks, chr(10)) || chr(10) || chr(10)
              || 'Focus on likely causes, impacted areas, and actionable remediation steps.') AS chars,
              len(list_filter(blocks, lambda x: NOT contains(x, 'errors=0, '))) AS noisy,
              len(list_filter(blocks, lambda x: NOT contains(x, 'critical=0, '))) AS grave FROM p),
      a AS (SELECT *, 'Files with errors: ' || noisy || '; with critical events: ' || grave || '.'
              || CASE WHEN grave > 0 THEN chr(10) || '- Escalate the critical events to the service owner' ELSE '' END
              || CASE WHEN noisy > 0 THEN chr(10) || '- Inspect the failing components in the listed files' ELSE '' END AS summary FROM b)
    SELECT job_id, CASE WHEN job_id % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS answered_by, summary,
           chars // 4 AS prompt_tokens, length(summary) // 4 AS completion_tokens FROM a"""))
def inference_answers(spark, sf_dir):
    """Prompts of all jobs answered offline, one answer a job; the primary of the odd jobs is down."""
    jobs, made = findings.report_inputs(spark, sf_dir)
    asked = reports.whole(reports.prompts(jobs, made, time_bucket("created_at")), "prompt").withColumns({
        "provider": F.when(F.col("job_id") % 2 == 0, "openai").otherwise("ollama"), "model": F.lit("default-model"),
    })
    answers = inference.run_inference(asked, ["anthropic", "openai"])
    return answers.select("job_id", "answered_by", "summary", "prompt_tokens", "completion_tokens")


@query("inference_failures", "O-CNV-08", with_views("jobs", """
    SELECT job_id, CASE WHEN user_id % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS chosen, 'assistant' AS role,
           'LLM analysis failed: All providers failed after 3 retries: no answer from ' ||
           CASE WHEN user_id % 2 = 0 THEN 'anthropic' ELSE 'openai' END AS content FROM jobs"""))
def inference_failures(spark, sf_dir):
    """Every provider failing: each job keeps a turn that says so."""

    def silent(provider, model, prompt):
        raise RuntimeError(f"no answer from {provider}")

    primary = F.when(F.col("user_id") % 2 == 0, "openai").otherwise("ollama")
    healthy = ["anthropic", "openai"]
    asked = view(spark, sf_dir, "jobs").select(
        "job_id", inference.choose_provider(primary, healthy).alias("provider"),
        F.lit("default-model").alias("model"), F.lit("?").alias("prompt"),
    )
    answers = inference.run_inference(asked, healthy, silent)
    chosen = answers.select("job_id", F.col("answered_by").alias("chosen"))
    return inference.assistant_turns(answers).select("job_id", "role", "content").join(chosen, "job_id")
