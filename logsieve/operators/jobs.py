"""Job and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.ordering import previous, top_per_key
from logsieve.settings import JOB_MODES, TERMINAL_STATUSES


def list_jobs(
    jobs: DataFrame, user_id=None, status: str | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """A page of jobs, newest first."""
    page = jobs
    if user_id is not None:
        page = page.where(F.col("user_id") == user_id)
    if status is not None:
        page = page.where(F.col("status") == status)
    return page.orderBy(F.desc("created_at"), F.asc("job_id")).offset(offset).limit(limit)


def queue(jobs: DataFrame, head: int | None = None) -> DataFrame:
    """Jobs waiting for a worker in the order they are taken; ``head`` keeps the first ones."""
    waiting = jobs.where((F.col("status") == "pending") & (F.col("retry_count") < F.col("max_retries")))
    ordered = waiting.orderBy(F.desc("priority"), F.asc("created_at"), F.asc("job_id"))
    return ordered if head is None else ordered.limit(head)


def is_terminal(status: Column) -> Column:
    return status.isin(TERMINAL_STATUSES)


def duration_seconds(started: str = "started_at", completed: str = "completed_at") -> Column:
    """Seconds with fractions; null unless both ends are known."""
    return F.timestamp_diff("MICROSECOND", F.col(started), F.col(completed)) / F.lit(1e6)


def effective_transitions(transitions: DataFrame, bucket: Column) -> DataFrame:
    """Transitions without the cancellations that came after a terminal state.

    A cancellation counts unless the job is already terminal, and one that is ignored leaves the job
    terminal. So it is ignored exactly when the transition just before it, counted or not, is to a
    terminal status.
    """
    looked = previous(transitions, ["job_id"], ["ts", "seq"], bucket, F.col("status"), "_before")
    ignored = (F.col("status") == "cancelled") & F.coalesce(is_terminal(F.col("_before")), F.lit(False))
    return looked.where(~ignored).drop("_before")


def job_states(transitions: DataFrame, bucket: Column, max_retries: int = 3) -> DataFrame:
    """Current state of each job from its transitions ``job_id, status, error, ts, seq``.

    ``retry_eligible`` tells failed jobs that have tries left.
    """
    at = F.struct("ts", "seq")
    kept = effective_transitions(transitions, bucket)
    failure = F.when(F.col("status").isin("failed", "cancelled"), F.col("error"))
    states = kept.groupBy("job_id").agg(
        F.max_by("status", at).alias("status"),
        F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"),
        F.min(F.when(is_terminal(F.col("status")), F.col("ts"))).alias("completed_at"),
        F.max("ts").alias("updated_at"),
        F.max_by(failure, F.when(failure.isNotNull(), at)).alias("error_message"),
        F.count_if(F.col("status") == "failed").alias("retry_count"),
    )
    return states.withColumn(
        "retry_eligible", (F.col("status") == "failed") & (F.col("retry_count") < max_retries)
    )


def recent_events(events: DataFrame, limit: int = 100, job_id=None, event_type: str | None = None) -> DataFrame:
    """The newest events of each job (or of one), newest first."""
    chosen = events
    if job_id is not None:
        chosen = chosen.where(F.col("job_id") == job_id)
    if event_type is not None:
        chosen = chosen.where(F.col("event_type") == event_type)
    return top_per_key(chosen, ["job_id"], [F.desc("created_at"), F.desc("event_id")], limit)


def events_since(events: DataFrame, since, limit: int | None = 100) -> DataFrame:
    """Events strictly after ``since`` in time order; per job the last ``limit`` of them.

    ``since`` is a timestamp literal or None for all.
    """
    later = events if since is None else events.where(F.col("created_at") > since)
    if limit is not None:
        later = top_per_key(later, ["job_id"], [F.desc("created_at"), F.desc("event_id")], limit, "_rank").drop("_rank")
    return later.orderBy("job_id", "created_at", "event_id")


def job_statistics(jobs: DataFrame, user_id=None) -> DataFrame:
    """One row of statistics in total, and one per status and per type, in a single pass.

    ``breakdown`` is ``total``, ``status`` or ``type``; success rate and mean duration are 0 where
    nothing counts towards them.
    """
    chosen = jobs if user_id is None else jobs.where(F.col("user_id") == user_id)
    done, failed = F.col("status") == "completed", F.col("status") == "failed"
    taken = F.when(done & (F.col("_duration") != 0), F.col("_duration"))
    measured = chosen.withColumn("_duration", duration_seconds())
    totals = measured.groupingSets([[], ["status"], ["job_type"]], "status", "job_type").agg(
        F.grouping("status").alias("_no_status"), F.grouping("job_type").alias("_no_type"),
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(done).alias("_done"), F.count_if(failed).alias("_failed"), F.avg(taken).alias("_mean"),
    )
    whole = (F.col("_no_status") == 1) & (F.col("_no_type") == 1)
    ended = F.col("_done") + F.col("_failed")
    return totals.select(
        F.when(whole, "total").when(F.col("_no_type") == 1, "status").otherwise("type").alias("breakdown"),
        F.when(whole, "all").otherwise(F.coalesce("status", "job_type")).alias("value"),
        "jobs",
        F.when(ended > 0, F.col("_done") / F.nullif(ended, F.lit(0)) * 100).otherwise(0.0).alias("success_rate"),
        F.coalesce("_mean", F.lit(0.0)).alias("avg_duration"),
    )


def expired_jobs(jobs: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Terminal jobs completed more than ``days`` before ``as_of``."""
    cutoff = F.lit(as_of) - F.make_dt_interval(F.lit(days))
    return jobs.where(is_terminal(F.col("status")) & (F.col("completed_at") < cutoff))


def remove_expired(expired: DataFrame, children: DataFrame) -> DataFrame:
    """Child rows of jobs that stay."""
    return children.join(expired.select("job_id"), "job_id", "left_anti")


def unlink_expired(expired: DataFrame, children: DataFrame) -> DataFrame:
    """Child rows that outlive their job: the link of expired jobs becomes null."""
    gone = expired.select("job_id", F.lit(True).alias("_gone"))
    return (
        children.join(gone, "job_id", "left")
        .withColumn("job_id", F.when(F.col("_gone").isNull(), F.col("job_id")))
        .drop("_gone")
    )


def jobs_with_children(jobs: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Every job with all its children, one row per child: ``child_kind, child_id, child``.

    ``children`` maps a kind to ``job_id, child_id, child``. A job may have any number of children, so
    they stay rows; the kinds are stacked before the one join, which keeps them from multiplying each
    other. The join is an inner one with the children on its left, so adaptive execution can split a
    job that owns most of them; jobs without children are added after, with one row of nulls each.
    """
    stacked = None
    for kind, rows in children.items():
        tagged = rows.select("job_id", F.lit(kind).alias("child_kind"), "child_id", "child")
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    owned = stacked.join(jobs, "job_id")
    childless = jobs.join(stacked.select("job_id").distinct(), "job_id", "left_anti")
    shown = [*jobs.columns, "child_kind", "child_id", "child"]
    return owned.select(shown).unionByName(childless, allowMissingColumns=True).select(shown)


def child_counts(jobs: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Every job with the number of its children of each kind."""
    out = jobs
    for kind, rows in children.items():
        counted = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias(kind))
        out = out.join(counted, "job_id", "left").withColumn(kind, F.coalesce(kind, F.lit(0)))
    return out


def job_context(jobs: DataFrame) -> DataFrame:
    """The outcome document of each job from its JSON columns ``outputs`` and ``result_data``.

    Adds ``context``, a JSON object: the document, or an empty one, with an entry ``job`` of the job's id and owner
    unless it has a key of that name, whatever its value. Only objects with an entry are documents: lists, texts,
    numbers, null and what is no JSON are passed over like an empty one.
    """

    def filled(document: Column) -> Column:
        return F.when(F.size(F.json_object_keys(document)) > 0, document)

    def inner(document: Column, key: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(document), f"$.{key}", "variant"))
        return F.when(kind.startswith("OBJECT<"), F.get_json_object(document, f"$.{key}"))

    nested = inner(F.col("result_data"), "outputs")
    document = F.coalesce(
        filled(inner(F.col("outputs"), "json")), filled(F.col("outputs")), filled(inner(nested, "json")), filled(nested), F.lit("{}"),
    )
    entry = F.to_json(
        F.struct(F.col("job_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id")),
        {"ignoreNullFields": "false"},
    )
    found = F.col("_document")
    opened = F.regexp_replace(found, "\\s*\\}\\s*$", "")
    comma = F.when(F.trim(opened) == "{", "").otherwise(",")
    whole = F.when(F.array_contains(F.json_object_keys(found), "job"), found).otherwise(
        F.concat(opened, comma, F.lit('"job":'), entry, F.lit("}"))
    )
    return jobs.withColumn("_document", document).withColumn("context", whole).drop("_document")


def job_summaries(jobs: DataFrame) -> DataFrame:
    """Summary view of each job; ``reject_reason`` where outputs are missing."""
    missing = F.coalesce("outputs", F.lit("{}")).isin("", "{}", "null")

    def field(document: str, path: str) -> Column:
        return F.get_json_object(document, path)

    kind = field("result_data", "$.analysis_type")
    return jobs.select(
        "job_id",
        F.when(missing, F.lit("Summary outputs not available for this job")).alias("reject_reason"),
        F.when(F.coalesce(kind, F.lit("")) != "", kind).otherwise(F.col("job_type")).alias("analysis_type"),
        field("result_data", "$.generated_at").alias("generated_at"),
        F.coalesce(field("outputs", "$.markdown"), F.lit("")).alias("markdown"),
        F.coalesce(field("outputs", "$.html"), F.lit("")).alias("html"),
        F.coalesce(field("outputs", "$.json"), F.lit("{}")).alias("json"),
        field("result_data", "$.metrics").alias("metrics"),
    )


def accessible(rows: DataFrame, requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests with ``allowed``: the user owns the job or is a superuser.

    ``requests``: ``job_id, requested_by``; ``rows``: ``job_id, user_id``; ``users``: ``user_id, is_superuser``.
    """
    powers = users.select(F.col("user_id").alias("requested_by"), "is_superuser")
    return (
        requests.join(rows.select("job_id", F.col("user_id").alias("owner")), "job_id")
        .join(powers, "requested_by", "left")
        .withColumn(
            "allowed",
            (F.col("owner") == F.col("requested_by")) | F.coalesce("is_superuser", F.lit(False)),
        )
    )


def create_jobs(requests: DataFrame) -> DataFrame:
    """Job rows from requests with defaults filled in; ``reject_reason`` for those not acceptable.

    ``input_manifest``, ``model_config``, ``ticketing`` and ``source`` are JSON; columns that the requests lack are unset.
    """
    # What an unset field becomes.
    defaults = {
        "user_id": "anonymous", "provider": "ollama", "model": "llama2", "input_manifest": "{}", "model_config": "{}",
        "ticketing": "{}", "source": None,
    }
    max_retries = 3
    # End of fixed values.
    given = lambda c: F.col(c) if c in requests.columns else F.lit(None).cast("string")
    filled = requests.withColumns({c: F.coalesce(given(c), F.lit(v).cast("string")) for c, v in defaults.items()})
    priority = F.coalesce("priority", F.lit(0))
    return filled.withColumns({
        "priority": priority,
        "status": F.lit("pending"),
        "retry_count": F.lit(0),
        "max_retries": F.lit(max_retries),
        "reject_reason": F.when(F.col("job_type").isNull(), "job_type is required").when(
            ~priority.between(0, 10), "priority must be between 0 and 10"
        ).when(F.try_parse_json("input_manifest").isNull(), "input_manifest must be JSON"),
    })


def created_events(jobs: DataFrame) -> DataFrame:
    """The event that marks each accepted job."""
    return jobs.where(F.col("reject_reason").isNull()).select(
        "job_id", F.lit("created").alias("event_type"),
        # JSON inside JSON, not a string of it
        F.concat(F.lit('{"input_manifest":'), "input_manifest", F.lit("}")).alias("data"), "created_at",
    )


def dispatchable(jobs: DataFrame) -> DataFrame:
    """Adds ``dispatch_error`` for job types no worker knows."""
    return jobs.withColumn(
        "dispatch_error",
        F.when(~F.col("job_type").isin(JOB_MODES), F.concat(F.lit("Unknown job type: "), F.col("job_type"))),
    )
