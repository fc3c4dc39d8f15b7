"""Conversation turns and model usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.ordering import numbered, top_per_key
from logsieve.settings import MESSAGE_ROLES


def append_turns(stored: DataFrame, new: DataFrame, order: str, bucket: Column) -> DataFrame:
    """New turns with the sequence that follows the stored ones of their job.

    ``new`` is numbered by its ``order`` column; ``bucket`` cuts long conversations into blocks.
    """
    last = stored.groupBy("job_id").agg(F.max("sequence").alias("_last"))
    placed = numbered(new, ["job_id"], [order], bucket, "_nth")
    return (
        placed.join(last, "job_id", "left")
        .withColumn("sequence", F.coalesce("_last", F.lit(0)) + F.col("_nth"))
        .drop("_last", "_nth")
    )


def append_events(appended: DataFrame, call: list[str]) -> DataFrame:
    """One event per append call: number of turns, latest sequence and roles in order.

    ``call`` names the columns that tell the calls of a job apart; a call is one request, so its
    roles fit a row.
    """
    ordered = F.sort_array(F.collect_list(F.struct("sequence", "role")))
    return appended.groupBy("job_id", *call).agg(
        F.lit("conversation-turn").alias("event_type"),
        F.count(F.lit(1)).alias("count"),
        F.max("sequence").alias("latest_sequence"),
        F.transform(ordered, lambda x: x["role"]).alias("roles"),
    )


def conversation(turns: DataFrame, job_id=None, limit: int | None = None) -> DataFrame:
    """Turns in order, of one job or of each; ``limit`` keeps the first ones of every job."""
    chosen = turns if job_id is None else turns.where(F.col("job_id") == job_id)
    if limit:
        chosen = top_per_key(chosen, ["job_id"], [F.asc("sequence")], limit, "_rank").drop("_rank")
    return chosen.orderBy("job_id", "sequence")


def estimate_tokens(text: Column) -> Column:
    """Four characters to a token."""
    return F.floor(F.length(text) / 4)


def normalise_usage(responses: DataFrame, usage: str = "usage") -> DataFrame:
    """Token counts from the field names the providers use: adds prompt, completion and total tokens."""
    parsed = F.from_json(
        F.col(usage),
        "prompt_tokens long, completion_tokens long, input_tokens long, output_tokens long, "
        "prompt_eval_count long, eval_count long, inputTextTokenCount long, "
        "results array<struct<tokenCount: long>>, "
        "total_tokens long",
    )

    def first_of(*names: str) -> Column:
        return F.coalesce(*[F.col(f"_usage.{n}") for n in names], F.lit(0))

    prompt = first_of("prompt_tokens", "input_tokens", "prompt_eval_count", "inputTextTokenCount")
    completion = F.coalesce(
        "_usage.completion_tokens", "_usage.output_tokens", "_usage.eval_count",
        F.try_element_at("_usage.results.tokenCount", F.lit(1)), F.lit(0),
    )
    return (
        responses.withColumn("_usage", parsed)
        .withColumns({
            "prompt_tokens": prompt,
            "completion_tokens": completion,
            "total_tokens": F.coalesce("_usage.total_tokens", prompt + completion),
        })
        .drop("_usage")
    )


def usage_totals(requests: DataFrame) -> DataFrame:
    """Requests by provider, model and status. ``requests``: also ``duration, input_tokens, output_tokens``."""
    return requests.groupBy("provider", "model", "status").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("duration").alias("duration_sum")
    )


def token_totals(requests: DataFrame) -> DataFrame:
    """Tokens by provider, model and type; requests that report none are left out."""
    return (
        requests.groupBy("provider", "model")
        .agg(F.sum("input_tokens").alias("input"), F.sum("output_tokens").alias("output"))
        .unpivot(["provider", "model"], ["input", "output"], "type", "tokens")
        .where("tokens IS NOT NULL")
    )


def check_messages(turns: DataFrame) -> DataFrame:
    """Adds ``reject_reasons`` to each message."""
    return turns.withColumn("reject_reasons", F.array_compact(F.array(
        F.when(
            ~F.coalesce(F.col("role").isin(MESSAGE_ROLES), F.lit(False)),
            F.concat(F.lit("Invalid message role: "), F.coalesce("role", F.lit("None"))),
        ),
        F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, F.lit("Message content cannot be empty")),
    )))


def check_conversations(jobs: DataFrame, turns: DataFrame) -> DataFrame:
    """Validity of each job's messages as a whole; a job without messages is not valid."""
    checked = check_messages(turns).groupBy("job_id").agg(
        F.count(F.lit(1)).alias("messages"), F.bool_and(F.size("reject_reasons") == 0).alias("_all_ok")
    )
    return jobs.select("job_id").join(checked, "job_id", "left").select(
        "job_id", F.coalesce("messages", F.lit(0)).alias("messages"),
        F.coalesce("_all_ok", F.lit(False)).alias("is_valid"),
    )
