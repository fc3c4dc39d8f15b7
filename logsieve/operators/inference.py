"""Batch inference over prompts with fallback between providers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsieve.settings import FAILED_SUMMARY

# (provider, model, prompt) -> (text, prompt tokens, completion tokens); raises when it cannot answer
Generator = Callable[[str, str, str], tuple[str, int, int]]


def rule_based_summary(provider: str, model: str, prompt: str) -> tuple[str, int, int]:
    """Offline generator: names what the prompt's file lines call for."""
    noisy = sum(1 for line in prompt.split("\n") if line.startswith("- ") and "errors=0, " not in line)
    grave = sum(1 for line in prompt.split("\n") if line.startswith("- ") and "critical=0, " not in line)
    text = f"Files with errors: {noisy}; with critical events: {grave}."
    if grave:
        text += "\n- Escalate the critical events to the service owner"
    if noisy:
        text += "\n- Inspect the failing components in the listed files"
    return text, len(prompt) // 4, len(text) // 4


def choose_provider(primary: Column, healthy: list[str]) -> Column:
    """The primary when healthy, else the first healthy one; null when there is none."""
    if not healthy:
        return F.lit(None).cast("string")
    return F.when(primary.isin(healthy), primary).otherwise(F.lit(healthy[0]))


def run_inference(
    prompts: DataFrame, healthy: list[str], generate: Generator = rule_based_summary, max_retries: int = 3
) -> DataFrame:
    """Answers per prompt row. ``prompts``: ``job_id, provider, model, prompt``.

    A failed call moves on to the next healthy provider, at most ``max_retries`` calls in all. A job
    whose calls all fail keeps its row with ``error`` set and the standing summary.
    """
    added = {
        "answered_by": T.StringType(), "summary": T.StringType(), "prompt_tokens": T.LongType(),
        "completion_tokens": T.LongType(), "error": T.StringType(),
    }
    schema = T.StructType([*prompts.schema.fields, *[T.StructField(n, t) for n, t in added.items()]])

    def answer(provider: str, model: str, prompt: str) -> tuple:
        order = ([provider] if provider in healthy else []) + [p for p in healthy if p != provider]
        problem = "No healthy LLM provider available"
        for attempt in range(max_retries):
            if attempt >= len(order):
                break
            try:
                text, asked, told = generate(order[attempt], model, prompt)
                return order[attempt], text.strip(), asked, told, None
            except Exception as failure:  # a provider may fail in any way; the job must not
                problem = str(failure)
        return provider, FAILED_SUMMARY, None, None, f"All providers failed after {max_retries} retries: {problem}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [answer(*row) for row in zip(batch["provider"], batch["model"], batch["prompt"])]
            columns = pd.DataFrame(
                answers, columns=list(added), index=batch.index
            ).astype({"prompt_tokens": "Int64", "completion_tokens": "Int64"})
            yield pd.concat([batch, columns], axis=1)

    return prompts.mapInPandas(run, schema)


def assistant_turns(answers: DataFrame) -> DataFrame:
    """The turn each answer or failure leaves in the conversation."""
    return answers.select(
        "job_id", F.lit("assistant").alias("role"),
        F.when(F.col("error").isNull(), F.col("summary"))
        .otherwise(F.concat(F.lit("LLM analysis failed: "), F.col("error"))).alias("content"),
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("token_count"),
        F.col("error").isNotNull().alias("failed"),
    )
