"""Redaction of personal data by ordered rules, with counts of the hits."""

from __future__ import annotations

import warnings

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.text import java_regex, let
from logsieve.settings import DEFAULT_PII_RULES, PrivacyPolicy, parse_pii_rules

_FLAGS = "(?Umd)"

# What a text must hold for a rule to match at all; far cheaper to look for than the rule itself.
# Kept by the regex, so a rule of another wording is never skipped.
_NEEDS = dict(zip((regex for _, regex in parse_pii_rules(DEFAULT_PII_RULES)), ["@", *["\\p{Nd}"] * 4]))


def _scrubbed(text: Column, rules: list[tuple[str, str]], token: str) -> Column:
    """Struct of the redacted text and the hits of each rule, ``h0``, ``h1`` …

    One expression holding the text once: a predicate on the result that the optimizer moves below
    the projection repeats the work once, not once per mention of every intermediate text. Hits are
    counted first and only texts that have any are rewritten.
    """
    state = F.struct(text.alias("text"))
    for position, (_, regex) in enumerate(rules):
        rule, need = _FLAGS + java_regex(regex), _NEEDS.get(regex)
        known = [f"h{i}" for i in range(position)]

        def counted(s: Column) -> Column:
            hits = F.regexp_count(s["text"], F.lit(rule))
            if need:
                hits = F.when(s["text"].rlike(need), hits).otherwise(0)
            return F.struct(s["text"].alias("text"), *[s[h].alias(h) for h in known], hits.alias(f"h{position}"))

        def replaced(s: Column) -> Column:
            hit = s[f"h{position}"]
            cleaned = F.when(hit > 0, F.regexp_replace(s["text"], rule, token)).otherwise(s["text"])
            return F.struct(cleaned.alias("text"), *[s[h].alias(h) for h in known], hit.alias(f"h{position}"))

        state = let(let(state, counted), replaced)
    return state


def _compiles(df: DataFrame, label: str, regex: str) -> bool:
    """Whether the engine that runs the rule takes it; one that it does not take is skipped with a warning."""
    try:
        df.sparkSession._jvm.java.util.regex.Pattern.compile(_FLAGS + java_regex(regex))
        return True
    except Py4JJavaError as problem:
        warnings.warn(f"PII rule {label!r} skipped: {problem.java_exception.getMessage()}", stacklevel=3)
        return False


def redact(df: DataFrame, policy: PrivacyPolicy = PrivacyPolicy(), text: str = "text") -> DataFrame:
    """Replaces ``text`` and adds ``redaction_counts`` and ``redaction_applied``.

    Each rule sees the output of the rule before, so the whole text has to be given, not lines.
    """
    rules = [rule for rule in policy.rules if _compiles(df, *rule)]
    if not rules:
        none = F.create_map().cast("map<string,int>")
        return df.withColumns({"redaction_counts": none, "redaction_applied": F.lit(False)})
    token = policy.token.replace("\\", "\\\\").replace("$", "\\$")
    hits: dict[str, list[Column]] = {}
    for position, (label, _) in enumerate(rules):
        hits.setdefault(label, []).append(F.coalesce(f"_scrubbed.h{position}", F.lit(0)))
    counts = F.map_from_arrays(
        F.array(*[F.lit(label) for label in hits]), F.array(*[sum(h[1:], h[0]) for h in hits.values()])
    )
    return (
        df.withColumn("_scrubbed", _scrubbed(F.col(text), rules, token))
        .withColumns({
            text: F.col("_scrubbed.text"),
            "redaction_counts": F.map_filter(counts, lambda _, n: n > 0),
            "redaction_applied": F.greatest(*[h for one in hits.values() for h in one], F.lit(0)) > 0,
        })
        .drop("_scrubbed")
    )


def redaction_metadata(df: DataFrame, policy: PrivacyPolicy = PrivacyPolicy()) -> DataFrame:
    """Adds the struct stored with a file: null where nothing was redacted."""
    details = F.struct(
        F.lit(True).alias("applied"),
        F.lit(policy.token).alias("replacement"),
        F.col("redaction_counts").alias("counts"),
    )
    return df.withColumn("pii_redaction", F.when(F.col("redaction_applied"), details))


def redaction_hits(files: DataFrame, keys: list[str]) -> DataFrame:
    """One row per file and label that had hits."""
    # outer, as a plain explode would work out the redaction a second time to filter its input
    rows = files.select(*keys, F.explode_outer("redaction_counts").alias("label", "hits"))
    return rows.where("label IS NOT NULL")


def redaction_audit(files: DataFrame) -> DataFrame:
    """Hits per job and label, with the number of files that had any."""
    return (
        redaction_hits(files, ["job_id"])
        .groupBy("job_id", "label")
        .agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("files"))
    )
