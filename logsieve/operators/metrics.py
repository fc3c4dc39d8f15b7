"""Counters, histograms, gauges and the alert rules over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.ordering import following, previous, running_max
from logsieve.functions.text import let
from logsieve.settings import HISTOGRAM_BOUNDS

STEP_SECONDS = 30


def counter(events: DataFrame, labels: list[str], amount: Column | None = None) -> DataFrame:
    total = F.count(F.lit(1)) if amount is None else F.sum(amount)
    return events.groupBy(*labels).agg(total.alias("total"))


def histogram(
    samples: DataFrame, labels: list[str], value: str, bounds: list[float] = HISTOGRAM_BOUNDS
) -> DataFrame:
    """Cumulative buckets, one row per bound (``le``, the last is ``+Inf``), with sum and count.

    All bounds are counted in one pass over the samples and unfolded afterwards.
    """
    named = {f"_b{i}": bound for i, bound in enumerate(bounds)}
    counted = samples.groupBy(*labels).agg(
        *[F.count_if(F.col(value) <= bound).alias(name) for name, bound in named.items()],
        F.count(value).alias("count"), F.sum(value).alias("sum"),
    )
    rows = [
        F.struct(F.lit(_shown(bound)).alias("le"), F.lit(float(bound)).alias("bound"), F.col(name).alias("bucket"))
        for name, bound in named.items()
    ]
    rows.append(F.struct(
        F.lit("+Inf").alias("le"), F.lit(float("inf")).alias("bound"), F.col("count").alias("bucket")
    ))
    return counted.select(*labels, "count", "sum", F.inline(F.array(*rows)))


def _shown(bound: float) -> str:
    return repr(float(bound))


def quantile(buckets: Column, q: float) -> Column:
    """Quantile of one array of ``bound, bucket`` structs in order of their bounds.

    Linear inside the bucket the rank falls into. A rank in the last bucket gives the highest finite
    bound; without samples the quantile is null.
    """

    def ranked(b: Column) -> Column:
        total = F.element_at(b, -1)["bucket"]
        return F.struct(b.alias("b"), total.alias("total"), (F.lit(q) * total).alias("rank"))

    def placed(s: Column) -> Column:
        below = F.size(F.filter(s["b"], lambda x: x["bucket"] < s["rank"]))
        return let(below, lambda n: inside(s, n))

    def inside(s: Column, n: Column) -> Column:
        here, last = F.element_at(s["b"], n + 1), F.element_at(s["b"], n)
        low = F.when(n > 0, last["bound"]).otherwise(0.0)
        passed = F.when(n > 0, last["bucket"]).otherwise(0)
        value = low + (here["bound"] - low) * (s["rank"] - passed) / F.nullif(here["bucket"] - passed, F.lit(0))
        highest = F.element_at(s["b"], -2)["bound"]
        return F.when(s["total"] == 0, None).when(n >= F.size(s["b"]) - 1, highest).otherwise(value)

    return let(let(buckets, ranked), placed)


def quantile_from_buckets(buckets: DataFrame, labels: list[str], q: float) -> DataFrame:
    """Quantile per label set from the rows of a histogram."""
    ordered = F.sort_array(F.collect_list(F.struct("bound", "bucket")))
    return buckets.groupBy(*labels).agg(ordered.alias("_b")).select(*labels, quantile(F.col("_b"), q).alias("quantile"))


def last_values(samples: DataFrame, labels: list[str]) -> DataFrame:
    """Gauge: the newest value per label set. ``samples``: ``value, ts`` and the labels."""
    return samples.groupBy(*labels).agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))


def queue_gauges(jobs: DataFrame) -> DataFrame:
    """Jobs waiting and in progress per type."""
    return jobs.groupBy("job_type").agg(
        F.count_if(F.col("status") == "pending").alias("queue_size"),
        F.count_if(F.col("status") == "running").alias("in_progress"),
    )


def latency_by_endpoint(requests: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Request analytics: count, share of server errors, mean and 95th percentile per endpoint."""
    return requests.groupBy("method", "endpoint").agg(
        F.count(F.lit(1)).alias("requests"),
        F.avg((F.col("status_code") >= 500).cast("double")).alias("error_share"),
        F.avg("duration_ms").alias("mean_ms"),
        F.percentile_approx("duration_ms", 0.95, accuracy).alias("p95_ms"),
    )


# ---- alert rules ----------------------------------------------------------------------------


def step_counts(
    events: DataFrame, ts: str, flags: dict[str, Column], labels: list[str] = [], step: int = STEP_SECONDS
) -> DataFrame:
    """Events per label set and evaluation step: ``tick`` is the end of the step in epoch seconds.

    Everything after this works on one row per series and step, whatever the number of events. A null label is empty.
    """
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))
    series = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in labels]
    counts = [F.count_if(flag).alias(name) for name, flag in flags.items()]
    return events.groupBy(*series, ((F.floor(seconds / step) + 1) * step).alias("tick")).agg(*counts)


def _from_here(span: int, step: int) -> Column:
    """The evaluations from this one on that ``span`` seconds reach."""
    return F.explode(F.transform(F.sequence(F.lit(0), F.lit(span // step - 1)), lambda i: F.col("tick") + i * step))


def rolling(steps: DataFrame, columns: list[str], window: int, labels: list[str] = [], step: int = STEP_SECONDS) -> DataFrame:
    """Sum of each column over the window that ends at each evaluation with anything in its window.

    A step is added to the evaluations that see it, a fixed number, so neither time without events nor a stray
    timestamp costs rows and no series has to be walked in order.
    """
    seen = steps.select(*labels, *columns, _from_here(window, step).alias("tick"))
    return seen.groupBy(*labels, "tick").agg(*[F.sum(c).alias(c) for c in columns])


def held(evaluations: DataFrame, condition: Column, hold: int | Column, labels: list[str] = [], step: int = STEP_SECONDS) -> DataFrame:
    """Adds ``pending_since`` and ``firing``: the condition was true at every evaluation of the hold.

    An evaluation that is not there is one with an empty window, whose condition is false. Runs of true evaluations
    are found day by day, so a series of any length is many tasks.
    """
    judged = evaluations.withColumn("_ok", F.coalesce(condition, F.lit(False)))
    day = F.floor(F.col("tick") / 86_400)
    true = previous(judged.where("_ok").select(*labels, "tick"), labels, ["tick"], day, F.col("tick"), "_before")
    began = F.when(F.col("_before").isNull() | (F.col("tick") - F.col("_before") > step), F.col("tick"))
    runs = running_max(true, labels, ["tick"], day, began, "pending_since").select(*labels, "tick", "pending_since")
    return (
        judged.join(runs, [*labels, "tick"], "left")
        .withColumn("firing", F.col("_ok") & (F.col("tick") - F.col("pending_since") >= hold))
        .drop("_ok")
    )


def rate_alert(
    events: DataFrame, ts: str, failing: Column, threshold: float, window: int = 300, hold: int = 300, labels: list[str] = []
) -> DataFrame:
    """Failures per second over ``window`` above ``threshold`` for ``hold`` seconds, for each label set by itself."""
    steps = step_counts(events, ts, {"hits": failing}, labels).where("hits > 0")
    rated = rolling(steps, ["hits"], window, labels).withColumn("rate", F.col("hits") / window)
    return held(rated, F.col("rate") > threshold, hold, labels)


def stalled_alert(
    events: DataFrame, ts: str, detected: Column, ingested: Column, window: int = 600, hold: int = 600, labels: list[str] = []
) -> DataFrame:
    """Files detected but none ingested in the window, for as long as the hold."""
    columns = ["detected", "ingested"]
    steps = step_counts(events, ts, {"detected": detected, "ingested": ingested}, labels)
    summed = rolling(steps, columns, window, labels)
    return held(summed, (F.col("detected") > 0) & (F.col("ingested") == 0), hold, labels)


def latency_alert(
    requests: DataFrame, ts: str, seconds: str, threshold: float = 2.0, q: float = 0.95,
    window: int = 300, hold: int = 300, bounds: list[float] = HISTOGRAM_BOUNDS, labels: list[str] = [],
) -> DataFrame:
    """Quantile of the latency over the window above ``threshold`` seconds, from bucket counts."""
    names = [f"b{i}" for i in range(len(bounds))] + ["b_inf"]
    flags = {n: F.col(seconds) <= b for n, b in zip(names, bounds)}
    flags["b_inf"] = F.col(seconds).isNotNull()
    summed = rolling(step_counts(requests, ts, flags, labels), names, window, labels)
    rows = F.array(*[
        F.struct(F.lit(float(b)).alias("bound"), F.col(n).alias("bucket"))
        for n, b in zip(names, [*bounds, float("inf")])
    ])
    judged = summed.select(*labels, "tick", quantile(rows, q).alias("quantile"))
    return held(judged, F.col("quantile") > threshold, hold, labels)


def gauge_alerts(samples: DataFrame, hold: dict[str, int] | None = None, stale: int = 300, step: int = STEP_SECONDS) -> DataFrame:
    """``host, rule, tick, value, pending_since, firing`` of every evaluation of a rule with a value.

    ``samples``: ``host, name, value, ts``. Memory in use over 0.9 and free disk under 0.1 for 5 minutes, ``up`` at 0 for
    one (``hold`` in seconds by rule). A gauge counts from the evaluation after its sample to the next sample, for
    ``stale`` seconds at most, so a sample stands for a fixed number of evaluations at most.
    """
    hold = {"high_memory": 300, "low_disk": 300, "down": 60} | (hold or {})
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    first = (F.ceil(micros / (step * 1_000_000)) * step).cast("long")
    newest = samples.select("host", "name", "value", micros.alias("at"), first.alias("tick")).groupBy("host", "name", "tick").agg(
        F.max_by("value", "at").alias("value"), F.max("at").alias("at")
    )
    day = F.floor(F.col("tick") / 86_400)
    lasting = following(newest, ["host", "name"], ["tick"], day, F.col("tick"), "_next")
    end = F.floor((F.col("at") + stale * 1_000_000 - 1) / 1_000_000)
    upto = F.least(end, F.coalesce(F.col("_next") - step, end))
    seen = lasting.where(upto >= F.col("tick")).select(
        "host", "name", "value", F.explode(F.sequence("tick", upto.cast("long"), F.lit(step).cast("long"))).alias("tick")
    )
    names = ("memory_total", "memory_available", "disk_available", "disk_size", "up")
    at_once = seen.groupBy("host", "tick").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
    used = (F.col("memory_total") - F.col("memory_available")) / F.nullif("memory_total", F.lit(0))
    free = F.col("disk_available") / F.nullif("disk_size", F.lit(0))
    rules = {"high_memory": (used, used > 0.9), "low_disk": (free, free < 0.1), "down": (F.col("up"), F.col("up") == 0)}
    rows = F.array(*[
        F.struct(F.lit(r).alias("rule"), v.cast("double").alias("value"), ok.alias("ok"), F.lit(hold[r]).alias("hold"))
        for r, (v, ok) in rules.items()
    ])
    judged = at_once.select("host", "tick", F.explode(rows).alias("r")).select("host", "tick", "r.*").where("value IS NOT NULL")
    return held(judged, F.col("ok"), F.col("hold"), ["host", "rule"], step).drop("ok", "hold")
