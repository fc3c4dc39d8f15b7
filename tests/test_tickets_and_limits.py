"""Tickets, limits, alerts, vectors, streams."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsieve.functions.ordering import time_bucket
from logsieve.functions.vectors import cosine_similarity
from logsieve.operators import limits, metrics, tickets, vectors, watching
from logsieve.settings import JiraDefaults, RateLimit, TicketToggles, WatchConfig
from logsieve.streaming import feeds

T0 = datetime(2024, 1, 1)
OUTCOME = ("job_id string, severity string, summary string, metrics map<string,bigint>, recommended_actions array<string>, "
           "categories array<string>, category string, tags array<string>")


def outcome(spark, **given):
    names = [c.split()[0] for c in OUTCOME.split(", ")]
    return spark.createDataFrame([tuple(given.get(n) for n in names)], OUTCOME)


def test_servicenow_defaults(spark):
    row = tickets.servicenow_payload(outcome(
        spark, job_id="job-1234", summary="Database outage detected on primary cluster", metrics={"critical": 2, "errors": 10},
        recommended_actions=["Failover to replica", "Notify on-call DBA"], categories=["infrastructure", "database"],
    )).first().payload
    assert row.priority == "1" and row.category == "infrastructure" and row.assignment_group == ""
    assert row.short_description.startswith("Database outage detected") and "Recommended Actions" in row.description


def test_jira_defaults(spark):
    row = tickets.jira_payload(outcome(
        spark, job_id="job-5678", summary="Memory leak identified in API service", metrics={"errors": 5, "warnings": 12},
        recommended_actions=["Redeploy patched build"], tags=["api", "memory", "incident"],
    ), JiraDefaults(labels=("rca",))).first().payload
    assert row.priority == "High" and row.labels == ["api", "incident", "memory", "rca"]
    assert "Redeploy patched build" in row.description


def test_nested_overrides(spark):
    rows = spark.sql("""SELECT named_struct('a', 'x', 'n', named_struct('p', 1, 'q', 2), 'k', 'keep') AS payload,
        named_struct('a', '', 'n', named_struct('q', 5, 'r', 6), 'k', CAST(NULL AS STRING), 'new', true) AS overrides
        UNION ALL SELECT named_struct('a', 'x', 'n', named_struct('p', 1, 'q', 2), 'k', 'keep'), NULL""")
    got = [json.loads(r.j) for r in tickets.apply_overrides(rows).select(F.to_json("payload").alias("j")).collect()]
    assert got == [{"a": "", "n": {"p": 1, "q": 5, "r": 6}, "k": "keep", "new": True},
                   {"a": "x", "n": {"p": 1, "q": 2}, "k": "keep"}]


def test_dispatch_links_only_real_incidents(spark):
    rows = outcome(spark, job_id="a", metrics={"errors": 1}).unionByName(outcome(spark, job_id="b", metrics={"errors": 1}))
    answers = spark.createDataFrame(
        [("a", "servicenow", "INC1", None, "New", None), ("b", "servicenow", None, None, None, "503")],
        "job_id string, platform string, remote_id string, remote_url string, remote_status string, error string")
    got = {(r.job_id, r.platform): r for r in tickets.dispatch(rows, answers, TicketToggles(True, True, True), "t").collect()}
    assert len(got) == 4 and not got["a", "servicenow"].dry_run and got["b", "servicenow"].error == "503"
    assert json.loads(got["a", "jira"].payload)["description"] == "Linked ServiceNow Incident: INC1"
    assert "Root Cause" in json.loads(got["b", "jira"].payload)["description"]
    assert got["a", "jira"].ticket_id.startswith("jira-") and "not configured" in got["a", "jira"].error


def test_toggles():
    both = TicketToggles(True, True, True)
    assert both.dual_tracking and not both.updated(jira_enabled=False).dual_tracking
    assert both.updated(jira_enabled=None).active_platforms == ["servicenow", "jira"]
    assert WatchConfig().updated(roots="one", enabled=None).roots == ("one",)


def test_limit_specs():
    assert RateLimit.parse("2/second") == RateLimit(2, 1) and RateLimit.parse("10/s") == RateLimit(10, 1)
    assert RateLimit.parse("100/hours") == RateLimit(100, 3600) and RateLimit.parse("x").limit == 0


def requests(spark, seed, n=1500):
    rng = random.Random(seed)
    rows, at = [], {}
    for i in range(n):
        who = "busy" if rng.random() < 0.6 else f"c{rng.randint(0, 4)}"
        at[who] = at.get(who, 0) + rng.choice([0, 1, 200_000, 900_000, 3_000_000, 15_000_000])
        rows.append((i, who, T0 + timedelta(microseconds=at[who])))
    return rows, spark.createDataFrame(rows, "event_id long, client string, ts timestamp_ntz")


def expected_windows(rows, seconds):
    """Window start and place of every request, by looking at one client after the other."""
    out = {}
    for who in {r[1] for r in rows}:
        start = None
        for event_id, _, ts in sorted((r for r in rows if r[1] == who), key=lambda r: (r[2], r[0])):
            if start is None or ts - start >= timedelta(seconds=seconds):
                start, n = ts, 0
            n += 1
            out[event_id] = (start, n)
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_request_anchored_windows(spark, parts):
    """In one part, in a few, and in so many that a busy client fills parts one after the other."""
    was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for seed, seconds in [(1, 1), (2, 7), (3, 60), (4, 3600)]:
            rows, df = requests(spark, seed)
            want = expected_windows(rows, seconds)
            got = limits.fixed_window(df, ["client"], "ts", "event_id", RateLimit(2, seconds)).collect()
            assert len(got) == len(rows)
            for r in got:
                start, n = want[r.event_id]
                assert r.window_count == n and r.allowed == (n <= 2)
                assert r.window_start == (start - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was[1])


def test_no_requests(spark):
    _, df = requests(spark, 1, 3)
    assert limits.enforce(df.limit(0), "client", "ts", "event_id", RateLimit(2, 5), RateLimit(1, 1)).count() == 0


def test_third_request_of_a_second_is_rejected(spark):
    df = spark.createDataFrame([(i, "c", T0 + timedelta(milliseconds=i)) for i in range(3)], "event_id long, client string, ts timestamp_ntz")
    got = limits.enforce(df, "client", "ts", "event_id", RateLimit.parse("2/second"), RateLimit.parse("2/second"))
    assert [r.rejected_by for r in got.orderBy("event_id").collect()] == [None, None, "main"]


def test_debounce(spark):
    rows = [("a", "created", 0), ("a", "modified", 4), ("a", "modified", 8), ("a", "modified", 20), ("b", "modified", 0),
            ("c", "modified", 0), ("c", "created", 100), ("c", "created", 200)]
    df = spark.createDataFrame([(p, k, T0 + timedelta(seconds=s), i) for i, (p, k, s) in enumerate(rows)],
                               "path string, kind string, ts timestamp_ntz, event_id long")
    got = {r.path: (r.ready_at - T0).total_seconds() for r in watching.debounce(df, time_bucket("ts", "minute")).collect()}
    assert got == {"a": 13, "c": 105}


def test_alert_needs_the_whole_hold(spark):
    rows = [(T0 + timedelta(seconds=s),) for s in range(0, 900, 2)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    judged = metrics.rate_alert(df, "ts", F.lit(True), 0.1, 300, 300).orderBy("tick").collect()
    fired = [r.tick for r in judged if r.firing]
    began = next(r.tick for r in judged if r.rate > 0.1)
    assert fired and min(fired) - began == 300
    assert not metrics.rate_alert(df, "ts", F.lit(True), 0.6, 300, 300).where("firing").count()


def test_stray_timestamps_and_labels_cost_no_rows(spark):
    rows = [(T0 + timedelta(seconds=s), "ab"[s % 2]) for s in range(0, 900)]
    rows += [(datetime(1970, 1, 1), "a"), (datetime(9999, 12, 31), "b"), (T0, None)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, who string")
    judged = metrics.rate_alert(df, "ts", F.lit(True), 0.4, 300, 300, ["who"]).collect()
    assert len(judged) < 200 and {r.who for r in judged if r.firing} == {"a", "b"}
    assert not metrics.rate_alert(df, "ts", F.lit(True), 0.6, 300, 300, ["who"]).where("firing").count()


def test_alert_over_midnight(spark):
    late = datetime(2024, 1, 1, 23, 50)
    df = spark.createDataFrame([(late + timedelta(seconds=s),) for s in range(0, 1800, 2)], "ts timestamp_ntz")
    fired = sorted(r.tick for r in metrics.rate_alert(df, "ts", F.lit(True), 0.4, 300, 300).where("firing").collect())
    assert fired == list(range(fired[0], fired[-1] + 30, 30)) and len(fired) > 30


def test_histogram_quantile(spark):
    df = spark.createDataFrame([(0.5,)] * 90 + [(4.0,)] * 10, "v double")
    buckets = metrics.histogram(df.withColumn("e", F.lit("x")), ["e"], "v")
    assert {r.le: r.bucket for r in buckets.collect()}["0.5"] == 90
    assert abs(metrics.quantile_from_buckets(buckets, ["e"], 0.95).first()["quantile"] - 3.75) < 1e-9


def test_cosine(spark):
    pairs = [([1.0, 0.0, 0.0], [1.0, 0.0, 0.0]), ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), ([1.0, 0.0, 0.0], [-1.0, 0.0, 0.0]), ([0.0] * 3, [1.0] * 3)]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>")
    assert [r.c for r in df.select(cosine_similarity(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, -1.0, 0.0]


def test_search_ways_agree(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(600, 16)).astype(np.float32)
    points[100:200] = points[0]  # a third of one kind of vector: ties settled by id
    corpus = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "vec_id long, embedding array<float>").repartition(5)
    asked = corpus.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")

    def answer(df):
        return {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 6)) for r in df.collect()}

    for metric in ("cosine", "l2"):
        assert answer(vectors.nearest(asked, corpus, 7, metric)) == answer(vectors.nearest(asked, corpus, 7, metric, query_rows=3))
    centroids = vectors.train_lists(corpus, 10)
    indexed = vectors.assign_lists(corpus, centroids)
    exact = vectors.nearest(asked, corpus, 7, "l2")
    assert answer(vectors.nearest_in_lists(asked, indexed, centroids, 7, nprobe=10)) == answer(exact)
    assert answer(vectors.nearest_in_lists(asked, indexed, centroids, 7, nprobe=10, query_rows=3)) == answer(exact)
    few = vectors.nearest_in_lists(asked, indexed, centroids, 7, nprobe=3)
    assert answer(few) == answer(vectors.nearest_in_lists(asked, indexed, centroids, 7, nprobe=3, query_rows=3))
    some = vectors.recall(vectors.nearest_in_lists(asked, indexed, centroids, 7, nprobe=4), exact)
    assert some.agg(F.avg("recall")).first()[0] > 0.5


def test_a_kept_index_is_pruned_and_added_to(spark, tmp_path):
    rng = np.random.default_rng(8)
    points = (rng.normal(size=(900, 8)) + 6 * rng.integers(0, 3, size=(900, 8))).astype(np.float32)
    corpus = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "vec_id long, embedding array<float>")
    path = str(tmp_path / "index")
    vectors.write_index(corpus.where("vec_id < 600"), vectors.train_lists(corpus.where("vec_id < 600"), 9), path)
    before = vectors.index_centroids(spark, path)
    vectors.add_to_index(spark, corpus.where("vec_id >= 600"), path)
    assert np.array_equal(before, vectors.index_centroids(spark, path))
    stored = vectors.read_index(spark, path)
    assert stored.count() == 900 and stored.select("vec_id").distinct().count() == 900
    plan = stored.where(F.col("list_id").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "list_id" in plan.split("PartitionFilters: ")[1].split("]")[0]
    asked = corpus.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = vectors.nearest(asked, corpus, 5, "l2")
    every = vectors.search_index(spark, asked, path, 5, nprobe=9)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
    some = vectors.recall(vectors.search_index(spark, asked, path, 5, nprobe=4), exact).agg(F.avg("recall")).first()[0]
    assert some >= 0.9
    assert vectors.nearest(asked.limit(0), corpus, 5).count() == 0 and vectors.nearest(asked, corpus.limit(0), 5).count() == 0


def test_embedding_widths(spark):
    assert vectors.known_dimension("text-embedding-3-small") == 1536 and vectors.known_dimension("other") == 768
    texts = spark.createDataFrame([(1, "Error error x"), (2, ""), (3, None)], "id long, content string")
    own = vectors.embed(texts, lambda: lambda batch: [[float(len(t)), 1.0] for t in batch]).collect()
    assert {r.id: r.embedding for r in own} == {1: [13.0, 1.0], 2: [0.0, 1.0], 3: [0.0, 1.0]}
    rows = {r.id: r.embedding for r in vectors.embed(texts).collect()}
    assert len(rows[1]) == 64 and not any(rows[3]) and abs(sum(x * x for x in rows[1]) - 1) < 1e-6 and not any(rows[2])


def test_stream_drops_duplicate_files(spark, tmp_path):
    source = str(tmp_path / "in")
    df = spark.createDataFrame([(i, f"c{i % 4}", T0) for i in range(20)], "file_id long, checksum string, created_at timestamp")
    df.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    seen = []
    feeds.run_once(feeds.drop_duplicate_files(stream), "", str(tmp_path / "state"), writer=lambda batch, _: seen.extend(batch.collect()))
    assert sorted(r.checksum for r in seen) == ["c0", "c1", "c2", "c3"]
