"""Files, jobs, conversations, reports."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logsieve.functions.ordering import block_bucket, following, numbered, previous, time_bucket
from logsieve.operators import conversations, inference, jobs, profiling, quality, reports, rollup
from logsieve.settings import FilePolicy, WatchConfig
from logsieve.sources import files, records, sinks

T0 = datetime(2024, 1, 1)
UPLOAD = "file_id long, job_id string, filename string, content binary, created_at timestamp_ntz"


def uploads(spark, rows):
    return spark.createDataFrame(
        [(i, job, name, content, T0 + timedelta(seconds=i)) for i, (job, name, content) in enumerate(rows)], UPLOAD
    )


def test_upload_gate(spark):
    rows = uploads(spark, [
        ("j", "sample.log", b"INFO start\nERROR failure occurred\n"), ("j", "noext", b"ok"), ("j", "a.exe", b"ok"),
        ("j", "a.log", b""), ("j", "b.log", bytes(range(128, 256))), ("j", "c.log", b"x" * 50),
    ])
    policy = FilePolicy()
    got = [r.reject_reason for r in files.upload_gate(rows, policy).orderBy("file_id").collect()]
    assert got[0] is None and got[1] is None and got[5] is None
    assert got[2] == "Unsupported file extension '.exe'"
    assert got[3] == "Empty files are not allowed"
    assert got[4].startswith("File appears to be binary")
    small = FilePolicy(max_file_size_mb=0)
    assert files.upload_gate(rows, small).where("file_id = 5").first().reject_reason == "File exceeds limit of 0 bytes"
    checked = files.precheck(rows.withColumn("file_size", F.lit(1)), policy)
    assert [r.is_allowed for r in checked.orderBy("file_id").collect()] == [True, False, False, True, True, True]


def test_decode_and_checksum(spark):
    rows = uploads(spark, [("j", "a.log", "é\r\nb\rc".encode()), ("j", "b.log", "é\n".encode("latin-1"))])
    got = files.add_checksum(files.decode_text(rows)).orderBy("file_id").collect()
    assert [r.text for r in got] == ["é\nb\nc", "é\n"]
    assert got[0].file_size == 7 and len(got[0].checksum) == 64


def test_duplicates_first_wins_and_stored_wins_over_all(spark):
    rows = files.add_checksum(uploads(spark, [("j", "a", b"one"), ("k", "b", b"one"), ("j", "c", b"two"), ("j", "d", b"new")]))
    stored = files.add_checksum(uploads(spark, [("z", "old", b"two")]))
    got = files.reject_duplicates(rows, stored).orderBy("file_id").collect()
    assert [r.is_duplicate for r in got] == [False, True, True, False]


def test_stored_names_are_unique_and_skip_rotated_names(spark):
    names = ["dir/app.log", "app.log", "app.log.1", "app.log", "../..", "ä b.log", "app.log.1", "app.log.3", "app.log"]
    rows = uploads(spark, [("j", n, b"x") for n in names])
    got = [r.stored_name for r in files.store_names(rows, time_bucket("created_at")).orderBy("file_id").collect()]
    assert got == [
        "app.log", "app.log.2", "app.log.1", "app.log.4", "upload", "b.log", "app.log.1.1", "app.log.3", "app.log.5",
    ]


def test_stored_names_skip_names_in_use(spark):
    import random

    rng = random.Random(4)
    names = [rng.choice(["a.log", "a.log.1", "a.log.2", "a.log.7", "a.log.3", "b", "b.2", f"b.{10**17}"]) for _ in range(60)]
    rows = spark.createDataFrame([(i, "j", n, T0 + timedelta(minutes=i)) for i, n in enumerate(names)],
                                 "file_id long, job_id string, filename string, created_at timestamp_ntz")
    got = {r.file_id: r.stored_name for r in files.store_names(rows, time_bucket("created_at")).collect()}
    seen, want = {}, {}
    for i, n in enumerate(names):
        if n not in seen:
            seen[n], want[i] = 0, n
            continue
        seen[n] += 1
        while f"{n}.{seen[n]}" in names:
            seen[n] += 1
        want[i] = f"{n}.{seen[n]}"
    assert got == want


def test_discovery_reads_and_streams_folders(spark, tmp_path):
    for name in ("a.log", "sub/b.txt", "~c.log", "d.tmp", "e.bin", "large.log"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"hello" * (300_000 if "large" in name else 1))
    config = WatchConfig(roots=(str(tmp_path),), max_file_size_mb=1)
    found = {r.path.rsplit("/", 1)[1] for r in files.discover(spark, config).select("path").collect()}
    assert found == {"a.log", "b.txt"}
    stream = files.discover_stream(spark, config).select("path")
    query = stream.writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.path.rsplit("/", 1)[1] for r in spark.table("found").collect()} == found


def test_discovery_lists_in_tasks_what_the_reader_of_spark_finds(spark, tmp_path):
    names = ("a.log", "with space/b c%20#1.txt", ".hidden.log", "_h.log", "_k=1/a.log", ".git/a.log", "_out/a.csv", "deep/" * 9 + "z.json", "x._COPYING_",
             "~c.log", "d.tmp", "_metadata.log", "_metadata.d/m.log", "empty.log", "[1]{2}.log", "large.log", *(f"many/{i % 50}/{i}/{i}.log" for i in range(900)))
    for name in names:
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(name.encode() * (300_000 if "large" in name else "empty" not in name))
    (tmp_path / "in/nothing").mkdir()
    (tmp_path / "in2").mkdir()
    (tmp_path / "in2/one.log").write_bytes(b"one")
    roots = (str(tmp_path / "in"), f"{tmp_path}/in*", str(tmp_path / "in/deep"), str(tmp_path / "in/_out"), f"file:{tmp_path}/in/.git/a.log", str(tmp_path / "in/_h.log"))
    config = WatchConfig(roots=roots, max_file_size_mb=1)
    found = files.discover(spark, config)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots))
    want = files.matching_paths(reader.where("length <= 1048576"), config)
    assert found.dtypes == want.dtypes
    key = lambda r: r.path
    assert sorted(found.collect(), key=key) == sorted(want.collect(), key=key) and found.count() > 900
    # the plan names no watched file: before, the driver held them all
    assert not [f for f in found.inputFiles() if "/in/" in f]
    one = WatchConfig(roots=(str(tmp_path / "in/nothing"),))
    assert files.discover(spark, one).count() == 0
    with pytest.raises(FileNotFoundError):
        files.discover(spark, WatchConfig(roots=(str(tmp_path / "not there"),)))


def test_a_walk_hands_on_the_folders_it_has_not_come_to(tmp_path, monkeypatch):
    import pyarrow as pa

    for i in range(30):
        (tmp_path / f"f{i}").mkdir()
        (tmp_path / f"f{i}/a.log").write_bytes(b"a")
    monkeypatch.setattr(files, "_WALKED", 40)
    monkeypatch.setattr(files, "_ROWS", 7)
    waiting, seen, turns = [f"file:{tmp_path}"], [], 0
    while waiting:
        batches = list(files._walk(iter([pa.RecordBatch.from_pydict({"path": waiting})])))
        assert max(b.num_rows for b in batches) <= 7
        rows = [r for b in batches for r in b.to_pylist()]
        seen += [r["path"] for r in rows if not r["is_folder"]]
        waiting, turns = [r["path"] for r in rows if r["is_folder"]], turns + 1
    assert sorted(seen) == sorted(f"file:{tmp_path}/f{i}/a.log" for i in range(30)) and turns == 2


def test_only_objects_are_job_contexts(spark):
    rows = [("a", '[1,2]', None), ("b", '"text"', None), ("c", "no json", None), ("d", "7", None), ("e", '{"job":null,"x":1}', None), ("f", ' {"x":1} ', None),
            ("g", '{"json":[1],"y":2}', None), ("h", '{"json":{"z":3},"y":2}', None), ("i", "{}", '{"outputs":{"json":"{}","w":1}}'),
            ("j", None, '{"outputs":[1]}'), ("k", '{"json":{}}', None), ("l", None, None)]
    given = spark.createDataFrame([(i, "u", o, r) for i, o, r in rows], "job_id string, user_id string, outputs string, result_data string")
    got = {r.job_id: json.loads(r.context) for r in jobs.job_context(given).collect()}
    own = {i: {"id": i, "user_id": "u"} for i, *_ in rows}
    assert got == {i: {"job": own[i]} for i in "abcdjl"} | {
        "e": {"job": None, "x": 1}, "f": {"x": 1, "job": own["f"]}, "g": {"json": [1], "y": 2, "job": own["g"]}, "h": {"z": 3, "job": own["h"]},
        "i": {"json": "{}", "w": 1, "job": own["i"]}, "k": {"json": {}, "job": own["k"]}}


def test_scratch_is_deleted_when_it_is_done_with(spark, tmp_path):
    import os

    from logsieve import session

    kept, gone = (session.materialise(spark.range(3), "some") for _ in range(2))
    session.discard(gone)
    assert not os.path.exists(gone._scratch_path) and kept.count() == 3
    assert kept._scratch_path in session._WRITTEN[spark.sparkContext.applicationId]
    others = session._WRITTEN[spark.sparkContext.applicationId][:-1]
    session._WRITTEN[spark.sparkContext.applicationId] = [kept._scratch_path]
    assert session.clear_scratch(spark) == 1 and not os.path.exists(kept._scratch_path)
    session._WRITTEN[spark.sparkContext.applicationId] = others


def test_sketched_keywords(spark):
    """Exact while a sketch holds all words; with fewer places within the stated error, and no frequent word is missed."""
    import random

    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(1))}" for _ in range(20_000)]
    rows = spark.createDataFrame([("j", i % 7, w) for i, w in enumerate(words)], "job_id string, day int, word string")
    truth = {w: words.count(w) for w in set(words)}
    for tracked in (10_000, 40):
        kept = profiling.combine_sketches(profiling.keyword_sketches(rows, ["job_id", "day"], tracked), ["job_id"], tracked)
        got = profiling.sketched_keywords(kept, ["job_id"], 5, tracked).collect()
        assert {r.exact for r in got} == {tracked == 10_000} and {r.words for r in got} == {20_000}
        error = 0 if tracked == 10_000 else 3.5 * 20_000 / tracked
        assert all(abs(r.n - truth[r.word]) <= error for r in got)
        assert {w for w, n in truth.items() if n > error and sum(m > n for m in truth.values()) < 5} <= {r.word for r in got}
        if not error:
            assert sorted((r.n for r in got), reverse=True) == sorted(truth.values(), reverse=True)[:5]


def test_log_records_keep_broken_lines(spark):
    rows = spark.createDataFrame([(json.dumps({"level": "INFO", "line": 3, "timestamp": "2024-01-01T00:00:00+00:00"}),), ("oops",)], "line string")
    good, bad = sorted(records.parse_log_records(rows).collect(), key=lambda r: r.level is None)
    assert good.level == "INFO" and good["_corrupt_record"] is None and good.timestamp is not None
    assert bad["_corrupt_record"] == "oops"


def test_ordering_helpers_equal_plain_windows(spark):
    rows = spark.range(2000).select(
        (F.col("id") % 3).alias("k"), F.expr("(id * 7919) % 2003").alias("n")
    ).repartition(7)
    made = numbered(rows, ["k"], ["n"], block_bucket("n", 64), "nth")
    made = previous(made, ["k"], ["n"], block_bucket("n", 64), F.col("n"), "before")
    made = following(made, ["k"], ["n"], block_bucket("n", 64), F.col("n"), "after")
    groups = {}
    for r in made.collect():
        groups.setdefault(r.k, []).append(r)
    for members in groups.values():
        members.sort(key=lambda r: r.n)
        ns = [r.n for r in members]
        assert [r.nth for r in members] == list(range(1, len(ns) + 1))
        assert [r.before for r in members] == [None, *ns[:-1]]
        assert [r.after for r in members] == [*ns[1:], None]


def test_cancel_after_the_end_is_ignored_and_retries_are_counted(spark):
    steps = [
        ("a", ["pending", "running", "completed", "cancelled", "cancelled"]), ("b", ["running", "cancelled", "cancelled"]),
        ("c", ["running", "failed", "running", "failed"]), ("d", ["completed", "running", "cancelled"]), ("e", ["pending"]),
    ]
    rows = [(j, s, f"{s}!" if s in ("failed", "cancelled") else None, T0 + timedelta(hours=i), i)
            for j, states in steps for i, s in enumerate(states)]
    states = {r.job_id: r for r in jobs.job_states(
        spark.createDataFrame(rows, "job_id string, status string, error string, ts timestamp_ntz, seq int"),
        time_bucket("ts"),
    ).collect()}
    assert {k: r.status for k, r in states.items()} == {
        "a": "completed", "b": "cancelled", "c": "failed", "d": "cancelled", "e": "pending"}
    assert states["c"].retry_count == 2 and states["c"].retry_eligible and not states["b"].retry_eligible
    assert states["a"].error_message is None and states["d"].error_message == "cancelled!"
    assert states["e"].started_at is None and states["c"].completed_at == T0 + timedelta(hours=1)


def test_statistics(spark):
    rows = [(1, "completed", "x", T0, T0 + timedelta(seconds=10)), (2, "completed", "x", T0, T0),
            (3, "failed", "y", T0, None), (4, "pending", "y", None, None)]
    stats = {(r.breakdown, r.value): r for r in jobs.job_statistics(spark.createDataFrame(
        rows, "job_id long, status string, job_type string, started_at timestamp_ntz, completed_at timestamp_ntz")).collect()}
    assert stats["total", "all"].jobs == 4 and stats["total", "all"].avg_duration == 10
    assert abs(stats["total", "all"].success_rate - 200 / 3) < 1e-9
    assert stats["status", "pending"].success_rate == 0 and stats["type", "y"].jobs == 2


SUMMARY = ("job_id string, file_id string, created_at timestamp_ntz, filename string, checksum string, file_size int, "
           "content_type string, line_count int, error_count int, warning_count int, critical_count int, info_count int, "
           "sample_head array<string>, sample_tail array<string>, top_keywords array<string>, chunk_count int, "
           "redaction_applied boolean, redaction_counts map<string,int>")


def summary_rows(spark, n=1):
    return spark.createDataFrame([
        ("job-1", f"file-{i}", T0 + timedelta(minutes=i), "error.log", "deadbeef", 1024, "text/plain", 42, 3, 1, 0, 38,
         ["ERROR failed to connect", "WARN retrying"], ["INFO recovered service"], ["error", "failed", "retrying"], 1, False, {})
        for i in range(n)], SUMMARY)


def described(summaries, text="- Restart the database service"):
    made = rollup.add_severity(rollup.job_metrics(summaries)).join(rollup.job_tags(summaries), "job_id").withColumns({
        "mode": F.lit("rca_analysis"), "summary": F.lit(text), "recommended_actions": rollup.recommended_actions(F.lit(text))})
    return made.withColumn("categories", rollup.categories(F.col("mode")))


def test_reports_and_lifecycle(spark):
    made = summary_rows(spark)
    jobs_, bucket = described(made), time_bucket("created_at")
    text = reports.whole(reports.markdown_reports(jobs_, made, bucket), "text").first().text
    assert "- **Severity:** High" in text and "- Restart the database service" in text and text.endswith("`INFO recovered service`")
    bundle = json.loads(reports.whole(reports.json_bundles(jobs_, made, bucket, "now"), "json").first().json)
    assert bundle["llm"] == {"summary": bundle["summary"]} and bundle["ticketing"] == {}
    assert bundle["severity"] == "high" and bundle["analysis_type"] == "rca_analysis" and len(bundle["files"]) == 1
    assert bundle["categories"] == ["error-detected", "rca", "rca_analysis", "warning-detected"]
    assert "<td>error.log</td>" in reports.whole(reports.html_reports(jobs_, made, bucket), "html").first().html
    assert rollup.lifecycle_events(made, rollup.job_metrics(made)).count() == 6
    assert [r.filename for r in rollup.suspected_error_logs(made).collect()] == ["error.log"]


def test_reports_have_one_shape_for_any_number_of_files(spark, tmp_path):
    for n in (1, 7):
        made = summary_rows(spark, n)
        jobs_, bucket = described(made), time_bucket("created_at")
        for build, ends in [(reports.markdown_reports, 0), (reports.html_reports, 1), (reports.prompts, 1)]:
            pieces = build(jobs_, made, bucket)
            rows = sorted(pieces.collect(), key=lambda r: r.piece_no)
            assert [r.piece_no for r in rows] == list(range(n + 1 + ends))
            assert reports.whole(pieces, "text").first().text == "".join(r.text for r in rows)
    sinks.write_pieces(pieces, str(tmp_path / "prompts"))
    assert "".join(r.text for r in spark.read.parquet(str(tmp_path / "prompts")).orderBy("piece_no").collect()) == "".join(r.text for r in rows)
    told = reports.messages(reports.whole(pieces, "prompt")).orderBy("sequence").collect()
    assert [r.role for r in told] == ["system", "user"] and told[1].content == "".join(r.text for r in rows)


def test_conversations(spark):
    stored = spark.createDataFrame([("a", 2)], "job_id string, sequence long")
    new = spark.createDataFrame([("a", 0, "system"), ("a", 1, "user"), ("b", 0, "user")], "job_id string, n long, role string")
    got = conversations.append_turns(stored, new, "n", block_bucket("n"))
    assert sorted((r.job_id, r.sequence) for r in got.collect()) == [("a", 3), ("a", 4), ("b", 1)]
    event = {r.job_id: r for r in conversations.append_events(got, []).collect()}["a"]
    assert event["count"] == 2 and event.latest_sequence == 4 and event.roles == ["system", "user"]
    checked = conversations.check_messages(spark.createDataFrame(
        [("system", "x"), ("tool", "x"), ("user", "")], "role string, content string")).collect()
    assert [len(r.reject_reasons) for r in checked] == [0, 1, 1]


def test_inference_falls_back_and_never_loses_a_job(spark):
    calls = spark.createDataFrame([("a", "p1", "m", "x"), ("b", "down", "m", "x")], "job_id string, provider string, model string, prompt string")

    def flaky(provider, model, prompt):
        if provider == "p1":
            raise RuntimeError("busy")
        return " fine ", 1, 2

    got = {r.job_id: r for r in inference.run_inference(calls, ["p1", "p2"], flaky).collect()}
    assert got["a"].answered_by == "p2" and got["a"].summary == "fine" and got["b"].answered_by == "p2"
    none = inference.assistant_turns(inference.run_inference(calls, [], flaky)).collect()
    assert len(none) == 2 and all(r.content.startswith("LLM analysis failed: ") for r in none)


def test_quality(spark):
    rows = spark.createDataFrame([("pending",), ("odd",), (None,)], "status string")
    assert quality.bad_status(rows).count() == 2
    broken = quality.column_violations(spark.createDataFrame([("x" * 60, None)], "status string, platform string"), quality.TICKET_COLUMNS)
    assert broken.first().violations == ["platform: null", "status: longer than 50"]


def test_empty_jobs(spark):
    every = spark.createDataFrame([("a", "rca_analysis"), ("b", "rca_analysis"), ("c", "embedding_generation")], "job_id string, job_type string")
    owned = spark.createDataFrame([("a",)], "job_id string")
    assert {r.job_id for r in rollup.jobs_without_input(every, owned, owned).collect()} == {"b", "c"}


def test_profile_counts_are_plain_ints(spark):
    made = profiling.profile_texts(spark.createDataFrame([(1, "ERROR info\nx")], "file_id long, text string")).first()
    assert (made.line_count, made.error_count, made.info_count) == (2, 1, 1)
