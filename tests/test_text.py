"""Text operators against Python's own behaviour on odd texts."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logsieve.functions.text import extension, glob_regex, html_escape, split_lines
from logsieve.operators import chunks, privacy, profiling, rollup
from logsieve.settings import PrivacyPolicy, parse_pii_rules


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "file_id long, text string").repartition(4)


def by_id(df, column):
    return {r.file_id: r[column] for r in df.select("file_id", column).collect()}


def test_lines_are_those_of_splitlines(spark, odd_texts):
    got = by_id(frame(spark, odd_texts).withColumn("lines", split_lines(F.col("text"))), "lines")
    assert got == {i: t.splitlines() for i, t in enumerate(odd_texts)}


def test_line_rows_are_numbered(spark, odd_texts):
    rows = profiling.to_lines(frame(spark, odd_texts)).collect()
    assert {(r.file_id, r.line_no): r.line for r in rows} == {
        (i, n): line for i, t in enumerate(odd_texts) for n, line in enumerate(t.splitlines(), 1)
    }


def test_profiles(spark, odd_texts):
    rows = {r.file_id: r for r in profiling.profile_texts(frame(spark, odd_texts)).collect()}
    for i, text in enumerate(odd_texts):
        lines = text.splitlines()
        assert rows[i].line_count == len(lines)
        for term in ("error", "warning", "critical", "info"):
            assert rows[i][f"{term}_count"] == len([x for x in lines if term in x.lower()])
        assert rows[i].sample_head == lines[:5]
        assert rows[i].sample_tail == (lines[-5:] if len(lines) > 5 else [])


def test_top_keywords_settle_ties_by_first_place(spark, odd_texts):
    words = profiling.words_of_texts(frame(spark, odd_texts), ["file_id"])
    got = by_id(profiling.keyword_lists(words, ["file_id"]), "top_keywords")
    for i, text in enumerate(odd_texts):
        want = [w for w, _ in Counter(re.findall("[a-z]{4,}", text.lower())).most_common(10)]
        assert got.get(i, []) == want


def test_line_summaries_equal_text_summaries(spark, odd_texts):
    texts = frame(spark, odd_texts).where("text <> ''")
    whole = {r.file_id: r for r in profiling.file_summaries(texts).collect()}
    lined = profiling.line_file_summaries(profiling.to_lines(texts), ["file_id"]).collect()
    for row in lined:
        for column in ("line_count", "error_count", "sample_head", "sample_tail", "top_keywords"):
            assert row[column] == whole[row.file_id][column], column


def test_chunks_are_the_shortest_runs_of_whole_lines(spark, odd_texts):
    got = by_id(frame(spark, odd_texts).withColumn("chunks", chunks.chunk_texts(F.col("text"))), "chunks")
    for i, text in enumerate(odd_texts):
        lines, made = text.splitlines(), got[i]
        assert "\n".join(made) == "\n".join(lines)
        assert len(made) >= 1
        for n, chunk in enumerate(made):
            size = len(chunk) + 1
            if n < len(made) - 1:
                assert size >= 2000
            if "\n" in chunk:  # one line less would not have been enough
                assert len(chunk[: chunk.rindex("\n")]) + 1 < 2000


def test_redaction_equals_python_rule_by_rule(spark, odd_texts):
    noisy = [t + " call +1 (555) 123-4567 or a.b@c.example, ssn 123-45-6789, ip 10.0.0.1 é" for t in odd_texts]
    rows = {r.file_id: r for r in privacy.redact(frame(spark, noisy)).collect()}
    for i, text in enumerate(noisy):
        hits = Counter()
        for label, regex in PrivacyPolicy().rules:
            text, n = re.subn(regex, "[REDACTED]", text, flags=re.MULTILINE)
            hits[label] += n
        assert rows[i].text == text
        assert rows[i].redaction_counts == {k: v for k, v in hits.items() if v}


def test_redaction_examples(spark):
    policy = PrivacyPolicy(entries=("email::[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+",), token="[MASKED]")
    row = privacy.redact(frame(spark, ["Contact me via jane.doe@example.com for details."]), policy).first()
    assert row.text == "Contact me via [MASKED] for details."
    assert row.redaction_counts == {"email": 1} and row.redaction_applied
    off = privacy.redact(frame(spark, ["Sensitive: 123-45-6789"]), PrivacyPolicy(enabled=False)).first()
    assert off.text == "Sensitive: 123-45-6789" and off.redaction_counts == {}


def test_redaction_token_is_taken_literally_and_labels_add_up(spark):
    policy = PrivacyPolicy(entries=("n::\\d", "n::[a-c]"), token="$1\\")
    row = privacy.redact(frame(spark, ["xb"]), policy).first()
    assert row.text == "x$1\\" and row.redaction_counts == {"n": 1}
    row = privacy.redact(frame(spark, ["1b"]), PrivacyPolicy(entries=policy.entries, token="#")).first()
    assert row.text == "##" and row.redaction_counts == {"n": 2}


def test_rules_are_parsed_without_splitting():
    rules = parse_pii_rules(["a::x{7,}", "  ", "y+", "bad::("])
    assert rules == [("a", "x{7,}"), ("pattern_1", "(?!)"), ("pattern_2", "y+")]


def test_actions(spark):
    summary = "Intro\n- Restart the database service\n  * Page \n--  \n-* both\nend"
    row = frame(spark, [summary, "nothing"]).select(
        "file_id", rollup.recommended_actions(F.col("text")).alias("a")
    ).orderBy("file_id").collect()
    assert row[0].a == ["Restart the database service", "Page", "both"]
    assert row[1].a == ["Review the generated summary and log excerpts for next steps."]


def test_small_helpers(spark):
    row = spark.range(1).select(
        html_escape(F.lit("<a href=\"x\">'&'</a>")).alias("h"),
        *[extension(F.lit(n)).alias(f"e{i}") for i, n in enumerate(["a.LOG", "a.b/c", ".hidden", "x.", "a.tar.gz"])],
    ).first()
    assert row.h == "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;&#x27;&lt;/a&gt;"
    assert [row[f"e{i}"] for i in range(5)] == ["log", "", "", "", "gz"]
    assert re.match(glob_regex("**/*.log"), "/w/a/b.log") and not re.match(glob_regex("**/~*"), "/w/a~.log")


def test_rules_of_the_other_dialect(spark):
    texts = frame(spark, ["id 777 777 end", "tail9"])
    rules = ("twice::(?P<a_b>\\d{3}) (?P=a_b)", "last::\\d\\Z", "odd::(?<=a+)b", "back::(?i:END)")
    with pytest.warns(UserWarning, match="odd"):
        got = [r.text for r in privacy.redact(texts, PrivacyPolicy(entries=rules, token="#")).orderBy("file_id").collect()]
    assert got == ["id # #", "tail#"]


def test_top_keywords_of_texts_shuffle_no_words(spark, odd_texts):
    """Keys of one row are counted within it; repeated and null keys are added up as before, ties and counts alike."""
    rows = [(i, t) for i, t in enumerate(odd_texts)] + [(3, "zebra error error"), (None, "alpha beta beta"), (None, "alpha gamma"), (900, None)]
    texts = spark.createDataFrame(rows, "file_id long, text string")
    want = profiling.top_keywords(profiling.words_of_texts(texts, ["file_id"]), ["file_id"])
    made = profiling.top_text_keywords(texts, ["file_id"])
    told = lambda d: sorted(map(str, d.select("file_id", "word", "n", "rank").collect()))
    assert told(made) == told(want) and dict(made.dtypes) == dict(want.dtypes)
    single = profiling.top_text_keywords(texts.where("file_id > 5"), ["file_id"])
    alone = single._jdf.queryExecution().optimizedPlan().children().apply(0).toString()
    assert "Aggregate" not in alone and "Window" not in alone
