"""The whole chain over the smallest tables against plain Python."""

import os
from collections import Counter

import corpus_pipeline
import duckdb
import pytest

from logsieve.llm.decontamination import allowed
from logsieve.llm.line_dedup import deleted_lines, sketch
from logsieve.llm.simhash import fingerprint
from logsieve.llm.words import byte_words
from test_decontamination import plain_distance
from test_mixing import plain_targets
from test_quality_rules import measured

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


def plain_rules(docs):
    import re

    out = []
    for d in docs:
        m, text = measured(d["text"]), d["text"] or ""
        words = text.encode().split()
        lines = sum(bool(x.encode().split()) for x in text.split("\n"))
        lettered = len(re.findall(r"[^\W\d_][^\x20\x09-\x0d]*", text))
        bad = (
            m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"] or 100 * m["n_symbols"] > 10 * m["n_words"]
            or m["word_chars"] < 2 * m["n_words"] or m["word_chars"] > 15 * m["n_words"] or 100 * m["n_dup_lines"] > 50 * lines
            or 100 * lettered < 70 * len(words) or 100 * len(re.findall("[A-Z]", text)) > 50 * m["word_chars"]
        )
        if not bad:
            out.append(d)
    return out


def plain_lines(docs, least=50):
    out, owner, seen = [], {}, {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        lines, counts, runs = sketch(d["text"], least)
        seen[d["doc_id"]] = (lines, counts)
        earlier = {owner[r] for r in runs if r in owner}
        for r in runs:
            owner.setdefault(r, d["doc_id"])
        gone = {i for e in earlier for i in deleted_lines(lines, counts, *seen[e], least)}
        text = "\n".join(x for i, x in enumerate(d["text"].split("\n")) if i not in gone)
        if not gone or text.encode().split():
            out.append(d | {"text": text, "n_chars": len(text)})
    return out


def plain_groups(docs):
    fp, root = {d["doc_id"]: fingerprint(d["text"], 4) for d in docs}, {d["doc_id"]: d["doc_id"] for d in docs}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in root:
        for b in root:
            if a < b and bin((fp[a] ^ fp[b]) & (1 << 64) - 1).count("1") <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [d for d in docs if find(d["doc_id"]) == d["doc_id"]]


def plain_items(docs, items):
    clean = []
    for d in docs:
        words = byte_words(d["text"])
        have = set(words)
        for item in items:
            shared = sum(w in have for w in item)
            if item and shared >= len(item) - allowed(len(item)) and plain_distance(words, item) <= allowed(len(item)):
                break
        else:
            clean.append(d)
    return clean


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: r["doc_id"])


def test_every_stage(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = [byte_words(t) for (t,) in duckdb.sql(f"SELECT text FROM '{SF_DIR}/benchmark.parquet'").fetchall()]
    plain = {
        "quality rules": plain_rules, "line dedup": plain_lines, "near-duplicates": plain_groups,
        "benchmark decontamination": lambda d: plain_items(d, items),
    }
    given, kept = docs, rows(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given, want = stage(spark, given, SF_DIR), plain[name](kept)
        assert given.dtypes == docs.dtypes
        kept = rows(given)
        assert kept == sorted(want, key=lambda d: d["doc_id"]), name
    mixed = rows(corpus_pipeline.run(spark, SF_DIR))
    assert [r["doc_id"] for r in mixed] == [d["doc_id"] for d in kept]
    sizes, taken = Counter(), Counter()
    for d in kept:
        sizes[d["source"]] += len(d["text"].encode().split())
    target = plain_targets(sizes)
    for r in mixed:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    assert {s: int(target[s] + 0.5) for s in sizes} == dict(taken)


def test_odd_rows_pass_all_stages(spark):
    good = " ".join(f"word{i}" for i in range(80))
    odd = [(None, None, None, None, None, "a"), (1, "", "en", None, 0, "b"), (2, good, None, None, None, "c"), (2, good, None, None, None, "c"),
           (None, good + "\nmore", "en", "s", 5, None), (3, "word " * 40_000, "en", "s", 5, None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, removed_lines string")
    found = []
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, SF_DIR)
        found.append(sorted(str(r.doc_id) for r in frame.collect()))
    # of the null row only the last word is new, which is no repeat; rows without an id are not told apart
    assert found == [["2", "None"], []]
