import os
import zlib

import numpy as np
import pytest

from logsieve.llm.quality_model import BOUNDARY, FEATURES, GRAMS, dealt, features, fit, fit_table, gram_shares, loss_sums, newton, score_quality, value_at
from test_quality_rules import measured

SF_DIR = "/root/testdata/sf0.01"
GOOD = " ".join(f"word{i} and then" for i in range(60))


def test_fit_orders_pairs_and_cuts_at_the_share():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, len(FEATURES)))
    raw = 2 * x[:, 0] - x[:, 3]
    good = raw > np.quantile(raw, 0.2)
    model = fit(x, good)
    scores = x @ np.array(model.weights)
    assert ((scores > model.cut) == good).mean() > 0.97
    assert fit(x, np.ones(2000, bool)).weights == (0.0,) * len(FEATURES)


def test_table(spark):
    rows = [(i, GOOD if i % 2 else f"bad {i} " * 100, "k") for i in range(60)] + [(None, None, None), (3, GOOD, "k"), (100, "", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, bool(i % 2)) for i in range(60)] + [(1, True), (2, None), (None, False)], "doc_id long, good boolean")
    got = score_quality(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(text.encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if r.doc_id is not None and r.doc_id < 100:
            assert r.predicted == r.doc_id % 2
    assert {r.score for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert score_quality(docs.limit(0), labels).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")
def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    got = score_quality(spark.read.parquet(f"{SF_DIR}/documents.parquet"), labels.selectExpr("doc_id", "quality = 1 AS good"))
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) >= 0.97


def plain_grams(text):
    data, counts = (text or "").encode().lower(), [0] * GRAMS
    for a, b, c in zip(data, data[1:], data[2:]):
        h = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF
        counts[((h * 0x27D4EB2F) & 0xFFFFFFFF) >> 26] += 1
    return [(n / max(1, sum(counts))) ** 0.5 for n in counts]


def plain_features(text):
    import math
    import re

    m, text = measured(text), text or ""
    words, capitals = text.encode().split(), len(re.findall("[A-Z]", text))
    lines = sum(bool(x.encode().split()) for x in text.split("\n"))
    lettered = len(re.findall(r"[^\W\d_][^\x20\x09-\x0d]*", text))
    per = lambda a, b: a / max(1, b)
    n = m["n_words"]
    return [math.log1p(n), per(m["n_repeat_words"], n), math.log1p(10 * per(m["n_symbols"], n)), per(lettered, n), per(capitals, m["word_chars"]),
            per(m["n_dup_lines"], lines), math.log1p(per(m["word_chars"], n)), math.log1p(per(n, lines)), 1 / (1 + n / 20), *plain_grams(text)]


def plain_weights(x, good):
    """Bradley-Terry weights of the dealt pairs, by gradient steps on the penalised loss instead of Newton's."""
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    rng, up, down = np.random.default_rng(7), np.flatnonzero(good), np.flatnonzero(~good)
    n = 4 * max(len(up), len(down))
    deal = lambda i: np.concatenate([rng.permutation(i) for _ in range(-(-n // len(i)))])[:n]
    d = z[deal(up)] - z[deal(down)]
    w = speed = np.zeros(x.shape[1])
    penalty = np.array([1.0] * len(FEATURES) + [max(1.0, 0.025 * n)] * GRAMS)
    rate = 1 / (np.linalg.eigvalsh(d.T @ d)[-1] / 4 + penalty.max())
    for _ in range(20_000):
        w_before, ahead = w, w + 0.99 * speed
        w = ahead + rate * (d.T @ (1 / (1 + np.exp(d @ ahead))) - penalty * ahead)
        speed = w - w_before
        if np.abs(speed).max() < 1e-12:
            break
    return w / np.where(x.std(0) > 0, x.std(0), 1)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")
def test_features_pairs_and_scores_worked_out_again(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").selectExpr("doc_id", "quality = 1 AS good")
    got = {r.doc_id: r.score for r in score_quality(docs, labels).collect()}
    texts, good = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.good for r in labels.collect()}
    x = {i: np.array(plain_features(t)) for i, t in texts.items()}
    assert all(np.allclose(x[i][len(FEATURES):], gram_shares(t)) for i, t in texts.items())
    taught = [i for i in x if i in good and zlib.crc32(str(i).encode()) % 5]
    order = {r.id: r.h for r in spark.createDataFrame([(i,) for i in taught], "id long").selectExpr("id", "xxhash64(id) AS h").collect()}
    taught.sort(key=order.get)
    a, y = np.stack([x[i] for i in taught]), np.array([good[i] for i in taught])
    w = plain_weights(a, y)
    cut = np.quantile(a @ w, (~y).mean(), method="midpoint")
    for i, score in got.items():
        raw = np.clip(x[i] @ w - cut, -30, 30) + np.log(BOUNDARY / (1 - BOUNDARY))
        assert abs(score - 1 / (1 + np.exp(-raw))) < 1e-4, i


def taught_rows(spark, texts):
    rows = [(i, t, "bad" not in t) for i, t in enumerate(texts)]
    made = features(spark.createDataFrame(rows, "doc_id long, text string, good boolean").drop("good"))
    return made.join(spark.createDataFrame([(i, g) for i, _, g in rows], "id long, good boolean"), "id")


def plain_table(taught):
    rows = taught.selectExpr("*", "xxhash64(id) AS h").orderBy("h").collect()
    return np.array([[*(r[c] for c in FEATURES), *r.grams] for r in rows]), np.array([r.good for r in rows])


def test_every_labelled_document_teaches(spark):
    """Only the last documents of the order have what tells the labels, so a sample of the first ones would not learn it."""
    ids = [r.id for r in spark.range(400).selectExpr("id", "xxhash64(id) AS h").orderBy("h").collect()]
    late = set(ids[200:])
    texts = [("bad " if i % 2 else "fine ") + f"word{i} and then " * 30 + ("### " * 40 if i % 2 and i in late else "") for i in range(400)]
    taught = taught_rows(spark, texts)
    x, good = plain_table(taught)
    symbols = FEATURES.index("symbol_rate")
    assert not x[:200, symbols].any() and x[200:, symbols].any()
    model = fit_table(taught, block=100)
    # the same, block after block: rows of a label are dealt evenly over the blocks
    spread = np.where(x.std(0) > 0, x.std(0), 1)
    parts = {label: np.flatnonzero(good == label) for label in (True, False)}
    blocks = [np.sort(np.concatenate([p[[k * 4 // len(p) == b for k in range(len(p))]] for p in parts.values()])) for b in range(4)]
    assert sorted(np.concatenate(blocks)) == list(range(400))
    d = np.concatenate([dealt(x[b] / spread, good[b], 4, 7) for b in blocks])
    w = newton(lambda w: loss_sums(d, w), x.shape[1], 1.0, 40) / spread
    assert np.allclose(model.weights, w, atol=1e-6) and abs(w[symbols]) > 0.1
    assert abs(model.cut - np.quantile(x @ w, (~good).mean(), method="midpoint")) < 1e-5


def test_one_block_is_the_fit_in_memory_and_a_rare_label_is_in_every_block(spark):
    taught = taught_rows(spark, [("bad " if i % 40 == 0 else "") + f"word{i * i} and then " * (5 + i % 9) for i in range(90)])
    x, good = plain_table(taught)
    model, plain = fit_table(taught), fit(x, good)
    assert np.allclose(model.weights, plain.weights, atol=1e-6) and abs(model.cut - plain.cut) < 1e-5
    many = fit_table(taught, block=10)  # nine blocks, three bad documents
    raw = x @ np.array(many.weights)
    assert (raw[good].min() > raw[~good].max()) and set(many.weights) != {0.0}


def test_value_at_a_place_is_exact(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=3000), np.full(1000, 0.25), rng.normal(size=1000) * 1e-12, [1e9, -1e9, np.nextafter(0.25, 1)]])
    table = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
    ordered = np.sort(values)
    assert all(value_at(table, "v", k) == ordered[k] for k in (0, 1, 2000, 2500, 3500, 4200, len(values) - 1))
