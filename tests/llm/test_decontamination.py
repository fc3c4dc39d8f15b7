import random

import numpy as np
import pytest

from logsieve.llm.decontamination import allowed, distance, embed, find_items, keys, run_length, without_items
from logsieve.llm.words import byte_words


def plain_distance(text, item):
    """Least edit distance of the item to a part of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        before, row = row, [i]
        for j, v in enumerate(text, 1):
            row.append(min(before[j - 1] + (w != v), before[j] + 1, row[j - 1] + 1))
    return min(row)


def changed(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        i, kind = rng.randrange(len(words)), rng.randrange(3)
        words[i : i + 1] = [] if kind == 0 and len(words) > 1 else ["new"] if kind == 1 else [words[i], "new"]
    return words


def test_distance_and_place():
    rng = random.Random(2)
    for _ in range(300):
        text = [rng.randrange(4) for _ in range(rng.randrange(1, 14))]
        item = [rng.randrange(4) for _ in range(rng.randrange(1, 8))]
        d, start, end = distance(np.array(text), np.array(item))
        assert d == plain_distance(text, item)
        part = text[start:end]
        rows = list(range(len(part) + 1))
        for i, w in enumerate(item, 1):
            rows = [i] + [0] * len(part) if not part else _next(rows, part, w, i)
        assert rows[-1] == d


def _next(before, part, w, i):
    row = [i]
    for j, v in enumerate(part, 1):
        row.append(min(before[j - 1] + (w != v), before[j] + 1, row[j - 1] + 1))
    return row


def test_embedding_keeps_equal_rows_together():
    words = np.array([[1, 2, 3, 4], [1, 2, 3, 4], [9, 8, 7, 6]])
    assert (embed(words, 0)[0] == embed(words, 0)[1]).all() and (keys(words)[0] == keys(words)[1]).all()
    assert (keys(words)[0] != keys(words)[2]).any()
    assert [run_length(n) for n in (1, 4, 5, 10, 15, 59)] == [1, 4, 2, 3, 3, 4]


@pytest.mark.parametrize("seed", [1, 2])
def test_found_as_brute_force_finds(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 9, 20, 35]))]) for i in range(25)]
    docs = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 40, 300]))]
        if i % 2:
            k, item = rng.choice(items)
            at = rng.randrange(len(words) + 1)
            words[at:at] = changed(rng, item, rng.randrange(0, len(item) // 4 + 1))
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(words).title()))
    docs += [(500, None), (501, ""), (None, " ".join(items[3][1])), (7, " ".join(items[4][1])), (502, " ".join(items[5][1] * 400))]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    bench = [(i, " ".join(w), "y") for i, w in items] + [(90, None, None), (91, " ", None), (0, " ".join(items[0][1]), "z")]
    item_frame = spark.createDataFrame(bench, "item_id long, text string, doc_id string")
    best = {}
    for i, t in docs:
        words = [w.decode() for w in byte_words(t)]
        for k, item in items:
            d = plain_distance(words, item)
            if d <= allowed(len(item)):
                best[i, k] = min(d, best.get((i, k), d))
    got = {(r.doc_id, r.item_id): r.distance for r in find_items(frame, item_frame).collect()}
    assert set(got) <= set(best) and len(got) >= 0.97 * len(best)
    assert all(got[k] >= best[k] for k in got) and all(k in got for k, d in best.items() if d == 0)
    kept = without_items(frame, item_frame).collect()
    hit = {(i, t) for i, t in docs if any((i, k) in got and plain_distance([w.decode() for w in byte_words(t)], item) <= allowed(len(item)) for k, item in items)}
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted((str(i), str(t)) for i, t in docs if (i, t) not in hit)
    assert find_items(frame.limit(0), item_frame).count() == 0 and find_items(frame, item_frame.limit(0)).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    from logsieve.llm import decontamination

    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 30)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(20))) for i in range(5)]
    docs = spark.createDataFrame([(i, f"some words {t} more words") for i, t in items], "doc_id long, text string")
    got = find_items(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.distance, r.n_words, r.start) for r in got) == [(i, i, 0, 20, 2) for i in range(5)]


def test_clean_rows_that_share_an_id_or_have_none_stay(spark):
    item = " ".join(f"i{j}" for j in range(20))
    rows = [(None, f"a {item} b"), (None, "clean words"), (7, f"c {item}"), (7, "other clean words"), (8, "more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for kind in ("smallint", "string", "decimal(5,0)", "int"):
        items = spark.createDataFrame([("1", item)], "item_id string, text string").selectExpr(f"CAST(item_id AS {kind}) AS item_id", "text")
        assert sorted(map(str, without_items(docs, items).collect())) == sorted(map(str, [
            r for r in docs.collect() if "clean" in r.text or r.text == "more"]))
        assert {str(r.item_id) for r in find_items(docs, items).collect()} == {"1"}
