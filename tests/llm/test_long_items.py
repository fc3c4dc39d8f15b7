"""Recall by length of the item and kind of edit, at the bound; unrelated texts are left alone."""

import random

import pytest

from logsieve.llm.decontamination import allowed, find_items

LENGTHS = {5: 150, 10: 150, 15: 150, 20: 150, 25: 150, 30: 150, 35: 150, 40: 150, 59: 120, 100: 80, 200: 40, 400: 20, 1000: 8}


@pytest.mark.parametrize("kind", ["insert", "delete", "change", "mixed"])
def test_items_with_edits_at_the_bound(spark, kind):
    rng = random.Random(kind)
    items, docs = [], []
    for n, times in LENGTHS.items():
        for _ in range(times):
            item, i = [f"w{rng.randrange(3000)}" for _ in range(n)], len(items)
            items.append((i, n, " ".join(item)))
            for at in sorted(rng.sample(range(n), allowed(n)), reverse=True):
                done = kind if kind != "mixed" else rng.choice(["insert", "delete", "change"])
                item[at : at + 1] = {"insert": [item[at], "new"], "delete": [], "change": ["other"]}[done]
            noise = [f"w{rng.randrange(3000)}" for _ in range(100)]
            docs.append((i, " ".join(noise[:50] + item + noise[50:])))
    found = find_items(spark.createDataFrame(docs, "doc_id long, text string"),
                       spark.createDataFrame([(i, t) for i, _, t in items], "item_id long, text string"))
    pairs = {(r.doc_id, r.item_id) for r in found.collect()}
    share = {n: sum((i, i) in pairs for i, m, _ in items if m == n) / times for n, times in LENGTHS.items()}
    print(kind, share)
    assert min(share.values()) >= 0.95, share
    long = {i for i, n, _ in items if n >= 15}
    assert all(i == k for i, k in pairs if k in long)
