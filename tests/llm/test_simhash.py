import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from logsieve.llm.components import connected
from logsieve.llm.simhash import keep_one, links, near_duplicates, posting_masks

WORDS = [f"w{i}" for i in range(300)]


def plain_fingerprint(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values, limit=4):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in combinations(values, 2):
        if bin(a ^ b).count("1") <= limit:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def test_every_four_bytes_hold_a_posting():
    masks = [m & (1 << 64) - 1 for m in posting_masks()]
    assert len(masks) == 20
    for four in combinations(range(8), 4):
        kept = sum(0xFF << 8 * b for b in four)
        assert any(m & kept == m for m in masks)


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("most_bucket", [4096, 3])
def test_links_connect_as_brute_force_does(spark, most_bucket):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values)[:25]:
        for _ in range(6):
            for _ in range(rng.randint(1, 6)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values |= {0, (1 << 64) - 1, 7}
    values = sorted(values)
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long").withColumn("node", F.col("fp"))
    got = {r.node & (1 << 64) - 1: r.root for r in connected(links(fps, most_bucket)).collect()}
    want = plain_components(values)
    groups = {}
    for v in values:
        groups.setdefault(want[v], set()).add(v)
    found = {}
    for v in values:
        found.setdefault(got.get(v, signed(v)), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (7, 7)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(300)) and 5000 not in got
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(120):
        words = [rng.choice(WORDS) for _ in range(rng.choice([1, 3, 4, 40, 400]))]
        rows.append((i, " ".join(words)))
        if i % 3 == 0:
            rows.append((1000 + i, "\t".join(words).upper() + "\n"))
        if i % 4 == 0 and len(words) > 100:
            words[50] = "changed"
            rows.append((2000 + i, " ".join(words)))
    rows += [(3000, None), (3001, ""), (3002, " \n"), (None, "w1 w2"), (5, rows[5][1]), (3003, "x " * 100_000), (3004, "Ä ä İ  y z")]
    return [(i, t, "k") for i, t in rows]


def test_table(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fp_of = {(i, t): plain_fingerprint(t) for i, t, _ in rows}
    root = plain_components(sorted(set(fp_of.values())))
    least = {}
    for (i, _), v in fp_of.items():
        if i is not None:
            least[root[v]] = min(i, least.get(root[v], i))
    want = sorted((str(i), f"{fp_of[i, t]:016x}", least.get(root[fp_of[i, t]])) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    kept = keep_one(docs, near_duplicates(docs)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(least.values()))
    assert near_duplicates(docs.limit(0)).count() == 0


def test_hot_group_of_copies(spark):
    copies = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same text again and again here").alias("text"))
    assert {r.component_id for r in near_duplicates(copies).select("component_id").distinct().collect()} == {0}
