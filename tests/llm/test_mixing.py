import random
from collections import Counter, defaultdict

import pytest

from logsieve.llm.mixing import mix, schedule, source_targets


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Share by weight, stop at ``most`` and share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, target, free = share * sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > most * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in free}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= full
    return target


def rows_for(rng, n):
    rows = []
    for i in range(n):
        source = rng.choices(["a", "b", "ä", "Z", None, "", "c", "d"], [40, 5, 5, 5, 5, 5, 3, 1])[0]
        words = rng.choice([0, 1, 5, 60, 400])
        rows.append((i if i % 17 else None, rng.choice([None, ""]) if not words else "w\t" * words, source, "x"))
    return rows + rows[:5]


@pytest.mark.parametrize("block_words", [16, 4096])
def test_mix(spark, block_words):
    rows = rows_for(random.Random(block_words), 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mix(docs, block_words=block_words).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += (t or "").count("w")
    want, taken = plain_targets(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert taken[s] == int(want[s] + 0.5)
    assert Counter(map(tuple, mix(docs.repartition(7), block_words=block_words).collect())) == Counter(map(tuple, got))
    assert mix(docs.limit(0)).count() == 0


def test_schedule_is_even_at_every_time(spark):
    sized = spark.createDataFrame([(s, n) for s, n in [("a", 90_000), ("b", 20_000), ("c", 4_000), (None, 50_000)]], "source string, size long")
    targets = source_targets(sized, (5, 2, 1), 1.5, 2.0)
    slots = sorted(schedule(targets, 100).collect(), key=lambda r: r.slot)
    assert len({r.slot for r in slots}) == len(slots)
    total, seen = Counter(r.no for r in slots), Counter()
    for i, r in enumerate(slots, 1):
        seen[r.no] += 1
        for no, n in total.items():
            assert abs(seen[no] - n * i / len(slots)) < 8
    words = {r.no: int(r.target + 0.5) for r in targets.collect()}
    size = {r.no: r.source_size for r in targets.collect()}
    given = Counter()
    for r in slots:
        given[r.no] += min(r.upto, size[r.no] - 100 * r.block)
    assert dict(given) == words
