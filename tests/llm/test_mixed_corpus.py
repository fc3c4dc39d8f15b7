import random
from collections import Counter, defaultdict

from logsieve.llm.mixing import mix, mixed, mixed_texts, schedule, source_targets
from test_mixing import rows_for


def test_pieces_are_the_mix(spark):
    rows = [(i, t and " ".join(f"{i}x{k}" for k in range(t.count("w"))), s, x) for i, t, s, x in rows_for(random.Random(3), 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    pieces = mixed(docs, block_words=16)
    got = sorted(mixed_texts(docs, pieces).collect(), key=lambda r: (r.slot, r.at))
    digest = mix(docs, block_words=16).collect()
    taken, want, slots = Counter(), Counter(), defaultdict(list)
    for r in got:
        assert r.text.split() == [f"{r.doc_id}x{k}" for k in range(r.from_word, r.to_word)]
        taken[r.doc_id, r.source] += r.to_word - r.from_word
        slots[r.slot].append(r)
    for r in digest:
        want[r.doc_id, r.source] += r.taken
    assert taken == +want
    # every slot of the schedule holds its block's words one after the other
    sized = spark.createDataFrame([(r.source, r.size) for r in digest], "source string, size long")
    targets = source_targets(sized, (5, 2, 1), 1.5, 2.0)
    no = {r.no: (r.source, r.source_size) for r in targets.collect()}
    plan = {r.slot: r for r in schedule(targets, 16).collect()}
    assert set(plan) == set(slots)
    for slot, parts in slots.items():
        p, at = plan[slot], 0
        for r in parts:
            assert (r.source, r.lap, r.block, r.at) == (no[p.no][0], p.lap, p.block, at)
            at += r.to_word - r.from_word
        assert at == min(p.upto, no[p.no][1] - 16 * p.block)
    assert mixed(docs.limit(0)).count() == 0
