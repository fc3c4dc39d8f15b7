import random
import re

import pytest

from logsieve.llm.line_dedup import dedup_lines, patience, without_repeats

MIN = 12


def words(line):
    return re.findall(r"[^\x20\x09-\x0d]+", line)


def in_a_block(lines, i, earlier):
    """Whether line i lies in a common stretch of MIN words with a document."""
    a = [(k, tuple(words(x))) for k, x in enumerate(lines) if words(x)]
    b = [tuple(words(x)) for x in earlier if words(x)]
    at = next(n for n, (k, _) in enumerate(a) if k == i)
    for j in range(len(b)):
        if b[j] != a[at][1]:
            continue
        low = high = 0
        while at - low - 1 >= 0 and j - low - 1 >= 0 and a[at - low - 1][1] == b[j - low - 1]:
            low += 1
        while at + high + 1 < len(a) and j + high + 1 < len(b) and a[at + high + 1][1] == b[j + high + 1]:
            high += 1
        if sum(len(w) for _, w in a[at - low : at + high + 1]) >= MIN:
            return True
    return False


def corpus(seed):
    rng = random.Random(seed)
    line = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([2, 5, 14])))
    passages = [[line() for _ in range(rng.randrange(1, 5))] for _ in range(12)]
    texts = []
    for _ in range(70):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            parts += rng.choice(passages) if rng.random() < 0.6 else [line()]
            parts += [""] * rng.randrange(2)
        texts.append("\n".join(parts))
    texts += [texts[5]] * 8 + ["", " \n ", texts[6].replace(" ", "  "), "\n".join(passages[0] * 5), "one line"]
    return texts


def test_patience():
    assert patience([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert patience([5, 1, 2, 6], [7, 1, 2, 8, 1]) == [(1, 1), (2, 2)] or patience([5, 1, 2, 6], [7, 1, 2, 8, 1])[0][0] in (1, 2)
    assert patience([], [1]) == [] and patience(list(range(2000)), list(range(2000))) == [(i, i) for i in range(2000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    texts = corpus(seed)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(900, None, "x"), (None, texts[5], "x"), (3, texts[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed_lines string")
    got = dedup_lines(docs, MIN).collect()
    assert len(got) == len(rows)
    assert [r for r in got if r.doc_id == 900][0].text is None
    for r in got:
        if r.text is None:
            continue
        lines = (texts[5] if r.doc_id is None else texts[r.doc_id]).split("\n")
        earlier = texts if r.doc_id is None else texts[: r.doc_id]
        gone = set(r.removed_lines or [])
        assert r.text == "\n".join(x for i, x in enumerate(lines) if i not in gone)
        assert (r.removed_words or 0) == sum(len(words(lines[i])) for i in gone)
        blocks = {i for i, x in enumerate(lines) if words(x) and any(in_a_block(lines, i, t.split("\n")) for t in earlier)}
        assert gone == blocks, r.doc_id
        assert all(e < r.doc_id if r.doc_id is not None else True for e in r.earlier_ids or [])
    kept = without_repeats(docs, MIN)
    assert kept.dtypes == docs.dtypes
    lost = {r.doc_id for r in got if r.removed_lines and not words(r.text)}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got} - lost and lost
    assert dedup_lines(docs.limit(0), MIN).count() == 0


def test_hot_group(spark):
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(20)) for i in range(6))
    docs = spark.range(2000).selectExpr("id AS doc_id", f"'{text}' AS text")
    got = dedup_lines(docs, 50)
    assert got.where("removed_lines IS NULL").select("doc_id").collect()[0].doc_id == 0
    assert got.where("text = '' AND removed_words = 120 AND earlier_ids = array(0L)").count() == 1999


def test_a_block_is_taken_whole_whoever_had_its_parts_first(spark):
    """The first document has the head of a block, the second head and tail: the third loses both."""
    line = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    x, y = line("x", 60), line("y", 45)
    texts = [f"{x}\n{line('a', 30)}", f"{x}\n{y}\n{line('b', 30)}", f"{x}\n{y}\n{line('c', 30)}", f"{line('d', 9)}\n{y}\n{x}\n{y}"]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    got = {r.doc_id: r for r in dedup_lines(docs, 50).collect()}
    assert got[1].removed_lines is None and got[2].removed_lines == [0]
    assert got[3].removed_lines == [0, 1] and got[3].removed_words == 105 and got[3].text == line("c", 30)
    assert got[4].removed_lines == [2, 3]
