import re
from collections import Counter

from logsieve.llm.quality_rules import POLICIES, RULES, ablations, judge, keep_good, ledger, mask

GOOD = " ".join(f"word{i} and then" for i in range(60)) + "\n" + "another line of words"
TEXTS = [
    None, "", " \n\t", "one", "a b c a b c", "a b c d a b c", "x x x x x x x", GOOD, GOOD + "\n" + GOOD, "a\n\na\n \na \nb",
    "# $ %% <>|& *", "LOUD " * 60, "1 2 3 4 5 " * 20, "é ñ ü 漢字 " * 30, "w" * 3000, "same three words " * 3000, "a b\x0bc\x0cd\re",
    " a b", "x y z y",
]


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(covered),
    }


def frame(spark):
    rows = [(i, t, "k") for i, t in enumerate(TEXTS)] + [(None, GOOD, None), (7, GOOD, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string")


def test_measurements_and_base(spark):
    docs = frame(spark)
    got = judge(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        want = measured(GOOD if r.doc_id is None else TEXTS[r.doc_id])
        assert {k: r[k] for k in want} == want, r
        base = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert r.base_failed == base and not (base and r.kept)
    assert judge(docs.limit(0)).count() == 0


def test_policies_and_ablations(spark):
    docs = frame(spark)
    written = ledger(docs)
    rows = written.collect()
    full = mask("v1")
    assert full == (1 << len(RULES)) - 1 and mask("base") == 3 and set(POLICIES["base"]) <= set(POLICIES["v1"])
    got = {r.rule: (r.failed, r.failed_alone, r.kept_without) for r in ablations(written, "v1").collect()}
    for i, (name, _) in enumerate(RULES):
        bits = [r.failed_bits & full for r in rows]
        want = (sum(b >> i & 1 for b in bits), sum(b == 1 << i for b in bits), sum(b & ~(1 << i) == 0 for b in bits))
        assert got[name] == want, name
    kept = keep_good(docs).collect()
    assert sorted(map(str, kept)) == sorted(
        str(d) for d in docs.collect() if next(r for r in judge(docs).where("kept").collect() + [None] if r is None or r.doc_id == d.doc_id)
    )
