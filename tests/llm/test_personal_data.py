import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from logsieve.llm.personal_data import KINDS, find_personal_data, mod97, running_totals

SF_DIR = "/root/testdata/sf0.01"


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p.lstrip("0")[:4] or 0) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
]


def plain(text):
    return {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if ok(m[0])] for k, p, ok in PLAIN}


TEXTS = [
    None, "", "no data", "mail a@b.co, x.y+z@sub.example.org! a@b@c.d a@b.co_x@y.com .@-.-", "@@a@.b a@b. a@b..c",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3 999.1.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111",
    "+49 (30) 1234-5678. +1 2 +1-800-555-0199x +123 ", "é漢👩 tel +34 600 123 456 fin a@b.es", "a" * 40_000, "1" * 40_000,
    "1-" * 20_000, "a.b@c.d " * 2000, "+1 2345678 90 " * 700, "x@y" * 3000, "\n4111111111111111\n", "5500000000000004 5500000000000004",
    "1.1.1.1@2.2.2.2 5@1.2.3.4.5", "00000000000000 0000000000000000000", "IBAN DE89 3704 0044 0532 0130 00 and DE88 3704 0044 0532 0130 00",
    "10.0.0.1 0.0.0.0 host 192.168.0.10 10.00.1.1 00.000.0.256 0.0.0.00000255 1.0.0. 256.0.0.1 255.255.255.255 0.0.0.0.0",
    "0" * 30_000 + ".0.0.0 0.0.0." + "0" * 30_000 + "256", "bank DE89370400440532013000, GB82 WEST 1234 5698 7654 32 XX00 1234",
    "mail me at a@b.co or fax +49 30 1234567, my ssn: 219-09-9999; card 4111111111111111 and ip 8.8.8.8",
    "ssn 123-45-6789 but order 123-45-6789" + " " * 60 + "ref 987-65-4321 and 321-54-9876",
]


def compare(docs, texts):
    rows = docs.collect()
    for r in rows:
        want = plain(texts(r))
        base = ",".join(s for k in want for s in want[k])
        assert [r[f"n_{k}"] for k in want] == [len(v) for v in want.values()], (r, want)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert r.spans.startswith(base) and len(r.spans.split(",")) == len(r.scores.split(","))
    return rows


def test_table(spark):
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None), (None, None, None)],
                                 "doc_id long, text string, spans string")
    got = compare(find_personal_data(docs), lambda r: None if r.doc_id is None else TEXTS[r.doc_id])
    assert len(got) == len(TEXTS) + 2
    by = {r.doc_id: r for r in got}
    assert by[19].n_iban == 1 and by[24].n_ssn == 1 and "ssn:4:15" in by[24].spans
    assert by[20].n_ip == 7 and by[21].n_ip == 1 and by[0].n_ip == 0
    assert find_personal_data(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")
def test_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(compare(find_personal_data(docs), lambda r: texts[r.doc_id])) == len(texts)


def plain_mod97(iban):
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def plain_scored(text):
    """Spans and scores of all kinds; a context word counts within 40 characters and up to the next match."""
    kinds = [(k, p, ok, 0.8 if k in ("ip", "card") else 0.5, False) for k, p, ok in PLAIN]
    kinds.append(("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
                  lambda s: 15 <= len(s.replace(" ", "")) <= 34 and plain_mod97(s.replace(" ", "")), 0.8, False))
    kinds.append(("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda s: True, 0.5, True))
    context = {k.name: k.context for k in KINDS}
    spans, scores = [], []
    for kind, pattern, ok, sure, needs in kinds:
        found = [m for m in re.finditer(pattern, text or "")]
        edges = [0, *[e for m in found for e in m.span()], len(text or "")]
        for i, m in enumerate(found):
            before, after = text[edges[2 * i] : m.start()][-40:], text[m.end() : edges[2 * i + 3]][:40]
            near = re.search(context[kind], f"{before} {after}".lower()) is not None
            if ok(m[0]) and (near or not needs):
                spans.append(f"{kind}:{m.start()}:{m.end()}")
                scores.append(f"{sure + 0.2 * near:.1f}")
    return ",".join(spans), ",".join(scores)


def test_all_spans_and_scores(spark):
    given = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in find_personal_data(given).collect():
        assert (r.spans, r.scores) == plain_scored(TEXTS[r.doc_id]), TEXTS[r.doc_id]
    if os.path.isdir(SF_DIR):
        docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
        texts = {r.doc_id: r.text for r in docs.collect()}
        for r in find_personal_data(docs).collect():
            assert (r.spans, r.scores) == plain_scored(texts[r.doc_id]), r.doc_id


def test_running_totals_and_mod97(spark):
    lists = [[], [5], list(range(1000)), [1] * 256, [2] * 257]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<int>")
    for r in rows.select("i", running_totals(F.col("v")).alias("t")).collect():
        assert r.t == [sum(lists[r.i][: k + 1]) for k in range(len(lists[r.i]))]
    codes = {"GB82WEST12345698765432": True, "GB82WEST12345698765433": False, "DE89370400440532013000": True}
    frame = spark.createDataFrame([(c,) for c in codes], "c string")
    assert {r.c: r.ok for r in frame.select("c", mod97(F.col("c")).alias("ok")).collect()} == codes
