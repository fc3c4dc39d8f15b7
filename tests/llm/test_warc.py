"""Archives written, normalised and read back against the rows they were made from."""

import gzip
import hashlib
import io
import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from logsieve.llm import warc

SCHEMA = "page_id long, url string, html string"


def plain(rows, least=1000):
    best = {}
    for page, _, html in rows:
        payload = (html or "").encode()
        if len(payload) >= least:
            held = best.get(payload)
            best[payload] = page if held is None else held if page is None else max(held, page)
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        revisit = payload in best and best[payload] != page
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", best[payload] if revisit else None))
    return sorted(out, key=str)


def found(spark, rows, **kw):
    return sorted((tuple(r) for r in warc.archive_pages(spark.createDataFrame(rows, SCHEMA).repartition(3), **kw).collect()), key=str)


def made_up(seed=3, n=200):
    rng = random.Random(seed)
    same = ["é" * 600, "a" * 999, "b" * 1000, "WARC/1.1\r\n\r\n" * 200, "", "short"]
    rows = [(i, f"http://h/{i}", rng.choice(same) if rng.random() < 0.6 else "".join(rng.choices("xyz \r\n\x00", k=rng.randint(0, 3000)))) for i in range(n)]
    return rows + [(None, None, None), (None, "http://x\r\nWARC-Type: warcinfo", same[0]), (5, "u", same[0]), (5, "u", same[0]), (n, "l", "z" * 300_000),
                   (None, "n", "only nulls" * 200), (None, "n", "only nulls" * 200)]


def test_pages_come_back(spark):
    rows = made_up()
    assert found(spark, rows) == plain(rows)


def test_small_archives_and_no_rows(spark):
    rows = made_up(4, 60)
    assert found(spark, rows, most_bytes=2000) == plain(rows)
    assert found(spark, []) == []


def test_archives_as_any_reader_sees_them(spark, tmp_path):
    """A raw archive is one gzip member; a normalised one has a member per record, found by the index beside it."""
    rows = made_up(5, 40)
    warc.archive_pages(spark.createDataFrame(rows, SCHEMA).coalesce(1), folder=str(tmp_path / "w")).collect()
    raw = [p.read_bytes() for p in (tmp_path / "w/raw").iterdir()]
    for data in raw:
        one = zlib.decompressobj(31)
        one.decompress(data)
        assert one.eof and not one.unused_data
    for path in (tmp_path / "w/normal").glob("*.warc.gz"):
        data, at = path.read_bytes(), 0
        entries = [json.loads(line) for line in (path.parent / f"{path.name}.idx").read_text().splitlines()]
        for e in entries:
            assert e["offset"] == at
            member = zlib.decompressobj(31)
            text = member.decompress(data[at : at + e["length"]])
            assert member.eof and not member.unused_data and text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
            at += e["length"]
        assert at == len(data) and len(entries) == len(rows) + 1 and entries[0]["type"] == "warcinfo"
        assert gzip.decompress(data) in [gzip.decompress(r) for r in raw]


def test_normalising_by_stream():
    """Records larger than any buffer, archives that already have several members, and broken ones."""
    records = [b"".join(warc.page_record(i, f"u{i}", b"p" * n, warc.digest_name(b"p" * n), None, False)) + b"\r\n\r\n"
               for i, n in enumerate([0, 10, 5_000_000, 1])]
    whole = gzip.compress(b"".join(records))
    for given in (whole, b"".join(map(gzip.compress, records)), gzip.compress(records[0]) + gzip.compress(b"".join(records[1:]))):
        out = io.BytesIO()
        entries = list(warc.normalised(io.BytesIO(given), out))
        assert [gzip.decompress(out.getvalue()[e["offset"] : e["offset"] + e["length"]]) for e in entries] == records
    for broken in (whole[:-20], gzip.compress(b"no record\n"), gzip.compress(records[1][:-6]), gzip.compress(b"x" * 3_000_000)):
        with pytest.raises(ValueError):
            list(warc.normalised(io.BytesIO(broken), io.BytesIO()))


def test_payloads_and_urls_come_back(spark, tmp_path):
    rows = [(1, "http://a/ü?x=1", "hé\r\n\r\nho"), (2, None, None)]
    pages = spark.createDataFrame(rows, SCHEMA).select(F.col("page_id").alias("page"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    archives = warc.write_archives(warc.with_revisits(pages), str(tmp_path / "raw"))
    index = warc.normalise_archives(archives, str(tmp_path / "raw"), str(tmp_path / "normal"))
    read = warc.read_records(index, str(tmp_path / "normal"), with_payload=True)
    assert sorted((r.page, r.url, r.payload) for r in read.collect()) == [(1, "http://a/ü?x=1", "hé\r\n\r\nho"), (2, None, "")]


def test_clashing_columns(spark):
    given = spark.createDataFrame(made_up(6, 20), SCHEMA)
    wide = given.withColumns({c: F.lit(1) for c in ("page", "payload", "digest", "same", "owner", "revisit", "refers_to", "offset")})
    assert sorted(map(str, warc.archive_pages(wide).collect())) == sorted(map(str, warc.archive_pages(given).collect()))
