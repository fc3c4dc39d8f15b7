"""Whitening against numpy over the distinct vectors."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from logsieve.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, weight="one", most=4):
    kept = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(np.float32(c)) and abs(256 * float(np.float32(c))) < 2**63 for c in v)]
    d = max((len(x) for _, x in kept), default=0)
    kept = [(i, x + (0,) * (d - len(x))) for i, x in kept]
    fit = sorted({x for _, x in kept})
    counts = [sum(y == x for _, y in kept) if weight == "count" else 1 for x in fit]
    n, sums = sum(counts), [sum(c * x[j] for c, x in zip(counts, fit)) for j in range(d)]
    mean = np.array([s / n for s in sums])
    y = np.array(fit, float) - mean
    cov = (y * np.array(counts)[:, None]).T @ y / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    out = []
    for i, x in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for k, e in enumerate(values):
            white = (np.array(x, float) - mean) @ vectors[:, k] / math.sqrt(e) if e > 1e-12 * np.trace(cov) else None
            out.append((i, k + 1, n, deviation if deviation < 2**63 else None, white, e / np.trace(cov) if np.trace(cov) else None))
    return out


def compared(got, want):
    """Rows agree, whatever the sign of a component."""
    key = lambda r: (r[1], r[0] is not None, r[0] or 0, r[3] or 0)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for k in {r[1] for r in want}:
        a, b = ([r[4] for r in side if r[1] == k] for side in (got, want))
        assert [v is None for v in a] == [v is None for v in b]
        a, b = (np.array([v for v in side if v is not None]) for side in (a, b))
        assert min(np.abs(a - b).max(initial=0), np.abs(a + b).max(initial=0)) < 1e-8
        assert [r[5] for r in got if r[1] == k] == pytest.approx([r[5] for r in want if r[1] == k], rel=1e-9)


def found(spark, rows, **kw):
    out = whiten(spark.createDataFrame(rows, SCHEMA).repartition(3), **kw).collect()
    assert all(r.identity_error is None or r.identity_error < 1e-9 for r in out)
    return [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in out]


def test_given_vectors(spark):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{path}'").fetchall()
    compared([tuple(r)[:6] for r in whiten(spark.read.parquet(path)).collect()], plain(rows))


@pytest.mark.parametrize("weight", ["one", "count"])
def test_copies_nulls_and_odd_lengths(spark, weight):
    rng = np.random.default_rng(3)
    base = [(i, (rng.normal(size=5) * [4, 3, 2, 1, 0.5]).tolist()) for i in range(60)]
    odd = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [float("nan")] * 5), (103, [float("inf")] + [0.0] * 4), (104, [1e30] * 5),
           (105, [0.5, -0.0]), (106, []), (None, base[0][1]), (0, base[0][1]), (0, base[0][1])]
    rows = base + odd + [(200 + i, base[1][1]) for i in range(40)]
    compared(found(spark, rows, weight=weight), plain(rows, weight))


def test_no_variance_few_dimensions_and_empty_tables(spark):
    alike = sorted(found(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])]))
    assert alike == [(i, k, 1, 0, None, None) for i in (1, 2) for k in (1, 2)]
    flat = [(i, [float(i), 1.0, 2.0 * i]) for i in range(9)]
    compared(found(spark, flat), plain(flat))
    for nothing in ([], [(1, None)], [(1, [])]):
        assert found(spark, nothing) == []


def test_sums_beyond_a_long(spark):
    rows = [(1, [2.0**54, 0.0]), (2, [-(2.0**54), 1.0]), (3, [2.0**30, 1.0])]
    got, want = found(spark, rows), plain(rows)
    assert sorted((r[0], r[1], r[2], r[3] is None) for r in got) == sorted((r[0], r[1], r[2], r[3] is None) for r in want)


def test_clashing_columns(spark):
    rows = [(i, [float(i % 3), float(i % 5)]) for i in range(12)]
    given = spark.createDataFrame(rows, SCHEMA)
    wide = given.withColumns({c: F.lit(1) for c in ("x", "k1", "k2", "copies", "id", "n", "whitened", "component")})
    want = sorted((r.vec_id, r.component, r.deviation) for r in whiten(given).collect())
    assert sorted((r.vec_id, r.component, r.deviation) for r in whiten(wide).collect()) == want
