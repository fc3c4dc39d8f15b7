"""Whitening of integer vectors: each distinct vector once, with its multiplicity or one as its weight."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.session import materialise

_BLOCK = 4096
_SAFE = float(1 << 62)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``id, x``: every entry c, as a double, becomes the long floor(scale * c).

    Rows go whose vector is null, holds a null or an entry that is not finite, or one that gives no long.
    """
    c: Callable[[Column], Column] = lambda v: v.cast("double") * scale
    bound = float(1 << 63)
    whole = F.forall(vec_col, lambda v: F.coalesce((c(v) >= -bound) & (c(v) < bound), F.lit(False)))
    kept = vectors.where(F.col(vec_col).isNotNull()).where(whole)
    return kept.select(F.col(id_col).alias("id"), F.transform(vec_col, lambda v: F.floor(c(v)) + F.lit(0).cast("long")).alias("x"))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """``k1, k2, x, copies`` of every different vector of ``rows`` (``id, x``); the keys are hashes of it."""
    return _keyed(rows).groupBy("x").agg(F.count("*").alias("copies"), F.first("k1").alias("k1"), F.first("k2").alias("k2")).select(
        "k1", "k2", "x", "copies")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"k1": F.xxhash64("x"), "k2": F.xxhash64(F.lit(1), "x")})


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    if len(lengths) and lengths.min() == d:
        return flat[offsets[0] : offsets[-1]].reshape(len(lengths), d)
    out = np.zeros((len(lengths), d), np.int64)
    out[np.arange(d) < lengths[:, None]] = flat[offsets[0] : offsets[-1]]
    return out


def _sums(fit: DataFrame, d: int, weight: str) -> tuple[int, list[int]]:
    """Weights and weighted vectors added up exactly. A task gives one row per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            x, w = _matrix(batch.column(0), d), batch.column(1).to_numpy()
            n += int(w.sum())
            biggest = float(np.abs(x.astype(float)).max(initial=0)) * float(w.sum())
            part = (x * w[:, None]).sum(0).tolist() if biggest < _SAFE else [sum(int(a) * int(b) for a, b in zip(col, w)) for col in x.T]
            total = [a + b for a, b in zip(total, part, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([str(v) for v in (n, *total)])], names=["i", "v"])

    parts = fit.select("x", _weight(weight)).mapInArrow(run, "i int, v string")
    told = dict(parts.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect())
    return int(told.get(-1, 0)), [int(told.get(i, 0)) for i in range(d)]


def _weight(weight: str) -> Column:
    return (F.col("copies") if weight == "count" else F.lit(1).cast("long")).alias("w")


def _covariance(fit: DataFrame, mean: np.ndarray, n: int, weight: str) -> np.ndarray:
    """Products of the centred vectors, weighted, over the weights; tasks multiply blocks of vectors, Spark adds the rows."""
    d = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((d, d)), False
        for batch in batches:
            some = True
            for at in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(at, _BLOCK)
                y = _matrix(part.column(0), d) - mean
                total += (y * part.column(1).to_numpy()[:, None]).T @ y
        if some:
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    parts = fit.select("x", _weight(weight)).mapInArrow(run, "i int, j int, v double")
    table = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    cov = np.zeros((d, d))
    i, j, v = (c.to_numpy() for c in table.columns)
    cov[i, j] = cov[j, i] = v / n
    return cov


def fit_whitening(fit: DataFrame, weight: str = "one") -> dict:
    """What whitening needs of the distinct vectors ``fit``: ``n``, ``sums``, ``values``, ``vectors`` (columns), ``trace``."""
    d = fit.agg(F.max(F.size("x"))).first()[0] or 0
    n, sums = _sums(fit, d, weight)
    cov = _covariance(fit, np.array([s / n for s in sums]), n, weight) if n and d else np.zeros((d, d))
    values, vectors = np.linalg.eigh(cov)
    return {"n": n, "sums": sums, "values": values[::-1], "vectors": vectors[:, ::-1], "trace": float(np.trace(cov))}


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over the dimensions of (n * x - sum) squared, exact; null where that is no long."""
    reach = np.abs(x.astype(float)).max(initial=0) * n + max(map(abs, sums), default=0)
    if reach < 2.0**31 and reach * reach * max(1, len(sums)) < _SAFE:
        y = n * x - np.array(sums, np.int64)
        return (y * y).sum(1).tolist()
    found = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in found]


def whitened_vectors(fit: DataFrame, model: dict, components: int = 4) -> DataFrame:
    """``k1, k2, copies, deviation, whitened`` of every distinct vector; an entry is null where a component has no variance."""
    n, sums = model["n"], model["sums"]
    d = len(sums)
    values, most = model["values"][:components], model["trace"] * 1e-12
    told = values > most
    axes = model["vectors"][:, : len(values)] / np.where(told, np.sqrt(np.where(told, values, 1)), 1)
    mean = np.array([s / n for s in sums]) if n else np.zeros(d)
    sent = fit.sparkSession.sparkContext.broadcast((axes, mean, sums))  # dimensions times components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, mean, sums = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(at, _BLOCK)
                x = _matrix(part.column(2), d)
                flat = pa.array(((x - mean) @ axes).ravel(), mask=np.tile(~told, len(x)))
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(told), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(3), pa.array(_deviation(x, n, sums), pa.int64()), rows],
                    names=["k1", "k2", "copies", "deviation", "whitened"])

    return fit.select("k1", "k2", "x", "copies").mapInArrow(run, "k1 long, k2 long, copies long, deviation long, whitened array<double>")


def identity_error(white: DataFrame, told: int, weight: str = "one") -> float | None:
    """Largest entry of the covariance of the first ``told`` entries of ``whitened`` less the identity; null for none."""
    if not told:
        return None
    w = [F.element_at("whitened", i + 1) for i in range(told)]
    p = _weight(weight).cast("double")
    means = white.agg(F.sum(p).alias("n"), *[F.sum(p * c) for c in w]).first()
    y = [c - F.lit(m / means.n) for c, m in zip(w, means[1:], strict=True)]
    pairs = list(combinations_with_replacement(range(told), 2))
    found = white.agg(*[F.sum(p * y[i] * y[j]) for i, j in pairs]).first()
    return max(abs(v / means.n - (i == j)) for (i, j), v in zip(pairs, found, strict=True))


def whiten(
    vectors: DataFrame, components: int = 4, scale: int = 256, weight: str = "one", id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """``id_col, component, n, deviation, whitened, explained, identity_error`` of every row and component from 1.

    Equal vectors, after their entries are made whole numbers, are one entry of the fit list, of weight one (or of
    their ``count``); its covariance, centred before it is multiplied and over all weights, gives the components.
    Every distinct vector is whitened once and joined back to its rows by two 64-bit hashes, so copies cost a narrow row each.

    Rows without a vector, with null or non-finite entries or with one that is no long after scaling give no rows; null
    ids and repeated rows do. Vectors that are shorter than the longest end in zeros. There are no more components than
    dimensions (empty vectors have none and give no rows). A component without variance has a null for ``whitened``, and
    so has ``explained`` where there is none at all; ``identity_error`` is over the others. A ``deviation`` that is no
    long is null. Further columns are not read, an empty table gives no rows.
    The driver holds one covariance matrix, of dimensions squared, and nothing that grows with the rows.
    """
    rows = quantised(vectors, id_col, vec_col, scale)
    fit = materialise(distinct_vectors(rows), "distinct")
    model = fit_whitening(fit, weight)
    white = materialise(whitened_vectors(fit, model, components), "whitened")
    values = model["values"][:components]
    error = identity_error(white, int((values > model["trace"] * 1e-12).sum()), weight) if model["n"] else None
    shares = F.array(*[F.lit(float(v) / model["trace"] if model["trace"] > 0 else None).cast("double") for v in values])
    keys = _keyed(rows).select("id", "k1", "k2")
    told = keys.join(white, ["k1", "k2"]).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return told.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(model["n"]).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares.cast("array<double>"), F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
