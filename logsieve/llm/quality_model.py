"""Quality scores learned from preferences between documents (Bradley-Terry)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.ordering import numbered
from logsieve.llm.quality_rules import measurements
from logsieve.session import discard, materialise

#: What a score is made of; all of it is measured on the whole text.
FEATURES = (
    "log_words", "repeat_share", "symbol_rate", "letter_share", "capital_share", "dup_line_share", "log_word_length",
    "log_line_words", "shortness",
)
#: Buckets into which three bytes in a row (A-Z lower-cased) are hashed; their shares say what a text is made of.
GRAMS = 64
#: Penalty on the weights of grams, for each pair: there are many of them, and they tell less than the measures.
HELD_BACK = 0.025
#: Score of a document at the boundary between the two labels.
BOUNDARY = 0.3
_RANGES = 1024


def gram_shares(text: str | None) -> np.ndarray:
    """Square roots of the shares of the hashed three-byte pieces of a text; zeros where there is none."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    counts = np.zeros(GRAMS, np.int64)
    for at in range(0, len(data) - 2, 1 << 20):  # a very long text needs no more memory than such a stretch
        a = data[at : at + (1 << 20) + 2].astype(np.uint32)
        h = (a[:-2] * np.uint32(0x9E3779B1) ^ a[1:-1] * np.uint32(0x85EBCA77) ^ a[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        counts += np.bincount(h >> np.uint32(26), minlength=GRAMS)
    return np.sqrt(counts / max(1, counts.sum()))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, one number per name in ``FEATURES`` and ``grams``; empty texts have zeros but for their shortness."""
    m = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), measurements(docs, text_col).alias("m")).select("id", "text", "m.*")
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    made = {
        "log_words": F.log1p("n_words"), "repeat_share": ratio("n_repeat_words", "n_words"),
        "symbol_rate": F.log1p(10 * ratio("n_symbols", "n_words")), "letter_share": ratio("n_letter_words", "n_words"),
        "capital_share": ratio("n_capitals", "word_chars"), "dup_line_share": ratio("n_dup_lines", "n_lines"),
        "log_word_length": F.log1p(ratio("word_chars", "n_words")), "log_line_words": F.log1p(ratio("n_words", "n_lines")),
        "shortness": 1 / (1 + F.col("n_words") / 20),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = [gram_shares(t) for t in batch.column(0).to_pylist()]
            grams = pa.array(shares, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], grams], names=[*batch.schema.names[1:], "grams"])

    measured = m.select("text", "id", *[made[name].cast("double").alias(name) for name in FEATURES])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in measured.schema.fields[1:])
    return measured.mapInArrow(run, f"{kinds}, grams array<double>")


@dataclass(frozen=True)
class Model:
    """Score of features x: logistic of ``weights . x - cut``, moved so that the cut has the score ``BOUNDARY``.

    ``weights`` are those of ``FEATURES`` and then of the grams.
    """

    weights: tuple[float, ...]
    cut: float

    def raw(self) -> Column:
        """``weights . x``."""
        n = len(FEATURES)
        measures = sum((F.col(c) * F.lit(w) for c, w in zip(FEATURES, self.weights[:n], strict=True)), F.lit(0.0))
        content = F.zip_with("grams", F.array(*map(F.lit, self.weights[n:])), lambda x, w: x * w)
        return F.aggregate(content, measures, lambda a, v: a + v)

    def score(self) -> Column:
        raw = self.raw() - F.lit(self.cut)
        # bounded, so that the exponential neither overflows nor rounds a score to 0 or 1
        return 1 / (1 + F.exp(-(F.greatest(F.least(raw, F.lit(30.0)), F.lit(-30.0)) + F.lit(float(np.log(BOUNDARY / (1 - BOUNDARY)))))))


def _nothing_learned(size: int) -> Model:
    """All scores are 0.5."""
    return Model((0.0,) * size, -float(np.log((1 - BOUNDARY) / BOUNDARY)))


def dealt(x: np.ndarray, good: np.ndarray, pairs_each: int, seed: int) -> np.ndarray:
    """Differences of a good and a bad row, a row each; every row of ``x`` is in ``pairs_each`` of them at least."""
    rng, up, down = np.random.default_rng(seed), np.flatnonzero(good), np.flatnonzero(~good)
    n = pairs_each * max(len(up), len(down))
    deal = lambda i: np.concatenate([rng.permutation(i) for _ in range(-(-n // len(i)))])[:n]
    return x[deal(up)] - x[deal(down)]


def loss_sums(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number of pairs, slope and curvature of the logistic loss at ``w``, one after the other: they add up over pairs."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
    return np.concatenate([[len(d)], d.T @ p, ((d * (p * (1 - p))[:, None]).T @ d).ravel()])


def newton(sums: Callable[[np.ndarray], np.ndarray], size: int, ridge: float, rounds: int) -> np.ndarray:
    """Weights of least loss; ``sums`` gives ``loss_sums`` over all pairs."""
    w = np.zeros(size)
    for _ in range(rounds):
        found = sums(w)
        penalty = np.where(np.arange(size) < len(FEATURES), ridge, max(ridge, HELD_BACK * found[0]))
        step = np.linalg.solve(found[1 + size :].reshape(size, size) + np.diag(penalty), found[1 : 1 + size] - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, good: np.ndarray, pairs_each: int = 4, ridge: float = 1.0, rounds: int = 40, seed: int = 7) -> Model:
    """Bradley-Terry on pairs of a good and a bad document: logistic loss on feature differences by Newton steps.

    Every document is in ``pairs_each`` pairs at least. The cut is the quantile of the scores at the share of bad
    documents. With one label only there is nothing to prefer; all scores are then 0.5. For rows in memory;
    ``fit_table`` is the same for a table.
    """
    if good.all() or not good.any():
        return _nothing_learned(x.shape[1])
    spread = x.std(0)
    spread = np.where(spread > 0, spread, 1)
    d = dealt(x / spread, good, pairs_each, seed)
    raw_w = newton(lambda w: loss_sums(d, w), x.shape[1], ridge, rounds) / spread
    return Model(tuple(map(float, raw_w)), float(np.quantile(x @ raw_w, (~good).mean(), method="midpoint")))


def _in_blocks(taught: DataFrame, n: dict[bool, int], block: int) -> DataFrame:
    """``_block, _nth, good, x``: rows of a label, numbered by a hash of the id, are dealt evenly over blocks of about ``block`` rows.

    A label with fewer rows than there are blocks gives the same row to several, so that every block has both.
    """
    blocks = max(1, -(-sum(n.values()) // block))
    keyed = taught.withColumn("_hash", F.xxhash64("id"))
    order = ["_hash", "id", *FEATURES, "grams"]
    placed = numbered(keyed, ["good"], order, F.shiftright("_hash", 54), "_nth")

    def of(label: bool) -> Column:
        if n[label] >= blocks:
            return F.array(F.expr(f"(_nth - 1) * {blocks} div {n[label]}"))
        up_to = lambda k: f"({k} * {blocks} + {n[label] - 1}) div {n[label]}"
        return F.expr(f"sequence({up_to('(_nth - 1)')}, {up_to('_nth')} - 1)")

    where = F.explode(F.when(F.col("good"), of(True)).otherwise(of(False)))
    return placed.select(where.alias("_block"), "_nth", "good", F.concat(F.array(*FEATURES), F.col("grams")).alias("x"))


def _rows(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def value_at(values: DataFrame, column: str, place: int) -> float:
    """The value at a place (from 0) in order: counted in ever narrower ranges, of which only the counts come to the driver."""
    v = F.col(column)
    low, high = values.agg(F.min(v), F.max(v)).first()
    while low < high:
        at = F.least(F.floor((v - F.lit(low)) / F.lit(high - low) * _RANGES), F.lit(_RANGES - 1))
        counted = values.where(v.between(low, high)).groupBy(at.alias("at")).agg(F.count(v), F.min(v), F.max(v)).collect()
        for _, n, low, high in sorted(counted):
            if place < n:
                break
            place -= n
    return low


def fit_table(
    taught: DataFrame, block: int = 20_000, pairs_each: int = 4, ridge: float = 1.0, rounds: int = 40, seed: int = 7
) -> Model:
    """``fit`` on every row (``id, good``, features) of a table that is read several times.

    Pairs are dealt inside blocks of about ``block`` rows, so a task holds a block, and stored; a Newton step adds up
    slope and curvature over all of them, and the cut is the exact quantile over all rows. Up to ``block`` rows there is
    one block, and the model is that of ``fit``.
    """
    size = len(FEATURES) + GRAMS
    every = [*map(F.col, FEATURES), *(F.get("grams", F.lit(i)) for i in range(GRAMS))]
    n_rows, n_good, *spreads = taught.agg(F.count(F.lit(1)), F.count_if("good"), *map(F.stddev_pop, every)).first()
    n = {True: n_good, False: n_rows - n_good}
    if not min(n.values()):
        return _nothing_learned(size)
    spread = np.where(np.array(spreads) > 0, spreads, 1.0)

    def deal(table: pa.Table) -> pa.Table:
        ordered = table.take(np.argsort(table.column("_nth").to_numpy(), kind="stable"))
        d = dealt(_rows(ordered.column("x"), size) / spread, ordered.column("good").to_numpy().astype(bool), pairs_each, seed)
        return pa.table({"d": pa.FixedSizeListArray.from_arrays(d.ravel(), size).cast(pa.list_(pa.float64()))})

    pairs = materialise(_in_blocks(taught, n, block).groupBy("_block").applyInArrow(deal, "d array<double>"), "pairs")

    def sums(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + size + size * size)
            for batch in batches:
                total += loss_sums(_rows(batch.column(0), size), w)
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])

        added = pairs.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v"))
        return np.array([v for _, v in sorted(added.collect())])

    # rounded, as sums differ in their last digits with the order in which tasks end
    raw_w = np.round(newton(sums, size, ridge, rounds) / spread, 9)
    discard(pairs)
    model = Model(tuple(map(float, raw_w)), 0.0)
    raws = materialise(taught.select(model.raw().alias("raw")), "raws")
    place = (n_rows - 1) * (n[False] / n_rows)
    cut = value_at(raws, "raw", int(place))
    if place % 1:
        upto, above = raws.agg(F.count_if(F.col("raw") <= cut), F.min(F.when(F.col("raw") > cut, F.col("raw")))).first()
        cut = cut if upto > int(place) + 1 else (cut + above) / 2
    discard(raws)
    return Model(model.weights, cut)


def score_quality(
    docs: DataFrame, labels: DataFrame, block: int = 20_000, folds: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, held_out, score, predicted`` of every row.

    ``labels`` (``id_col, good``) teaches only through documents whose crc32 of the id as text is not divisible by
    ``folds``; those are ``held_out``. The model is fitted on all other labelled documents, in blocks of about ``block``
    (``fit_table``); all documents are scored. Inputs are measures of the
    whole text and shares of its hashed three-byte pieces. Null texts count as empty, a null id as the empty string (held out, never taught); repeated rows
    give a row each and repeated labels count once; further columns are not read; an empty table gives no rows; without
    labels all scores are 0.5. Texts are read once, features are written and read again.
    """
    measured = materialise(features(docs, id_col, text_col), "features")
    held_out = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % folds == 0
    known = labels.select(labels[id_col].alias("id"), labels["good"].cast("boolean").alias("good")).where("good is not null").distinct()
    taught = materialise(measured.where(~held_out).join(known, "id").select("id", *FEATURES, "grams", "good"), "taught")
    model = fit_table(taught, block)
    discard(taught)
    scored = measured.select(F.col("id").alias(id_col), held_out.alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= BOUNDARY).cast("int"))
