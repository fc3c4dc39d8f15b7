"""Secrets in texts: known formats, and runs of characters that a battery of randomness tests tells from words."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsieve.session import materialise

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
_HEX = re.compile("[0-9a-f]{24,}")
_RUN = re.compile("[A-Za-z0-9+/_-]{20,}={0,2}")

#: Alphabets from small to large; a run is held to be written in the first that has all its characters.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "hex upper": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "+/-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
}
#: Per cent of each letter from a to z in ordinary English text: what a run of words would look like.
_LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (
    8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98,
    2.4, 0.15, 2.0, 0.074), strict=True))
#: Share of neighbours of different kind (letter, capital, digit, sign) in names, paths and dates.
_WORDS_CHANGE = 0.2
#: A run that fails uniformity or independence at this level is not random.
_REJECT = 1e-3
_BINS_PER_DECADE, _MOST_BIN = 10, 400


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _word_moments(alphabet: str) -> tuple[float, float]:
    """Chance that two, and that three, letters of ordinary text agree, if only letters of ``alphabet`` are seen."""
    weights = [_LETTERS[c] for c in alphabet.lower() if c in _LETTERS and (c in alphabet or c.upper() in alphabet)]
    total = sum(weights)
    return sum((w / total) ** 2 for w in weights), sum((w / total) ** 3 for w in weights)


_MOMENTS = {name: _word_moments("".join(sorted({*a.lower()}))) for name, a in ENCODINGS.items()}
_SETS = [(name, frozenset(a)) for name, a in ENCODINGS.items()]


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def battery(run: str) -> float | None:
    """Chance that ordinary text looks as random as ``run``; None for a run that is not random by one of the tests.

    Chi-squared over the inferred alphabet and lag-one correlation of positions in it must not reject a uniform,
    independent source. Against words then speak few equal characters (the same chi-squared sum) and many changes
    between letters, capitals and digits (runs); their chances are combined by Fisher's method. Digits alone and runs
    that pad nothing else are numbers, not secrets.
    """
    symbols = run.rstrip("=")
    seen, n = set(symbols), len(symbols)
    if n < 2 or all(c.isdigit() for c in seen):
        return None
    name, alphabet = next(((k, s) for k, s in _SETS if seen <= s), (None, None))
    if name is None:
        return None
    a, counts = len(alphabet), Counter(symbols)
    equal = sum(c * (c - 1) for c in counts.values())
    chi = a / n * sum(c * c for c in counts.values()) - n
    # Wilson-Hilferty: the cube root of chi-squared over its degrees of freedom is close to normal
    df = a - 1
    uniform = _normal_tail(((chi / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df)))
    at = {c: i for i, c in enumerate(sorted(alphabet))}
    x = [at[c] - (a - 1) / 2 for c in symbols]
    spread = sum(v * v for v in x)
    serial = math.erfc(abs(sum(p * q for p, q in zip(x, x[1:], strict=False))) / (spread or 1) * math.sqrt(n / 2))
    if uniform < _REJECT or serial < _REJECT:
        return None
    two, three = _MOMENTS[name]
    deviation = math.sqrt(2 * two * (1 - two) / (n * (n - 1)) + 4 * (three - two * two) / n)
    few_equal = _normal_tail((two - equal / (n * (n - 1))) / deviation)
    changes = sum(_kind(p) != _kind(q) for p, q in zip(symbols, symbols[1:], strict=False))
    expected = _WORDS_CHANGE * (n - 1)
    many_changes = _normal_tail((changes - 0.5 - expected) / math.sqrt(expected * (1 - _WORDS_CHANGE)))
    both = -math.log(max(few_equal, 1e-300)) - math.log(max(many_changes, 1e-300))
    return math.exp(-both) * (1 + both)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of the known formats, in order; spans of one kind do not overlap."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def random_runs(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """``start, end, length class, bin of the chance`` of the runs apart from ``base`` that pass the battery."""
    found, taken = [], 0
    last = 0  # end of the spans that start before the run
    for m in _RUN.finditer(text):
        while taken < len(base) and base[taken][0] < m.end():
            last = max(last, base[taken][2])
            taken += 1
        if last > m.start() or (chance := battery(m[0])) is None:
            continue
        bin_no = min(_MOST_BIN, int(-math.log10(max(chance, 1e-300)) * _BINS_PER_DECADE))
        found.append((m.start(), m.end(), (m.end() - m.start()).bit_length(), bin_no))
    return found


_SCHEMA = (
    "base array<struct<start:int,kind:int,end:int>>,"
    " runs array<struct<start:int,end:int,class:int,bin:int>>"
)
_BASE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_RUNS = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end", "class", "bin")]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, runs = [], []
        for text in batch.column(1).to_pylist():
            spans = base_spans(text or "")
            base.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in spans])
            names = ("start", "end", "class", "bin")
            runs.append([dict(zip(names, r, strict=True)) for r in random_runs(text or "", spans)])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(base, _BASE), pa.array(runs, _RUNS)], names=["id", "base", "runs"]
        )


def discovery_limits(scanned: DataFrame, rate: float) -> dict[int, int]:
    """Least bin that Benjamini-Hochberg accepts, for each length class with any.

    Chances are counted in a fixed number of bins over the whole corpus, so what comes back is bounded: a row for
    each doubling of the length. A bin is judged by its largest chance, which errs to fewer discoveries.
    """
    counted = (
        scanned.select(F.explode("runs").alias("r")).groupBy(F.col("r.class").alias("c"), F.col("r.bin").alias("b")).count()
    )
    from_top = Window.partitionBy("c").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.sum("count").over(from_top) / F.sum("count").over(Window.partitionBy("c"))
    accepted = counted.withColumn("share", share).where(
        F.pow(F.lit(10.0), -F.col("b") / _BINS_PER_DECADE) <= F.lit(rate) * F.col("share")
    )
    return {r.c: r.b for r in accepted.groupBy("c").agg(F.min("b").alias("b")).collect()}


def _written(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def find_secrets(
    docs: DataFrame, false_discoveries: float = 0.01, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Counts of the known formats, the digest of their spans, and all spans with those the battery adds, per row.

    Spans are ``kind:start:end`` in code points. A run is added where its chance stays within the false discovery rate
    among runs of like length in the whole corpus; it never replaces or overlaps a known format. Repeated rows and
    null ids give a row each, null texts count as empty, further columns are not read, an empty table gives no rows.
    The texts are read once; spans alone are written and read again.
    """
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    scanned = materialise(slim.mapInArrow(_scan, f"id {kind}, {_SCHEMA}"), "secrets")
    limits = discovery_limits(scanned, false_discoveries)
    def accepted(r: Column) -> Column:
        least = F.lit(_MOST_BIN + 1)
        for length_class, b in sorted(limits.items()):
            least = F.when(r["class"] == length_class, b).otherwise(least)
        return r["bin"] >= least

    added = F.transform(
        F.filter("runs", accepted),
        lambda r: F.struct(r["start"], F.lit(KINDS.index("random")).alias("kind"), r["end"]),
    )
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        F.col("id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", added))).alias("spans"),
        F.size(added).cast("long").alias("n_random"),
    )
