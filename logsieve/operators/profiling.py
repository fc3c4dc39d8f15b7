"""Line profiles of log files.

Two shapes of input: *texts*, one row per file with the whole text (a file is at most the size limit,
so everything but keywords is worked out in the row, without a shuffle), and *lines*, one row per
line (``file_id, line_no, line``), where one file may be any share of the table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.ordering import top_per_key
from logsieve.functions.text import let, split_lines
from logsieve.session import materialise
from logsieve.settings import SAMPLE_LINES, SIGNAL_TERMS, TOP_KEYWORDS

_WORD = "[a-z]{4,}"


def add_lines(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.withColumn("lines", split_lines(F.col(text)))


def to_lines(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row per line, numbered from 1."""
    kept = [c for c in texts.columns if c != text]
    return (
        texts.select(*kept, F.posexplode_outer(split_lines(F.col(text))).alias("_at", "line"))
        .where("_at IS NOT NULL")
        .select(*kept, (F.col("_at") + 1).alias("line_no"), "line")
    )


def _holds(line: Column, term: str) -> Column:
    return F.contains(F.lower(line), F.lit(term))


def profile_texts(texts: DataFrame, text: str = "text") -> DataFrame:
    """Adds line count, signal counts and head and tail samples to each file row."""
    lined = texts.withColumn("_lines", split_lines(F.col(text))).withColumn(
        "_lowered", F.transform("_lines", F.lower)
    )

    def holding(term: str) -> Column:
        return F.size(F.filter("_lowered", lambda line: F.contains(line, F.lit(term))))

    return lined.withColumns({
        "line_count": F.size("_lines"),
        **{f"{term}_count": holding(term) for term in SIGNAL_TERMS},
        "sample_head": F.slice("_lines", 1, SAMPLE_LINES),
        "sample_tail": F.when(
            F.size("_lines") > SAMPLE_LINES, F.slice("_lines", -SAMPLE_LINES, SAMPLE_LINES)
        ).otherwise(F.array().cast("array<string>")),
    }).drop("_lines", "_lowered")


def signal_counts(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines and signal lines per key; a line holding two terms counts for both."""
    return lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("line_count"),
        *[F.count_if(_holds(F.col("line"), term)).alias(f"{term}_count") for term in SIGNAL_TERMS],
    )


def line_samples(lines: DataFrame, keys: list[str], counts: DataFrame | None = None) -> DataFrame:
    """First five lines of each key, and the last five where there are more than five.

    Both ends are cut per task before the shuffle, so a huge file sends ten lines per task. Give
    ``counts`` (the keys and ``line_count``) where they are known.
    """
    first = top_per_key(lines, keys, [F.col("line_no")], SAMPLE_LINES, "_rank")
    last = top_per_key(lines, keys, [F.col("line_no").desc()], SAMPLE_LINES, "_rank")
    if counts is None:
        counts = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("line_count"))

    def packed(ends: DataFrame, name: str) -> DataFrame:
        ordered = F.sort_array(F.collect_list(F.struct("line_no", "line")))
        return ends.groupBy(*keys).agg(F.transform(ordered, lambda x: x["line"]).alias(name))

    empty = F.array().cast("array<string>")
    return (
        counts.join(packed(first, "sample_head"), keys)
        .join(packed(last, "_tail"), keys)
        .withColumn("sample_tail", F.when(F.col("line_count") > SAMPLE_LINES, F.col("_tail")).otherwise(empty))
        .drop("_tail")
    )


def words_of_texts(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Every keyword with its place; line breaks are no letters, so the text needs no splitting."""
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"({_WORD})"), 1)
    # outer, as a plain explode would search the text a second time to filter its input
    return texts.select(*keys, F.posexplode_outer(found).alias("place", "word")).where("word IS NOT NULL")


def words_of_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    found = F.regexp_extract_all(F.lower("line"), F.lit(f"({_WORD})"), 1)
    return (
        lines.select(*keys, "line_no", F.posexplode_outer(found).alias("_at", "word"))
        .where("word IS NOT NULL")
        .select(*keys, F.struct("line_no", "_at").alias("place"), "word")
    )


def keyword_counts(words: DataFrame, keys: list[str]) -> DataFrame:
    return words.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first_place"))


def top_keywords(words: DataFrame, keys: list[str], n: int = TOP_KEYWORDS) -> DataFrame:
    """The ``n`` most frequent words of each key; among equals the one seen first."""
    return top_per_key(keyword_counts(words, keys), keys, [F.desc("n"), F.asc("first_place")], n)


def keyword_lists(words: DataFrame, keys: list[str], n: int = TOP_KEYWORDS) -> DataFrame:
    return ranked_lists(top_keywords(words, keys, n), keys)


def top_text_keywords(texts: DataFrame, keys: list[str], text: str = "text", n: int = TOP_KEYWORDS) -> DataFrame:
    """``top_keywords`` of whole texts: ``keys, word, n, first_place, rank``.

    Words of a text whose key no other row has are counted within its row, so they are never shuffled. Keys of several
    rows are found by the key columns alone; only their words are added up over rows.
    """
    repeated = materialise(texts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select(
        *[F.col(k).alias(f"_{k}") for k in keys]), "repeated-keys")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    slim = texts.select(*keys, F.col(text).alias("_text"))
    alone = slim.join(repeated, same, "left_anti").select(*keys, F.lower("_text").alias("_text"))
    kinds = ", ".join(f"`{k}` {alone.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(_WORD).findall
        for batch in batches:
            told = []
            for i, lowered in enumerate(batch.column(len(keys)).to_pylist()):
                words = find(lowered or "")
                # of equal counts, those seen first come first
                told += [(i, w, c, words.index(w), r) for r, (w, c) in enumerate(Counter(words).most_common(n), 1)]
            row, *made = zip(*told) if told else [()] * 5
            own = [c.take(pa.array(row, pa.int64())) for c in batch.columns[: len(keys)]]
            kept = [pa.array(v, t) for v, t in zip(made, (pa.string(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*own, *kept], names=[*keys, "word", "n", "first_place", "rank"])

    own = alone.mapInArrow(run, f"{kinds}, word string, n long, first_place int, rank int")
    shared = top_keywords(words_of_texts(slim.join(repeated, same, "left_semi"), keys, "_text"), keys, n)
    return own.unionByName(shared)


def ranked_lists(ranked: DataFrame, keys: list[str]) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("rank", "word")))
    return ranked.groupBy(*keys).agg(F.transform(ordered, lambda x: x["word"]).alias("top_keywords"))


def keyword_sketches(words: DataFrame, keys: list[str], tracked: int = 10_000) -> DataFrame:
    """One sketch of the frequent words of each key (``sketch``) and how many ``words`` it has seen.

    A sketch holds up to ``tracked`` words whatever it sees, so rows may be kept per day, added to by more rows of the
    same key, and combined over any days. It is exact as long as the key has no more than ``tracked`` different words.
    """
    return words.groupBy(*keys).agg(F.expr(f"approx_top_k_accumulate(word, {int(tracked)})").alias("sketch"), F.count(F.lit(1)).alias("words"))


def combine_sketches(sketches: DataFrame, keys: list[str], tracked: int = 10_000) -> DataFrame:
    """Sketches of fewer ``keys`` from those of more."""
    return sketches.groupBy(*keys).agg(F.expr(f"approx_top_k_combine(sketch, {int(tracked)})").alias("sketch"), F.sum("words").alias("words"))


def sketched_keywords(sketches: DataFrame, keys: list[str], n: int = TOP_KEYWORDS, tracked: int = 10_000) -> DataFrame:
    """``keys, word, n, words, exact``: the ``n`` most frequent words by the sketch, of equal ones any.

    ``exact`` says that the sketch held every word. Elsewhere a count is off by at most 3.5 ``words / tracked``, and no
    word that is more frequent than that is missed.
    """
    held = F.expr(f"aggregate(approx_top_k_estimate(sketch, {int(tracked)}), 0L, (a, x) -> a + x.count)")
    found = F.expr(f"approx_top_k_estimate(sketch, {int(n)})")
    told = sketches.select(*keys, "words", (held == F.col("words")).alias("exact"), F.explode(found).alias("_x"))
    return told.select(*keys, F.col("_x.item").alias("word"), F.col("_x.count").alias("n"), "words", "exact")


def text_keywords(text: Column, n: int = TOP_KEYWORDS) -> Column:
    """Keywords of a whole text within its row: sorted words are runs, the longest runs are the keywords."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({_WORD})"), 1)
    ordered = F.sort_array(F.transform(found, lambda w, i: F.struct(w.alias("word"), i.alias("place"))))

    def first_of_runs(s: Column) -> Column:
        starts = F.transform(s, lambda x, j: F.when(
            F.coalesce(F.get(s, j - 1)["word"] != x["word"], F.lit(True)),
            F.struct(j.alias("at"), x["place"].alias("place"), x["word"].alias("word"), F.size(s).alias("all")),
        ))
        return F.filter(starts, lambda x: x.isNotNull())

    def longest(runs: Column) -> Column:
        ranked = F.transform(runs, lambda x, k: F.struct(
            (x["at"] - F.coalesce(F.get(runs, k + 1)["at"], x["all"])).alias("less"), x["place"].alias("place"),
            x["word"].alias("word"),
        ))
        return F.transform(F.slice(F.sort_array(ranked), 1, n), lambda x: x["word"])

    return let(let(ordered, first_of_runs), longest)


def file_summaries(texts: DataFrame, chunk_count: Column | None = None) -> DataFrame:
    """One summary row per file: profile, samples and keywords, in one pass without a shuffle.

    ``texts`` holds ``file_id, text`` and any file columns, which are kept; redact before this.
    """
    profiled = profile_texts(texts)
    if chunk_count is not None:
        profiled = profiled.withColumn("chunk_count", chunk_count)
    none = F.array().cast("array<string>")
    return profiled.withColumn("top_keywords", F.coalesce(text_keywords(F.col("text")), none)).drop("text")


def analysis_metadata(summaries: DataFrame) -> DataFrame:
    """Adds the summary struct kept in the file's metadata."""
    wanted = ["line_count", "error_count", "warning_count", "critical_count", "top_keywords"]
    return summaries.withColumn("analysis_summary", F.struct(*wanted))


def line_file_summaries(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The summary of files given as lines."""
    return (
        line_samples(lines, keys, signal_counts(lines, keys))
        .join(keyword_lists(words_of_lines(lines, keys), keys), keys, "left")
        .withColumn("top_keywords", F.coalesce("top_keywords", F.array().cast("array<string>")))
    )
