"""Quality rules as a ledger of failure bits and measurements, judged by versioned policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.text import let
from logsieve.llm.words import SPACE, WORD, whole

SYMBOLS = "#*$%&|<>"

#: Name and condition of every rule on the measurements; bit i of the ledger is rule i. Append only: bits are stored.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("few_letters", "100 * n_letter_words < 70 * n_words"),
    ("shouting", "100 * n_capitals > 50 * word_chars"),
)
#: The rules each version rejects by.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(name for name, _ in RULES),
}


def _gathered(words: Column) -> Column:
    """Words that stand in a window of three words which occurs again in the text."""
    starts = F.sequence(F.lit(1), F.size(words) - 2)
    windows = F.when(F.size(words) >= 3, F.transform(starts, lambda i: F.xxhash64(words[i - 1], words[i], words[i + 1])))

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            return F.sort_array(
                F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])
            )

        # each start covers three words, less where the next start comes sooner
        gains = lambda at: F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3))))
        total = let(let(ordered, again), lambda at: F.aggregate(gains(at), F.lit(0), lambda a, b: a + b))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(total)

    return F.coalesce(let(windows, covered), F.lit(0))


def measurements(docs: DataFrame, text_col: str = "text") -> Column:
    """One struct with all measurements of the text; null counts as empty."""
    text = whole(text_col)
    without = lambda chars: F.length(F.translate(text, chars, ""))
    worded = F.filter(F.split(text, "\n", -1), lambda line: F.translate(line, SPACE, "") != "")
    as_long = lambda c, name: c.cast("long").alias(name)
    of_words = let(
        F.regexp_extract_all(text, F.lit(WORD), 0),
        lambda w: F.struct(as_long(F.size(w), "n"), as_long(_gathered(w), "again")),
    )
    of_lines = let(worded, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    return let(
        F.struct(of_words.alias("w"), of_lines.alias("l")),
        lambda m: F.struct(
            m["w"]["n"].alias("n_words"), as_long(without(SPACE), "word_chars"),
            as_long(F.length(text) - without(SYMBOLS), "n_symbols"), as_long(m["l"]["dup"], "n_dup_lines"),
            m["w"]["again"].alias("n_repeat_words"), as_long(m["l"]["n"], "n_lines"),
            as_long(F.regexp_count(text, F.lit(r"\p{L}[^\x20\x09-\x0D]*")), "n_letter_words"),
            as_long(F.regexp_count(text, F.lit("[A-Z]")), "n_capitals"),
        ),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the measurements and ``failed_bits`` of every row: every rule evaluated once, no verdict yet.

    Repeated rows and null ids give a row each; null and empty texts measure zero, fail ``few_words`` and no rule on
    shares; further columns are not read; an empty table gives no rows. Narrow: no shuffle.
    """
    measured = docs.select(docs[id_col].alias(id_col), measurements(docs, text_col).alias("_m")).select(id_col, "_m.*")
    bits = sum((F.expr(rule).cast("long") * (1 << i) for i, (_, rule) in enumerate(RULES)), F.lit(0).cast("long"))
    return measured.withColumn("failed_bits", bits)


def mask(policy: str) -> int:
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in POLICIES[policy])


def fails(policy: str) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) != 0


def ablations(written: DataFrame, policy: str) -> DataFrame:
    """``rule, failed, failed_alone, kept_without``: rows a rule rejects, rejects alone, and what dropping it leaves.

    Rows are counted by bit pattern first, so what follows has at most one row for each pattern.
    """
    full = mask(policy)
    patterns = written.groupBy(F.col("failed_bits").bitwiseAND(F.lit(full)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit"))
        for i, (name, _) in enumerate(RULES) if full >> i & 1
    ])
    rows = patterns.select("bits", "n", F.explode(rules).alias("r"))
    bit, bits = F.col("r.bit"), F.col("bits")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return rows.groupBy("r.rule").agg(
        count(bits.bitwiseAND(bit) != 0).alias("failed"), count(bits == bit).alias("failed_alone"),
        count(bits.bitwiseAND(F.bitwise_not(bit)) == 0).alias("kept_without"),
    )


def judge(docs: DataFrame, policy: str = "v1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger with ``base_failed`` (policy ``base``) and ``kept`` (not failed by ``base`` nor by ``policy``)."""
    return ledger(docs, id_col, text_col).withColumns({"base_failed": fails("base"), "kept": ~(fails("base") | fails(policy))})


def keep_good(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``policy`` and ``base`` keep, with their columns as they are."""
    bits = sum(
        ((F.expr(rule)).cast("long") * (1 << i) for i, (_, rule) in enumerate(RULES)), F.lit(0).cast("long")
    )
    taken = F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("_row")
    measured = docs.select(taken, measurements(docs, text_col).alias("_m")).select("_row", "_m.*")
    judged = measured.select("_row", bits.alias("failed_bits"))
    return judged.where(~(fails("base") | fails(policy))).select("_row.*")
