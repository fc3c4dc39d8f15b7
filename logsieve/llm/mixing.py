"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsieve.functions.ordering import numbered, running_sum
from logsieve.llm.words import WORD, n_words, whole
from logsieve.session import materialise

_CHUNK = 65_536


def _fibonacci() -> list[int]:
    numbers = [1, 2]
    while numbers[-1] < 1 << 60:
        numbers.append(numbers[-1] + numbers[-2])
    return numbers


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``source, no, source_size, target`` with a row per source.

    Sources in code point order (null last) take ``weights`` in turn and share ``share`` times all words by weight.
    None gets more than ``most`` times its words; what is above goes to the others by weight. Raising a common level
    until all is given out fills the sources in the order of what a unit of weight may hold, so the level is the
    largest of those that each source would set if all before it were full. The windows see a row per source.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("no", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    turn = F.array(*map(F.lit, weights))
    by = by.withColumn("weight", F.element_at(turn, (F.col("no") - 1) % len(weights) + 1))
    by = by.withColumn("room", F.lit(float(most)) * F.col("source_size"))
    full_first = Window.orderBy(F.col("room") / F.col("weight"), "no")
    before = F.coalesce(F.sum("room").over(full_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy())
    open_weight = F.sum("weight").over(full_first.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("level", (total - before) / open_weight)
    target = F.least("room", F.col("weight") * F.max("level").over(Window.partitionBy()))
    return by.select("source", "no", "source_size", target.alias("target"))


def schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """``slot, no, lap, block, upto``: which block of which source each slot takes, and how many of its words.

    A source of S words is cut into blocks of ``block_words``; it needs a slot per block of each whole lap of its
    target and of the rest. Sources own consecutive cells, one for each slot they need, of a circle whose size is the
    next Fibonacci number; the point of a slot on it is the slot times the Fibonacci number before, modulo the size.
    These are golden-ratio points that meet every cell exactly once, so every source gets just the slots it needs,
    evenly over time, and cells that no source owns are skipped. The map is its own inverse but for the sense of
    rotation, so the slot of a cell is computed the same way. Slots are then ranked in each source; rank r takes
    block r modulo the number of blocks.
    """
    col = F.col
    words = F.floor(col("target") + 0.5)
    size = F.greatest(col("source_size"), F.lit(1))
    needs = targets.select("no", "source_size", words.alias("words"), F.floor(words / size).alias("laps"))
    needs = needs.withColumn("rest", col("words") - col("laps") * col("source_size"))
    needs = needs.withColumn("blocks", F.ceil(col("source_size") / F.lit(block_words)))
    needs = needs.withColumn("slots", col("laps") * col("blocks") + F.ceil(col("rest") / F.lit(block_words)))
    upto_this = Window.orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    needs = needs.withColumn("first", F.sum("slots").over(upto_this) - col("slots"))
    needs = needs.withColumn("all", F.sum("slots").over(Window.partitionBy()))
    fib = _fibonacci()
    at = F.array_position(F.transform(F.array(*map(F.lit, fib)), lambda f: f >= col("all")), True)
    needs = needs.withColumn("circle", F.element_at(F.array(*map(F.lit, fib)), at.cast("int")))
    needs = needs.withColumn("step", F.element_at(F.array(*map(F.lit, [1, *fib])), at.cast("int")))
    chunks = needs.where("slots > 0").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((col("slots") - 1) / _CHUNK)))
    ).repartition("no", "chunk")
    last = F.least(col("slots"), (col("chunk") + 1) * _CHUNK) - 1
    own = F.sequence(col("first") + col("chunk") * _CHUNK, col("first") + last)
    cells = chunks.withColumn("cell", F.explode(own))
    wide = lambda c: col(c).cast("decimal(19,0)")
    slots = cells.withColumn("slot", F.pmod(wide("cell") * wide("step"), wide("circle")).cast("long"))
    ranked = numbered(slots, ["no"], ["slot"], F.floor(col("slot") / _CHUNK), "rank")
    ranked = ranked.withColumn("lap", F.floor((col("rank") - 1) / col("blocks")))
    ranked = ranked.withColumn("block", (col("rank") - 1) % col("blocks"))
    limit = F.when(col("lap") < col("laps"), F.lit(block_words)).otherwise(
        F.least(F.lit(block_words), col("rest") - col("block") * block_words)
    )
    return ranked.select("slot", "no", "lap", "block", limit.cast("long").alias("upto"))


def shuffled(sized: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """``sized`` with ``no`` and ``start``: documents of a source one after the other in the order of a hash.

    Sums run inside slices of the hash, so a source with a third of all rows is many tasks.
    """
    known = targets.select(F.col("source").alias("_source"), "no", "source_size", "target")
    placed = sized.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("order", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    slices = F.conv(F.substring("order", 1, 3), 16, 10).cast("int")
    summed = running_sum(placed, ["no"], ["order", "doc_id", "size", "text_hash"], slices, F.col("size"), "end")
    return summed.withColumn("start", F.col("end") - F.col("size")).drop("end", "order")


def _laid(sized: DataFrame, targets: DataFrame, block_words: int, seed: str) -> DataFrame:
    """Documents with words cut at block ends, a row for each slot that takes some; ``slot`` is null where none does."""
    col = F.col
    slots = schedule(targets, block_words).withColumnsRenamed({"no": "_no", "block": "_block"})
    some = shuffled(sized.where("size > 0"), targets, seed)
    end = col("start") + col("size")
    pieces = some.withColumn("block", F.explode(F.sequence(F.floor(col("start") / block_words), F.floor((end - 1) / block_words))))
    inside = lambda c: F.least(F.greatest(c - col("block") * block_words, F.lit(0)), F.lit(block_words))
    pieces = pieces.withColumns({"low": inside(col("start")), "high": inside(end)})
    takes = (col("no") == col("_no")) & (col("block") == col("_block")) & (col("upto") > col("low"))
    first = col("block") * block_words + col("low") - col("start")
    met = pieces.join(slots, takes, "left").withColumn("from_word", F.when(col("slot").isNotNull(), first))
    return met.withColumn("to_word", col("from_word") + F.least("high", "upto") - col("low"))


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return materialise(
        docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), n_words(whole(text_col)).alias("size"),
                    F.xxhash64(docs[text_col]).alias("text_hash")),
        "sizes",
    )


def mixed(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
    block_words: int = 4096, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mix: ``slot, at, source, lap, block, id_col, text_hash, from_word, to_word`` of every piece of it.

    Read by ``slot`` and ``at`` (words before the piece in its block) the pieces are the mixed corpus; a piece is the
    words of a document from ``from_word`` up to ``to_word``, not included. Documents the mix takes nothing of have
    no row, what it takes twice has two. ``mixed_texts`` gives the words themselves.
    """
    sized = _sizes(docs, id_col, text_col, source_col)
    laid = _laid(sized, source_targets(sized, weights, share, most), block_words, seed).where("slot IS NOT NULL")
    return laid.select("slot", F.col("low").alias("at"), F.col("source").alias(source_col), "lap", "block",
                       F.col("doc_id").alias(id_col), "text_hash", "from_word", "to_word")


def mixed_texts(docs: DataFrame, pieces: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``pieces`` of ``mixed`` with their text as it stands in the document, with the white space before each word."""
    texts = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).dropDuplicates()
    this = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.xxhash64("_text"))
    words = F.regexp_extract_all("_text", F.lit(f"[\\x20\\x09-\\x0D]*{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(words, (F.col("from_word") + 1).cast("int"), (F.col("to_word") - F.col("from_word")).cast("int")), "")
    return pieces.join(texts, this).withColumn(text_col, cut).drop("_id", "_text")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
    block_words: int = 4096, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """``id_col, source, size, source_size, target, taken`` of every row: the words the mix takes of it.

    ``taken`` adds up the pieces of ``mixed`` and counts repeats; the words taken of a source make up its target
    rounded to a word, a document gives ``most`` times its size at most, and equal input gives equal output. Null texts have size zero; a null source is
    a source, the last one; repeated rows and null ids give a row each (rows that agree in id, source and size are
    interchangeable); further columns are not read; an empty table gives no rows. Texts are read once; sizes are
    written and read again.
    """
    sized = _sizes(docs, id_col, text_col, source_col)
    targets = source_targets(sized, weights, share, most)
    col = F.col
    took = F.coalesce(F.sum(col("to_word") - col("from_word")), F.lit(0)).alias("taken")
    got = _laid(sized, targets, block_words, seed).groupBy("no", "start", "doc_id", "source", "size", "source_size", "target").agg(took)
    known = targets.select(col("source").alias("_source"), "source_size", "target")
    none = sized.where("size = 0").join(known, col("source").eqNullSafe(col("_source"))).withColumn("taken", F.lit(0).cast("long"))
    names: list[str | Column] = [col("doc_id").alias(id_col), "source", "size", "source_size", "target", "taken"]
    return got.select(*names).unionByName(none.select(*names))
