"""Packing the lines of a file into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.text import LINE_BREAK
from logsieve.settings import CHUNK_CHARS


def chunk_texts(text: Column, max_chars: int = CHUNK_CHARS) -> Column:
    """Chunks of a text as an array: whole lines are added until ``max_chars`` is reached.

    With every line ended by ``\\n``, a chunk is the shortest run of at least ``max_chars``
    characters that ends a line: ``max_chars - 1`` characters and whatever is left of that line.
    One regex finds all of them in a single pass, however long the file; a single long line is one
    chunk, and an empty text gives one empty chunk.
    """
    ended, pattern = _ended(text), F.lit(_chunk(max_chars))
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(ended, pattern, 1))


def count_chunks(text: Column, max_chars: int = CHUNK_CHARS) -> Column:
    """How many chunks a text has, without making them."""
    return F.when(text == "", 1).otherwise(F.regexp_count(_ended(text), F.lit(_chunk(max_chars))))


def _ended(text: Column) -> Column:
    ended = F.regexp_replace(text, LINE_BREAK, "\n")
    return F.when(ended.endswith("\n"), ended).otherwise(F.concat(ended, F.lit("\n")))


def _chunk(max_chars: int) -> str:
    return f"(?s)(.{{{max_chars - 1}}}[^\\n]*|.*)\\n"


def chunk_rows(files: DataFrame, max_chars: int = CHUNK_CHARS) -> DataFrame:
    """Document rows: one per chunk with index, size and metadata.

    ``files``: ``job_id, file_id, filename, text`` and, when redacted, ``redaction_applied``.
    """
    redacted = F.col("redaction_applied") if "redaction_applied" in files.columns else F.lit(False)
    return files.select(
        "job_id", "file_id", "filename", redacted.alias("_redacted"),
        F.posexplode_outer(chunk_texts(F.col("text"), max_chars)).alias("chunk_index", "content"),
    ).where("chunk_index IS NOT NULL").select(
        "job_id", "file_id", "chunk_index", "content",
        F.lit("text/plain").alias("content_type"),
        F.length("content").alias("chunk_size"),
        F.struct(
            F.col("filename"), F.col("chunk_index"), F.col("_redacted").alias("pii_redacted")
        ).alias("metadata"),
    )


def chunk_counts(chunks: DataFrame, keys: list[str] = ["job_id", "file_id"]) -> DataFrame:
    return chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("chunk_count"))
