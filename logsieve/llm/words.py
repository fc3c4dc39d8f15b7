"""Words and lines as every operator of this package sees them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
NOT_WORD = "[\\x20\\x09-\\x0D]+"
SPACE = " \t\n\x0b\x0c\r"


def whole(text: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def byte_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased; ``bytes`` splits and lowers by ASCII alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
