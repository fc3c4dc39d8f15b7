"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.text import let
from logsieve.llm.words import whole

_BLOCK = 256


def running_totals(lengths: Column) -> Column:
    """Sums of the elements up to and with each one.

    A plain fold would copy its result for every element. Totals are folded in blocks, and so are the blocks, which
    keeps a text with very many spans near linear.
    """

    def fold(values: Column, start: Column) -> Column:
        added = F.aggregate(
            values, F.array(start.cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
        )
        return F.slice(added, 2, F.size(values))

    def blocks(values: Column) -> Column:
        part = lambda b: F.slice(values, b * _BLOCK + 1, _BLOCK)
        at = F.sequence(F.lit(0), F.ceil(F.size(values) / F.lit(_BLOCK)).cast("int") - 1)
        sums = F.transform(at, lambda b: F.aggregate(part(b), F.lit(0).cast("long"), lambda a, x: a + x))
        return let(
            let(sums, lambda s: F.concat(F.array(F.lit(0).cast("long")), fold(s, F.lit(0)))),
            lambda offsets: F.flatten(F.transform(at, lambda b: fold(part(b), offsets[b]))),
        )

    empty = F.array().cast("array<bigint>")
    return let(lengths, lambda v: F.when(F.size(v) == 0, empty).otherwise(blocks(v)))


@dataclass(frozen=True)
class Kind:
    """``pattern`` proposes, ``confirm`` decides by the match; ``context`` (lower case) raises the score.

    ``gate`` is a cheap condition on the text without which there is no match. A kind with ``needs_context`` is
    reported only where its context is near: its pattern alone says too little.
    """

    name: str
    pattern: str
    gate: str
    context: str
    needs_context: bool = False


#: The four given kinds come first. Runs are possessive and begin where no earlier character could begin them, so
#: that a long run without a match is read once; the spans are those of the plain patterns.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         r"e-?mail|contact|write to|correo|kontakt"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", r"\bip\b|address|host|server"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}", r"card|visa|credit|payment|tarjeta|karte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", r"phone|tel|call|mobile|fax|t[eé]l"),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", r"[A-Z]{2}[0-9]{2}", r"iban|account|bank|konto|cuenta"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-", r"ssn|social security", True),
)
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_NEAR = 40


def luhn(digits: Column) -> Column:
    """Whether the digits of a string pass Luhn's check."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether country and check digits, moved to the end and read with A as 10 to Z as 35, leave 1 by 97."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    chars = F.filter(F.split(moved, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), step) == 1


def _confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return match.rlike(f"^{_PART}(?:\\.{_PART}){{3}}$")
    if kind == "card":
        return n.between(13, 19) & luhn(digits)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        plain = F.replace(match, F.lit(" "), F.lit(""))
        return F.length(plain).between(15, 34) & mod97(plain)
    return F.lit(True)


def _spans(number: int, kind: Kind, text: Column, matches: Column) -> Column:
    """Confirmed spans of one kind with their scores; positions are sums of the pieces around the matches."""

    def placed(pieces: Column) -> Column:
        gaps = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m))
        return let(running_totals(gaps), lambda ends: F.transform(matches, lambda m, i: scored(pieces, ends, m, i)))

    def scored(pieces: Column, ends: Column, m: Column, i: Column) -> Column:
        around = F.concat_ws(" ", F.substring(pieces[i], -_NEAR, _NEAR), F.substring(pieces[i + 1], 1, _NEAR))
        near = F.lower(around).rlike(kind.context)
        sure = 0.5 if kind.name in ("email", "phone", "ssn") else 0.8
        ok = _confirmed(kind.name, m) & near if kind.needs_context else _confirmed(kind.name, m)
        return F.when(ok, F.struct(
            F.lit(number).alias("kind"), (ends[i] - F.length(m)).alias("start"), ends[i].alias("end"),
            (F.lit(sure) + F.when(near, 0.2).otherwise(0.0)).alias("score"),
        ))

    found = let(F.split(text, kind.pattern, -1), placed)
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,score:double>>")
    return F.when(F.size(matches) == 0, none).otherwise(F.filter(found, lambda s: s.isNotNull()))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the four given kinds, the digest of their spans, all spans and their scores, per row.

    Spans are ``kind:start:end`` in code points, by kind and start; ``scores`` are in the same order, from 0.5 (by
    pattern alone) over 0.8 (checksum or range holds) with 0.2 more where a word of the kind's context lies within 40
    characters. IBANs that pass mod 97 and social security numbers in context are added; the given kinds stay
    whatever their score. Repeated rows and null ids give a row each, null texts count as empty, further columns are
    not read, an empty table gives no rows. Narrow: no shuffle, no Python.
    """
    text = F.col("_text")
    none = F.array().cast("array<string>")
    slim = docs.select(docs[id_col].alias("_id"), whole(text_col).alias("_text"))
    gate = lambda k: F.contains(text, F.lit(k.gate)) if k.gate == "@" else text.rlike(k.gate)
    matched = slim.select("_id", "_text", *[
        F.when(gate(k), F.regexp_extract_all(text, F.lit(k.pattern), 0)).otherwise(none).alias(f"_m{i}")
        for i, k in enumerate(KINDS)
    ])
    spans = matched.select("_id", *[_spans(i, k, text, F.col(f"_m{i}")).alias(f"_s{i}") for i, k in enumerate(KINDS)])
    names = F.array(*[F.lit(k.name) for k in KINDS])
    written = lambda s: F.array_join(
        F.transform(s, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ","
    )
    base, every = F.concat(*[F.col(f"_s{i}") for i in range(4)]), F.concat(*[F.col(f"_s{i}") for i in range(len(KINDS))])
    joined = spans.select("_id", *[F.size(f"_s{i}").cast("long").alias(f"n_{KINDS[i].name}") for i in range(len(KINDS))],
                          base.alias("_base"), every.alias("_all"))
    return joined.select(
        F.col("_id").alias(id_col), *[f"n_{k.name}" for k in KINDS],
        F.sha2(written(F.col("_base")), 256).alias("base_sha256"), written(F.col("_all")).alias("spans"),
        F.array_join(F.transform("_all", lambda x: F.format_number(x["score"], 1)), ",").alias("scores"),
    )
