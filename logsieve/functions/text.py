"""Text columns with the rules of the original tooling: line breaks, trimming, escaping, globs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every break that ends a line, not only \n.
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
_SPACE = "(?U)[\\s\\x1c-\\x1f]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_lines(text: Column) -> Column:
    """Lines of a text; a final line break opens no further line, and an empty text has none."""
    return let(
        F.split(text, LINE_BREAK, -1),
        lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts),
    )


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def java_regex(pattern: str) -> str:
    """A Python regex for Java: white space there lacks the four separator characters, named groups have other marks
    and names of letters and digits only, and ``\\Z`` is the very end.

    To be used with the flags ``(?Umd)``: Unicode classes, ``^`` and ``$`` at lines, only ``\\n``
    ending one.
    """
    out, in_class, i = "", False, 0
    while i < len(pattern):
        step = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        named = None if in_class else re.match(r"\(\?P(<|=)(\w+)[>)]", pattern[i:])
        if named:
            name = "g" + "".join(c if c.isascii() and c.isalnum() else f"x{ord(c)}x" for c in named[2])
            out, i = out + (f"(?<{name}>" if named[1] == "<" else f"\\k<{name}>"), i + len(named[0])
            continue
        if step == "\\Z":
            out += "\\z"
        elif step == "\\s":
            out += "\\s\\x1c-\\x1f" if in_class else "[\\s\\x1c-\\x1f]"
        elif step == "\\S":
            out += "[^\\s\\x1c-\\x1f]"
        else:
            out += step
            in_class = step == "[" or (in_class and step != "]")
        i += len(step)
    return out


def title_case(text: Column) -> Column:
    return F.initcap(text)


def html_escape(text: Column) -> Column:
    escaped = text
    for raw, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        escaped = F.replace(escaped, F.lit(raw), F.lit(entity))
    return escaped


def extension(filename: Column) -> Column:
    """Lower-case suffix without the dot; hidden files and names ending in a dot have none."""
    return F.lower(F.regexp_extract(base_name(filename), "(?s)^.+\\.([^.]+)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)/*$", 1)


def glob_regex(pattern: str) -> str:
    """A path glob as an anchored regex: ``**/`` any folders, ``*`` and ``?`` inside one name."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"(?s)^(?:.*/)?{out}$"


def any_glob(path: Column, patterns) -> Column:
    matched = F.lit(False)
    for pattern in patterns:
        matched = matched | path.rlike(glob_regex(pattern))
    return matched
