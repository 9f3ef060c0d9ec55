"""Column functions over page text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regexes import Translated, java_pattern

_SPACE = java_pattern(r"\s+").pattern


def normalized(text: str | Column) -> Column:
    """Text without any white space."""
    return F.regexp_replace(text, _SPACE, "")


def normalized_length(text: str | Column) -> Column:
    """Code points of the text without white space; a null text has none."""
    return F.coalesce(F.char_length(normalized(text)), F.lit(0))


def text_hash(text: str | Column) -> Column:
    """SHA-256, in hex, of the text without white space."""
    return F.sha2(normalized(text), 256)


def first_match(text: str | Column, pattern: Translated, group: int) -> Column:
    """The group of the first hit, null without a hit (an empty group stays empty)."""
    column = F.col(text) if isinstance(text, str) else text
    return F.when(F.regexp_like(column, F.lit(pattern.pattern)), F.regexp_extract(column, pattern.pattern, group))


def truncated(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut after the last sentence or line if that keeps over half, else before the last space."""
    window = F.substring(text, 1, limit)
    back = F.reverse(window)
    # Offset of the last hit from 0, -1 without one.
    last = lambda mark: F.when(F.instr(back, mark[::-1]) == 0, F.lit(-1)).otherwise(limit - F.instr(back, mark[::-1]) + 1 - len(mark))
    tail = java_pattern(r"\s+\Z").pattern
    cut = lambda n: F.regexp_replace(F.substring(window, F.lit(1), n), tail, "")
    sentence, line, space = last(". "), last("\n"), last(" ")
    return (
        F.when(F.char_length(text) <= limit, text)
        .when(sentence > 0.5 * limit, cut(sentence + 2))
        .when(line > 0.5 * limit, cut(line + 1))
        .when(space > 0, cut(space))
        .otherwise(window)
    )


def marker_hint(page: str | Column, total: str | Column) -> Column:
    """``page p of t``, ``page p``, or null."""
    page, total = (F.col(x) if isinstance(x, str) else x for x in (page, total))
    return F.when(page.isNotNull(), F.concat(F.lit("page "), page.cast("string"), F.coalesce(F.concat(F.lit(" of "), total.cast("string")), F.lit(""))))


def span(pages: str | Column) -> Column:
    """``low-high`` of an array of pages, ``low`` if equal, ``-`` if there are none."""
    low, high = F.array_min(pages), F.array_max(pages)
    return F.when(low.isNull(), F.lit("-")).when(low == high, low.cast("string")).otherwise(F.concat(low.cast("string"), F.lit("-"), high.cast("string")))


def contiguous(pages: str | Column) -> Column:
    """Whether the pages are all from the lowest to the highest."""
    return F.coalesce(F.size(F.array_distinct(pages)) == F.array_max(pages) - F.array_min(pages) + 1, F.lit(True))


def joined(values: str | Column, mark: str = ";") -> Column:
    """Array as one string; null as an empty one."""
    values = F.col(values) if isinstance(values, str) else values
    return F.coalesce(F.array_join(values.cast("array<string>"), mark), F.lit(""))


def truth_value(flag: str | Column) -> Column:
    """``True`` or ``False``."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    return F.when(flag, F.lit("True")).otherwise(F.lit("False"))


def four_places(value: str | Column) -> Column:
    """Four decimals, ``N/A`` for null."""
    return F.coalesce(F.format_string("%.4f", value), F.lit("N/A")) if isinstance(value, str) else F.when(value.isNull(), F.lit("N/A")).otherwise(F.format_string("%.4f", value))
