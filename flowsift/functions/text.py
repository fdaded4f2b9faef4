"""Text helpers that treat white space and printability by Unicode, not ASCII, rules."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, functions as F

# Everything Unicode calls white space plus the four ASCII separators, as a pattern and as text.
SPACE = r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPACE_CHARS = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)])
) + "".join(map(chr, [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_BREAK = r"\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACE_CHARS))


def clean(col: Column, fallback: str, max_chars: int) -> Column:
    """One line, printable characters only, at most ``max_chars``; ``fallback`` when nothing is left."""
    one_line = strip(F.regexp_replace(col, f"[{SPACE}]+", " "))
    printable = F.regexp_replace(one_line, r"[\p{C}\p{Z}&&[^ ]]", "")
    return F.coalesce(F.nullif(F.substring(printable, 1, max_chars), F.lit("")), F.lit(fallback))


def body_lines(col: Column) -> Column:
    """Lines trimmed, blank lines dropped."""
    lines = F.transform(F.split(col, f"[{LINE_BREAK}]"), strip)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def count_of(col: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    removed = F.length(col) - F.length(F.replace(col, F.lit(literal), F.lit("")))
    return (removed / len(literal)).cast("int")


def fill(template: str, values: dict[str, Column]) -> Column:
    """``"{a} text {b}"`` with columns put in for the names."""
    parts: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            parts.append(values[name])
    return F.concat(*parts)
