"""Input checks. Driver arguments raise; table data yields columns or reject rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from flowsift.fixed_values import SERVICE_NAME_PATTERN
from flowsift.functions.bind import let
from flowsift.functions.text import strip
from flowsift.schema import MODEL_INPUTS


# ---- driver arguments -------------------------------------------------------------------------


def unit_interval(value: float, name: str = "value") -> float:
    number = float(value)
    if not math.isfinite(number) or not 0.0 <= number <= 1.0:
        raise ValueError(f"{name} must be a finite number between 0 and 1")
    return number


def open_unit_interval(value: float, name: str = "value") -> float:
    number = float(value)
    if not math.isfinite(number) or not 0.0 < number < 1.0:
        raise ValueError(f"{name} must be a finite number strictly between 0 and 1")
    return number


def positive(value: float, name: str = "value") -> float:
    number = float(value)
    if not math.isfinite(number) or number <= 0:
        raise ValueError(f"{name} must be a finite number greater than 0")
    return number


def require_columns(df: DataFrame, columns: list[str] = MODEL_INPUTS) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required fields: {', '.join(missing)}")


def non_empty(df: DataFrame) -> DataFrame:
    """The same rows; a job that finds none fails. The check is part of the plan: no job before it.

    It looks at one row, and adds none.
    """
    found = df.select(F.lit(1)).limit(1).agg(F.count("*").alias("_n"))
    empty = F.when(F.col("_n") == 0, F.raise_error(F.lit("at least one connection record is required")).cast("boolean"))
    guard = found.where(F.coalesce(empty, F.lit(False)))
    return df.union(guard.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]))


# ---- columns ----------------------------------------------------------------------------------


def numeric(col: Column) -> Column:
    """The value as a double, null when it is not a number."""
    return col.try_cast("double")


def finite(col: Column) -> Column:
    """True only for numbers; null, NaN and infinities are false."""
    number = numeric(col)
    return F.coalesce(~F.isnan(number) & (F.abs(number) < float("inf")), F.lit(False))


def _v4(text: Column) -> Column:
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.when(text.rlike(rf"\A{octet}(?:\.{octet}){{3}}\z"), text)


def _v6(text: Column) -> Column:
    """Canonical IPv6: eight lower-case groups, longest zero run written as ``::``.

    All in JVM expressions, so an address check never sends rows to Python.
    """
    low = F.lower(text)
    return let(_without_dotted_tail(low), lambda flat: let(F.split(flat, "::", -1), _groups))


def _without_dotted_tail(low: Column) -> Column:
    """A dotted IPv4 tail becomes two groups; a bad one makes the whole address null."""
    tail = F.regexp_extract(low, r"(?:\A|:)((?:\d{1,3}\.){3}\d{1,3})\z", 1)
    octets = F.transform(F.split(_v4(tail), r"\."), lambda o: o.cast("int"))

    def joined(o: Column) -> Column:
        pair = lambda i: F.lower(F.hex(F.get(o, F.lit(i)) * 256 + F.get(o, F.lit(i + 1))))
        head = F.substring(low, F.lit(1), F.length(low) - F.length(tail))
        return F.concat(head, pair(0), F.lit(":"), pair(2))

    return F.when(tail != "", let(octets, joined)).otherwise(low)


def _groups(halves: Column) -> Column:
    part = lambda half: F.filter(F.split(half, ":", -1), lambda g: half != "")
    left = part(F.get(halves, F.lit(0)))
    none = F.array().cast("array<string>")
    right = F.when(F.size(halves) == 2, part(F.get(halves, F.lit(1)))).otherwise(none)

    def padded(sides: Column) -> Column:
        given = F.size(sides["l"]) + F.size(sides["r"])
        zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - given, F.lit(0)))
        full = F.concat(sides["l"], zeros, sides["r"])
        fits = F.when(F.size(halves) == 1, given == 8).otherwise((F.size(halves) == 2) & (given <= 7))
        hex_only = F.forall(full, lambda g: g.rlike(r"\A[0-9a-f]{1,4}\z"))
        short = F.transform(full, lambda g: F.regexp_replace(g, r"\A0+(?=.)", ""))
        return F.when(fits & hex_only, let(F.array_join(short, ":"), _squeeze))

    return let(F.struct(left.alias("l"), right.alias("r")), padded)


def _squeeze(short: Column) -> Column:
    """The first of the longest runs of two or more zero groups becomes ``::``."""
    options = []
    for run in range(8, 1, -1):
        pattern = rf"\A(|.*?:)0(?::0){{{run - 1}}}(|:.*)\z"
        before = F.regexp_replace(F.regexp_extract(short, pattern, 1), r":\z", "")
        after = F.regexp_replace(F.regexp_extract(short, pattern, 2), r"\A:", "")
        options.append(F.when(short.rlike(pattern), F.concat(before, F.lit("::"), after)))
    return F.coalesce(*options, short)


def canonical_ip(col: Column) -> Column:
    """Canonical IPv4 or IPv6 text; null for anything else, scoped addresses included."""
    text = strip(col)
    return F.when(
        col.isNotNull() & ~col.contains("%"),
        F.when(text.contains(":"), _v6(text)).otherwise(_v4(text)),
    )


def source_ip(col: Column) -> Column:
    """``unknown`` for missing sources, canonical text for addresses, null for invalid ones."""
    missing = col.isNull() | strip(col).isin("", "unknown")
    return F.when(missing, F.lit("unknown")).otherwise(canonical_ip(col))


def service_name(col: Column) -> Column:
    text = strip(col)
    return F.when(text.rlike(SERVICE_NAME_PATTERN), text)


CLOCK, SIXTY = r"(?:[01]\d|2[0-3])", r"[0-5]\d"
EXTENDED_TIME = rf"{CLOCK}(?::{SIXTY}(?::{SIXTY}(?:[.,]\d+)?)?)?"
BASIC_TIME = rf"{CLOCK}(?:{SIXTY}(?:{SIXTY}(?:[.,]\d+)?)?)?"
TIME = rf"(?:{EXTENDED_TIME}|{BASIC_TIME})"
REST = rf"(?:[\s\S]{TIME}(?:[+-]{TIME})?)?\z"
DAY = r"\A(\d{4})(?:-(\d\d)-(\d\d)|(\d\d)(\d\d))"
WEEK = r"\A(\d{4})(?:-W(\d\d)(?:-(\d))?|W(\d\d)(\d)?)(?!\d)"


def iso_timestamp(col: Column) -> Column:
    """The trimmed text when it is a valid ISO-8601 date or date-time, else null."""
    text = strip(col)
    short = (F.length(col) <= 64) & ~col.rlike(r"[\n\r]")
    valid = let(F.regexp_replace(text, "Z", "+00:00"), _real_day_or_week)
    return F.when(short & F.coalesce(valid, F.lit(False)), text)


def _real_day_or_week(plain: Column) -> Column:
    def part(pattern: str, first: int, second: int) -> Column:
        one, two = F.regexp_extract(plain, pattern, first), F.regexp_extract(plain, pattern, second)
        return F.when(one != "", one).otherwise(two).try_cast("int")

    def day_exists(p: Column) -> Column:
        leap = (p["y"] % 4 == 0) & ((p["y"] % 100 != 0) | (p["y"] % 400 == 0))
        days = F.when(p["m"] == 2, 28 + leap.cast("int")).when(p["m"].isin(4, 6, 9, 11), 30).otherwise(31)
        return (p["y"] >= 1) & p["m"].between(1, 12) & p["d"].between(F.lit(1), days)

    def week_exists(p: Column) -> Column:
        last = F.weekofyear(F.make_date(F.greatest(p["y"], F.lit(1)), F.lit(12), F.lit(28)))
        return (p["y"] >= 1) & p["w"].between(F.lit(1), last) & F.coalesce(p["d"], F.lit(1)).between(1, 7)

    year = lambda pattern: F.regexp_extract(plain, pattern, 1).try_cast("int").alias("y")
    day = F.struct(year(DAY), part(DAY, 2, 4).alias("m"), part(DAY, 3, 5).alias("d"))
    week = F.struct(year(WEEK), part(WEEK, 2, 4).alias("w"), part(WEEK, 3, 5).alias("d"))
    return F.when(plain.rlike(DAY + REST), let(day, day_exists)).when(
        plain.rlike(WEEK + REST), let(week, week_exists)
    )
