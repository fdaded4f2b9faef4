"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A column used many times in an expression is written out, and often worked out, as many
    times. Going through a one-element array binds it to a variable instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
