"""Column helpers for the operators that run on Spark functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = "\x20\t\n\x0b\x0c\r"  # what separates words
BLANK_CLASS = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once: inside higher-order functions Spark would repeat a plain expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK_CLASS), lambda w: w != "")


def indexes(n: Column) -> Column:
    """0 .. n - 1 as an array, empty if n < 1 (a plain sequence would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
