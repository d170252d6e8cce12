"""Means and the median, as aggregates; an empty input gives 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean(x: Column, integral: bool = False) -> Column:
    """`integral`: rounded to the nearest whole number, as for whole numbers."""
    out = F.coalesce(F.avg(x), F.lit(0.0))
    return F.round(out).cast("long") if integral else out


def harmonic_mean(x: Column) -> Column:
    return F.coalesce(F.count(x) / F.sum(1 / x), F.lit(0.0))


def geometric_mean(x: Column) -> Column:
    return F.coalesce(F.exp(F.avg(F.ln(x))), F.lit(0.0))


def median(x: Column, integral: bool = False) -> Column:
    out = F.coalesce(F.median(x), F.lit(0.0))
    return F.round(out).cast("long") if integral else out
