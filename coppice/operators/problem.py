"""Describing a divide-and-conquer problem: how a tree of sub-problems is shaped, and what is computed on it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(df: DataFrame) -> DataFrame:
    return df


@dataclass(frozen=True)
class Serial:
    """The same problem in plain Python, for sub-trees that end within a task: nodes are dictionaries with the payload.

    `values` are what a base node contributes and `non_base` what an inner node adds, both as dictionaries; `combine`
    joins the values of an inner node's children, in order, for a tree reduction.  `whole` replaces the walk over a
    sub-tree by a function of its root that returns the values of the sub-tree."""

    is_base: Callable[[dict], bool]
    children: Callable[[dict], list[dict]]
    values: Callable[[dict], dict]
    non_base: Callable[[dict], dict] | None = None
    combine: Callable[[dict, list[dict]], dict] | None = None
    pre: Callable[[dict], dict] = lambda node: node
    pre_rec: Callable[[dict], dict] = lambda node: node
    whole: Callable[[dict], dict] | None = None


@dataclass(frozen=True)
class Problem:
    """Sub-problems are rows.  `children` gives an array of structs with the payload's columns, in child order.

    Each row goes through `pre`, then `is_base` is asked; inner rows go through `pre_rec` before their children.
    `arity` is the number of children (0: it varies), `cost` a row's weight for balancing, `do_parallel` says of a row
    whether its children are still to be dealt out as rows, and `serial` is the same problem in Python.
    """

    payload: tuple[str, ...]
    is_base: Callable[[], Column]
    children: Callable[[], Column]
    pre: Callable[[DataFrame], DataFrame] = _same
    pre_rec: Callable[[DataFrame], DataFrame] = _same
    arity: int = 0
    cost: Callable[[], Column] = lambda: F.lit(1.0)
    do_parallel: Callable[[], Column] = lambda: F.lit(True)
    serial: Serial | None = None


@dataclass(frozen=True)
class Body:
    """`base`: values of base rows; `non_base`: values that inner rows add (none unless given); `combine`: for each
    value the aggregate that joins them (sum, min, max ...).  Null is the identity of every aggregate."""

    base: dict[str, Callable[[], Column]]
    combine: dict[str, Callable[[str], Column]]
    non_base: dict[str, Callable[[], Column]] = field(default_factory=dict)


def indices(n: Column) -> Column:
    """0 .. n - 1; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def levels_for_tasks(arity: int, tasks: int) -> int:
    """Levels of expansion that give `tasks` sub-problems; 3 for an unknown arity (0), none for 1."""
    if arity in (0, 1):
        return 0 if arity else 3
    level, reach = 0, 1
    while reach < tasks:
        level, reach = level + 1, reach * arity
    return level
