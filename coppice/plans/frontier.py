"""Evaluates a divide-and-conquer problem over DataFrames, one level of the recursion tree at a time.

`fold`: every base row (and inner row, if asked) contributes to one flat aggregate; no parent ids are kept.  Equal rows
of a level can be merged under a multiplicity (`collapse`), which turns an exponential tree into few rows.
`tree_reduce`: results go up from children to parents level by level, for combines that need order or structure.

Each level's frontier is cut (written to the shared checkpoint folder), so plans stay short and survive lost executors.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.operators.problem import Body, Problem
from coppice.plans.lineage import cut

MULTIPLICITY = "__n"


def expand_level(frontier: DataFrame, problem: Problem, keep: tuple[str, ...] = ()) -> DataFrame:
    """Children of the inner rows of `frontier`; `keep` names further columns that children inherit."""
    inner = problem.pre_rec(frontier)
    out = inner.select(*keep, F.explode(problem.children()).alias("__child"))
    return out.select(*keep, *(F.col(f"__child.{c}").alias(c) for c in problem.payload))


def levels(roots: DataFrame, problem: Problem, collapse: bool = False, limit: int = 10_000):
    """Yields (depth, frontier) with `__base`, after `pre`, until no inner row is left.

    With `collapse`, equal rows are one with their number in MULTIPLICITY.
    """
    frontier = roots.select(*problem.payload, *((F.lit(1).cast("decimal(38,0)").alias(MULTIPLICITY),) if collapse else ()))
    for depth in range(limit):
        if collapse:
            frontier = frontier.groupBy(*problem.payload).agg(F.sum(MULTIPLICITY).cast("decimal(38,0)").alias(MULTIPLICITY))
        frontier = cut(problem.pre(frontier).withColumn("__base", problem.is_base()))
        if frontier.isEmpty():
            return
        yield depth, frontier
        frontier = expand_level(frontier.where(~F.col("__base")), problem, (MULTIPLICITY,) if collapse else ())
    raise RecursionError(f"the tree is deeper than {limit}")


def fold(roots: DataFrame, problem: Problem, body: Body, collapse: bool = False) -> DataFrame:
    """One row: the combination of all contributions.  Under `collapse` contributions are multiplied, so all combines
    must be sums."""
    parts = []
    for depth, frontier in levels(roots, problem, collapse):
        frontier = frontier.withColumn("__depth", F.lit(depth))
        for rows, values in ((frontier.where("__base"), body.base), (frontier.where("not __base"), body.non_base)):
            if values:
                parts.append(rows.select(*((v() * F.col(MULTIPLICITY) if collapse else v()).alias(k) for k, v in values.items())))
    if not parts:  # no root: the same aggregates over no rows
        roots = problem.pre(roots.select(*problem.payload).limit(0))
        parts = [roots.select(*(v().alias(k) for k, v in (body.base or body.non_base).items()))]
    every = reduce(DataFrame.unionByName, parts)
    return every.agg(*(make(k).alias(k) for k, make in body.combine.items()))


def tree_reduce(
    roots: DataFrame, problem: Problem, base: Callable[[], Column], combine: Callable[[Column], Column], value: str = "value",
    stop: Callable[[int], Column] | None = None, finish: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(root payload, value): results of children, in child order as an array, combined at each inner node.

    `combine` sees the array of the children's values and the node's own payload columns.  Inner rows of a depth for which
    `stop` holds are not opened: `finish` adds their values.
    """
    held: list[DataFrame] = []
    frontier = roots.select(*problem.payload).withColumn("__id", F.monotonically_increasing_id().cast("string")).withColumn("__up", F.lit(None).cast("string")).withColumn("__ix", F.lit(0))
    while True:
        frontier = problem.pre(frontier).withColumn("__base", problem.is_base())
        frontier = cut(frontier.withColumn("__stop", ~F.col("__base") & (stop(len(held)) if stop else F.lit(False))))
        if held and frontier.isEmpty():
            break
        held.append(frontier)
        if stop and not frontier.where("not __base and not __stop").limit(1).count():
            break
        inner = problem.pre_rec(frontier.where("not __base and not __stop"))
        kids = inner.select(F.col("__id").alias("__up"), F.posexplode(problem.children()).alias("__ix", "__child"))
        frontier = kids.select(*(F.col(f"__child.{c}").alias(c) for c in problem.payload), F.concat_ws(".", "__up", F.col("__ix").cast("string")).alias("__id"), "__up", "__ix")
    done: DataFrame | None = None
    for level in reversed(held):
        own = level.where("__base").select(*problem.payload, "__id", "__up", "__ix", base().alias(value))
        if finish:
            own = own.unionByName(finish(level.where("__stop")))
        if done is not None:
            gathered = done.groupBy("__up").agg(F.array_sort(F.collect_list(F.struct("__ix", value))).alias("__kids")).withColumnRenamed("__up", "__id")
            above = problem.pre_rec(level.where("not __base and not __stop")).join(gathered, "__id")
            own = own.unionByName(above.select(*problem.payload, "__id", "__up", "__ix", combine(F.col(f"__kids.{value}")).alias(value)))
        done = cut(own)
    return done.select(*problem.payload, value)


def reduce_table(nodes: DataFrame, values: dict[str, Callable[[str], Column]], node: str = "node", up: str = "up", depth: str = "depth") -> DataFrame:
    """(node, values): an explicit tree's tables of own values combined from the deepest level up.

    `nodes` holds node, up (null at roots), depth (0 at roots) and a column for each of `values`; nodes without children
    keep their own.  A level's sums are one aggregate by the node above, so only one level's rows are moved at a time."""
    rows = cut(nodes.select(node, up, depth, *values))
    deepest = rows.agg(F.max(depth)).first()[0]
    done: list[DataFrame] = []
    below: DataFrame | None = None
    for d in range(-1 if deepest is None else deepest, -1, -1):
        level = rows.where(F.col(depth) == d).select(node, up, *values)
        if below is not None:
            sent = below.where(F.col(up).isNotNull()).select(F.col(up).alias(node), *values)
            own = level.select(node, *values).unionByName(sent).groupBy(node).agg(*(make(k).alias(k) for k, make in values.items()))
            level = own.join(level.select(node, up), node)
        below = cut(level)
        done.append(below)
    every = reduce(DataFrame.unionByName, done) if done else rows.select(node, up, *values)
    return every.select(node, *values)
