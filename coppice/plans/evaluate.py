"""Evaluation of a problem under a partitioner and a behavior: the one entry for flat folds and tree reductions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.operators.problem import Body, Problem, levels_for_tasks
from coppice.plans import frontier, granularity, tune
from coppice.plans.behavior import Behavior, all_gathers, resolve
from coppice.plans.decompose import RANK, Decomposition, Policy
from coppice.plans.granularity import AUTOMATIC, CUSTOM, DEPTH, SERIAL, SIMPLE, evaluate_serially
from coppice.plans.lineage import cut

BROADCAST_BYTES = 64 << 20
VALUE = "__v_"  # names of contributions begin so, apart from the payload's


@dataclass(frozen=True)
class RunInfo:
    """What the last run did: its partitioner, tasks, ranks, chunk size and seconds (the test's apart)."""

    partitioner: str
    tasks: int
    ranks: int
    chunk: int | None = None
    seconds: float = 0.0
    test_seconds: float = 0.0


@dataclass(frozen=True)
class Result:
    """`value`: the combined row, or a row for each rank; `input`: the rows that contributed, under `GATHER_INPUT`."""

    value: DataFrame | None
    input: DataFrame | None
    info: RunInfo


def replicated(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """`df` marked to be sent to every task if it has at most `most` bytes, by the size of its own files or plan; else as it
    is, so that joins shuffle."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most else df


def _levels(roots: DataFrame, problem: Problem, body: Body, keep: tuple[str, ...]) -> DataFrame:
    """Contributions of all nodes, every level as rows."""
    rows = roots.select(*problem.payload, *keep)
    parts, depth = [], 0
    while True:
        rows = cut(problem.pre(rows).withColumn("__base", problem.is_base()))
        if depth and rows.isEmpty():
            break
        inner = problem.pre_rec(rows.where("not __base"))
        for of, values in ((rows.where("__base"), body.base), (inner, body.non_base)):
            if values:
                parts.append(of.select(*problem.payload, F.lit(depth).cast("long").alias(DEPTH), *keep, *(v().alias(VALUE + k) for k, v in values.items())))
        rows = frontier.expand_level(rows.where("not __base"), problem, keep)
        depth += 1
    return reduce(DataFrame.unionByName, parts)


def _values(spark, problem: Problem, body: Body, roots: DataFrame) -> T.StructType:
    """The types of what base rows contribute."""
    return problem.pre(roots.select(*problem.payload)).select(*(v().alias(VALUE + k) for k, v in body.base.items())).schema


def evaluate(
    roots: DataFrame, problem: Problem, body: Body, partitioner: str = SIMPLE, behavior: Behavior = Behavior.DEFAULT, policy: Policy = Policy(), tasks: int | None = None,
    kept: Decomposition | None = None, distributed_post: Callable[[DataFrame], DataFrame] | None = None, gather_input_post: Callable[[DataFrame], DataFrame] | None = None, rank: Column | None = None,
) -> Result:
    """The flat fold of what all nodes contribute.

    `partitioner`: `simple` (every level as rows), `automatic`, `custom` or `serial` (sub-trees end within tasks; the
    problem needs its Python form).  Behaviors that speak of ranks open the tree for `policy` and deal it out, unless
    `DISTRIBUTED_INPUT` says by `rank` where each root belongs; `kept` is a decomposition to use again.
    `distributed_post` takes the ranks' partial results (a row for each rank) in place of the built-in combination, and
    `gather_input_post` the rows that come back under `GATHER_INPUT`."""
    spark, began = roots.sparkSession, time.perf_counter()
    b = resolve(behavior, bool(body.combine), problem.arity)
    tasks = tasks or spark.sparkContext.defaultParallelism
    dealt = distributed_post is not None or bool(b & (Behavior.DISTRIBUTED_OUTPUT | Behavior.REPLICATE_OUTPUT | Behavior.PRIORITIZE_DM | Behavior.SCATTER | Behavior.GATHER | Behavior.BALANCE | Behavior.DISTRIBUTED_INPUT)) or kept is not None
    if b & Behavior.REPLICATE_INPUT:
        roots = replicated(roots)
    keep: tuple[str, ...] = (RANK,) if dealt else ()
    above: DataFrame | None = None
    if b & Behavior.DISTRIBUTED_INPUT:
        roots = roots.withColumn(RANK, rank if rank is not None else F.spark_partition_id())
    elif dealt:
        tree = kept or Decomposition(problem, roots, policy, b)
        if body.non_base:
            opened = [problem.pre_rec(f.where("not __base")).select(*problem.payload, F.lit(k).cast("long").alias(DEPTH), F.lit(0).alias(RANK), *(v().alias(VALUE + n) for n, v in body.non_base.items())) for k, f in enumerate(tree.levels()[:-1])]
            above = reduce(DataFrame.unionByName, opened) if opened else None
        roots = tree.dealt()
        roots = roots.repartitionByRange(policy.ranks, RANK) if b & Behavior.SCATTER else roots.repartition(policy.ranks, RANK)
    if partitioner == SIMPLE:
        rows = _levels(roots, problem, body, keep)
    else:
        rows = granularity.contributions(roots, problem, _values(spark, problem, body, roots), partitioner, tasks, keep, prefix=VALUE, each=-(-tasks // policy.ranks) if dealt else None)
    if above is not None:
        rows = rows.unionByName(above.select(*rows.columns))
    back = None
    if b & Behavior.GATHER_INPUT:
        rows = cut(rows)
        back = rows.select(*problem.payload, *keep)
        back = gather_input_post(back) if gather_input_post else back
    value = _combined(rows, problem, body, b, policy, distributed_post) if body.combine else None
    return Result(value, back, RunInfo(partitioner, tasks, policy.ranks if dealt else 1, seconds=time.perf_counter() - began))


def evaluate_test(roots: DataFrame, problem: Problem, body: Body, options: tune.Options = tune.Options(), rounds: int = 2, unit: int = 1000, partitioner: str = AUTOMATIC, tasks: int | None = None) -> DataFrame:
    """The tuner's ranked report of chunk sizes for a flat fold: a chunk is the number of nodes (in `unit`s) that a task
    walks before it hands back what is open.  Every run is a whole evaluation."""
    values = _values(roots.sparkSession, problem, body, roots)

    def run(chunk: int) -> None:
        granularity.contributions(roots, problem, values, partitioner, tasks, budget=chunk * unit, prefix=VALUE).agg(*(make(VALUE + k) for k, make in body.combine.items())).collect()

    return tune.autotune(roots.sparkSession, run, 1.0, options, rounds)


def _combined(rows: DataFrame, problem: Problem, body: Body, b: Behavior, policy: Policy, post: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    made = [make(VALUE + k).alias(k) for k, make in body.combine.items()]
    again = [make(k).alias(k) for k, make in body.combine.items()]
    if post is not None:
        return post(rows.groupBy(RANK).agg(*made))
    if b & Behavior.DISTRIBUTED_OUTPUT:
        return rows.groupBy(RANK).agg(*made)
    if b & Behavior.GATHER:  # a struct for each rank, in the order of ranks
        listed = F.array_sort(F.collect_list(F.struct(RANK, *body.combine))).alias("gathered")
        value = rows.groupBy(RANK).agg(*made).agg(listed, *([] if all_gathers(b) else again))
    elif b & Behavior.PRIORITIZE_DM:  # ranks combine as the tree does, level by level
        value, left = rows.groupBy(RANK).agg(*made), policy.ranks
        while left > 1:
            left = -(-left // max(2, problem.arity))
            value = value.groupBy(F.floor(F.col(RANK) / max(2, problem.arity)).cast("int").alias(RANK)).agg(*again)
        value = value.agg(*again)
    else:
        value = rows.agg(*made)
    if b & Behavior.REPLICATE_OUTPUT:
        return value.select(F.explode(F.sequence(F.lit(0), F.lit(policy.ranks - 1))).alias(RANK), "*")
    return value


def evaluate_tree(
    roots: DataFrame, problem: Problem, base: Callable[[], Column], combine: Callable[[Column], Column], value: str = "value", partitioner: str = SIMPLE, tasks: int | None = None,
) -> DataFrame:
    """The ordered reduction of each root's tree: (payload, value).

    Under `automatic`, `custom` and `serial` sub-trees end within tasks, by the problem's Python form."""
    if partitioner == SIMPLE:
        return frontier.tree_reduce(roots, problem, base, combine, value)
    deal = {AUTOMATIC: levels_for_tasks(problem.arity, tasks or roots.sparkSession.sparkContext.defaultParallelism), SERIAL: 0, CUSTOM: None}[partitioner]
    serial, payload = problem.serial, problem.payload
    kind = problem.pre(roots.select(*payload)).select(base().alias(value)).schema[0].dataType

    def finish(rows: DataFrame) -> DataFrame:
        rows = rows.select(*payload, "__id", "__up", "__ix")
        out = T.StructType([*rows.schema, T.StructField(value, kind)])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield f.assign(**{value: pd.Series([evaluate_serially({k: r[k] for k in payload}, serial, True)[value] for r in f.to_dict("records")], index=f.index, dtype=object)})

        return rows.mapInPandas(run, out)

    stop = (lambda depth: ~problem.do_parallel()) if deal is None else (lambda depth: F.lit(depth >= deal))
    return frontier.tree_reduce(roots, problem, base, combine, value, stop, finish)
