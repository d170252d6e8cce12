"""Sub-trees that end within a task.

Below the cut-off a sub-tree is walked in Python, on a stack, so a tree costs a few jobs instead of one for each level.
A task walks at most `budget` nodes of a root; nodes still open then come back as rows and are dealt out again, so one
deep or wide sub-tree cannot hold up a task, however uneven the tree is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.operators.problem import Problem, Serial, levels_for_tasks
from coppice.plans.lineage import cut

BUDGET = 100_000
SIMPLE, AUTOMATIC, CUSTOM, SERIAL = "simple", "automatic", "custom", "serial"
DEPTH, READY, FINISHED = "__depth", "__ready", "__finished"  # READY: `pre` has been applied


def walk(root: dict, serial: Serial, budget: int, ready: bool = False) -> tuple[list[tuple[dict, dict, int]], list[tuple[dict, int]]]:
    """((node, values, depth below the root) of contributions, (node, depth) of nodes left open) of a sub-tree."""
    if serial.whole is not None:
        return [(root, serial.whole(root), 0)], []
    out, stack, seen = [], [(root, 0)], 0
    while stack and seen < budget:
        node, depth = stack.pop()
        seen += 1
        node = dict(node) if ready and not depth else serial.pre(dict(node))
        if serial.is_base(node):
            out.append((node, serial.values(node), depth))
            continue
        node = serial.pre_rec(node)
        if serial.non_base is not None:
            out.append((node, serial.non_base(node), depth))
        stack.extend((kid, depth + 1) for kid in reversed(serial.children(node)))
    return out, stack


def evaluate_serially(root: dict, serial: Serial, ready: bool = False) -> dict:
    """The value of a whole sub-tree by an ordered reduction, on an explicit stack; `ready`: the root has been through
    `pre`."""
    if serial.whole is not None:
        return serial.whole(root)
    done: list[dict] = []
    stack: list[tuple[dict, int]] = [(root, -1)]  # -1: to be opened; else the number of its children's values
    while stack:
        node, kids = stack.pop()
        if kids < 0:
            node = dict(node) if ready and node is root else serial.pre(dict(node))
            if serial.is_base(node):
                done.append(serial.values(node))
                continue
            node = serial.pre_rec(node)
            below = serial.children(node)
            stack.append((node, len(below)))
            stack.extend((kid, -1) for kid in reversed(below))
        else:
            values = done[len(done) - kids :]
            del done[len(done) - kids :]
            done.append(serial.combine(node, values))
    return done[0]


def finish_in_tasks(frontier: DataFrame, serial: Serial, values: T.StructType, keep: tuple[str, ...] = (), budget: int = BUDGET, prefix: str = "") -> DataFrame:
    """Ends the sub-problems of `frontier` inside tasks: a row for each contribution, with FINISHED true, and one for each
    node that `budget` left open.  Rows hold the node's columns, DEPTH (added to the frontier's own), `keep` and `values`,
    whose names are `prefix` and what the Python form calls them."""
    payload = [f for f in frontier.schema.fields if f.name not in (*keep, DEPTH, READY)]
    kept = [frontier.schema[k] for k in keep]
    schema = T.StructType([*payload, T.StructField(DEPTH, T.LongType()), *kept, T.StructField(FINISHED, T.BooleanType()), *(T.StructField(v.name, v.dataType) for v in values.fields)])
    names, own = [f.name for f in schema.fields], [f.name for f in payload]
    none = dict.fromkeys(v.name for v in values.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                done, left = walk({k: r[k] for k in own}, serial, budget, r[READY])
                rest = {k: r[k] for k in keep}
                rows += [{**{k: n.get(k) for k in own}, DEPTH: r[DEPTH] + d, **rest, FINISHED: True, **{prefix + k: x for k, x in v.items()}} for n, v, d in done]
                rows += [{**n, DEPTH: r[DEPTH] + d, **rest, FINISHED: False, **none} for n, d in left]
                if len(rows) >= BUDGET:
                    yield pd.DataFrame(rows, columns=names, dtype=object)
                    rows = []
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return frontier.select(*own, DEPTH, READY, *keep).mapInPandas(run, schema)


def contributions(roots: DataFrame, problem: Problem, values: T.StructType, partitioner: str = AUTOMATIC, tasks: int | None = None, keep: tuple[str, ...] = (), budget: int = BUDGET, prefix: str = "", each: int | None = None) -> DataFrame:
    """What the nodes of the trees under `roots` contribute, by the problem's Python form: (payload, DEPTH, keep, values).

    `automatic` deals out as many levels as give `tasks` sub-problems (or `each` under every root), `custom` those rows for which `do_parallel` holds,
    and `serial` hands the roots over as they are."""
    spark = roots.sparkSession
    tasks = tasks or spark.sparkContext.defaultParallelism
    columns = [*problem.payload, DEPTH, READY, *keep]
    frontier = roots.select(*problem.payload, *keep).withColumn(DEPTH, F.lit(0).cast("long")).withColumn(READY, F.lit(False)).select(*columns)
    todo, inner_rows = [], []
    level, deal = 0, levels_for_tasks(problem.arity, each or tasks) if partitioner == AUTOMATIC else 0
    while partitioner == CUSTOM or level < deal:
        ready = problem.pre(frontier).withColumn(READY, F.lit(True)).withColumn("__base", problem.is_base())
        ready = ready.withColumn("__go", ~F.col("__base") & (problem.do_parallel() if partitioner == CUSTOM else F.lit(True)))
        ready = cut(ready) if partitioner == CUSTOM or level % 3 == 2 else ready  # short plans stay in one job
        todo.append(ready.where("not __go").select(*columns))
        inner = problem.pre_rec(ready.where("__go"))
        if problem.serial.non_base is not None:
            inner_rows.append(inner.select(*columns))
        frontier = inner.select(*keep, (F.col(DEPTH) + 1).alias(DEPTH), F.lit(False).alias(READY), F.explode(problem.children()).alias("__child")).select(*(F.col(f"__child.{c}").alias(c) for c in problem.payload), DEPTH, READY, *keep)
        level += 1
        if partitioner == CUSTOM and ready.where("__go").isEmpty():
            break
    todo.append(frontier)
    out = []
    if inner_rows:
        alone = Serial(lambda node: True, lambda node: [], problem.serial.non_base)
        out.append(finish_in_tasks(reduce(DataFrame.unionByName, inner_rows), alone, values, keep, budget, prefix).where(FINISHED))
    rest = reduce(DataFrame.unionByName, todo)
    rest = rest.repartition(tasks) if level else rest
    while True:
        done = cut(finish_in_tasks(rest, problem.serial, values, keep, budget, prefix))
        out.append(done.where(FINISHED))
        open_ = done.where(~F.col(FINISHED))
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, out).drop(FINISHED)
        rest = open_.select(*problem.payload, DEPTH, F.lit(False).alias(READY), *keep).repartition(tasks)
