"""Deals a tree's sub-problems to ranks: how far the tree is opened, and which rank gets what."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.operators import balance
from coppice.operators.problem import Problem
from coppice.plans.behavior import Behavior, resolve
from coppice.plans.frontier import expand_level
from coppice.plans.lineage import cut

RANK = "rank"
SMALL = 100_000  # sub-problems whose costs are dealt on the driver; more are dealt by distributed prefix sums


@dataclass(frozen=True)
class Policy:
    ranks: int = 4
    max_imbalance: float = 0.2
    most_per_rank: int = 50


def block_loads(costs: list[float], ranks: list[int], parts: int) -> list[float]:
    loads = [0.0] * parts
    for c, r in zip(costs, ranks):
        loads[r] += c
    return loads


def _imbalance(loads: list[float]) -> float:
    return 1000.0 if not min(loads) else (max(loads) - min(loads)) / min(loads)


def deal(costs: list[float], parts: int, by_cost: bool) -> list[int]:
    """Ranks (from 0) of ordered sub-problems: blocks of like number, or a greedy split by cost that is then refined."""
    if by_cost:
        return balance.refine_split(costs, balance.greedy_split(costs, parts), parts)
    small, more = divmod(len(costs), parts)
    return [r for r in range(parts) for _ in range(small + (r < more))]


def open_tree(roots: DataFrame, problem: Problem, policy: Policy = Policy(), behavior: Behavior = Behavior.DEFAULT) -> list[DataFrame]:
    """The opened levels: each with its rows as `pre` left them, as they came (`__raw`), `path` (child indexes from the
    root), `cost` and `__base`.

    Opening stops when a level has no inner row or doesn't grow, when sub-problems suffice for the ranks (and, under
    `BALANCE`, their loads differ by at most `max_imbalance`), or at `most_per_rank` sub-problems for each rank."""
    b = resolve(behavior, arity=problem.arity)
    frontier = roots.select(*problem.payload, F.array(F.lit(0)).alias("path"))
    held, done, before = [], 0, 0
    while True:
        frontier = frontier.withColumn("__raw", F.struct(*problem.payload))
        frontier = cut(problem.pre(frontier).withColumn("__base", problem.is_base()).withColumn("cost", problem.cost().cast("double")))
        held.append(frontier)
        n, inner = frontier.agg(F.count(F.lit(1)), F.coalesce(F.sum((~F.col("__base")).cast("long")), F.lit(0))).first()
        total = done + n
        if not inner or (len(held) > 1 and n <= before) or total >= policy.most_per_rank * policy.ranks:
            return held
        if total >= policy.ranks:
            if not b & Behavior.BALANCE:
                return held
            costs = [r["cost"] for r in leaves(held).orderBy("path").select("cost").collect()]  # under most_per_rank * ranks
            by_cost = bool(b & Behavior.USE_COST)
            weights = costs if by_cost else [1.0] * len(costs)
            if _imbalance(block_loads(weights, deal(costs, policy.ranks, by_cost), policy.ranks)) <= policy.max_imbalance:
                return held
        done, before = done + n - inner, n
        kids = problem.pre_rec(frontier.where(~F.col("__base"))).select("path", F.posexplode(problem.children()).alias("__ix", "__child"))
        frontier = kids.select(*(F.col(f"__child.{c}").alias(c) for c in problem.payload), F.concat("path", F.array("__ix")).alias("path"))
        if b & Behavior.PRIORITIZE_DM:  # a level goes to as many ranks as it has parents' children
            frontier = frontier.repartition(min(policy.ranks, problem.arity ** len(held)), "path")


def leaves(held: list[DataFrame]) -> DataFrame:
    """Sub-problems that were not opened, as they came: base rows of all levels and all rows of the last."""
    rows = reduce(DataFrame.unionByName, [*(f.where("__base") for f in held[:-1]), held[-1]])
    return rows.select("__raw.*", "path", "cost", "__base")


def deal_to_ranks(parts: DataFrame, policy: Policy = Policy(), behavior: Behavior = Behavior.DEFAULT) -> DataFrame:
    """`parts` with RANK (from 0): contiguous in tree order."""
    b, spark = resolve(behavior, arity=1), parts.sparkSession
    by_cost = bool(b & Behavior.USE_COST)
    if parts.count() > SMALL:
        if by_cost:
            return balance.by_cost(parts, F.col("cost"), "path", parts=policy.ranks).withColumn(RANK, F.col("rank") - 1).drop("pos")
        return balance.block_distribution(parts, "path", parts=policy.ranks).withColumn(RANK, F.col("rank") - 1).drop("pos")
    rows = parts.orderBy("path").select("path", "cost").collect()  # SMALL at most
    ranks = deal([r["cost"] for r in rows], policy.ranks, by_cost)
    table = spark.createDataFrame([(list(r["path"]), k) for r, k in zip(rows, ranks)], "path array<int>, rank int")
    return parts.join(F.broadcast(table), "path")


@dataclass
class Decomposition:
    """A tree's opened levels and their ranks, kept so that later evaluations need not open it again.

    With `buffered`, results are kept by name as well (`result`)."""

    problem: Problem
    roots: DataFrame
    policy: Policy = Policy()
    behavior: Behavior = Behavior.DEFAULT
    buffered: bool = False
    _held: list[DataFrame] = field(default_factory=list)
    _dealt: DataFrame | None = None
    _results: dict[str, DataFrame] = field(default_factory=dict)

    def levels(self) -> list[DataFrame]:
        if not self._held:
            self._held = open_tree(self.roots, self.problem, self.policy, self.behavior)
        return self._held

    def dealt(self) -> DataFrame:
        """The unopened sub-problems with their ranks."""
        if self._dealt is None:
            self._dealt = cut(deal_to_ranks(leaves(self.levels()), self.policy, self.behavior))
        return self._dealt

    def result(self, name: str, make) -> DataFrame:
        """`make(dealt)`, computed once for each name if buffered."""
        if not self.buffered:
            return make(self.dealt())
        if name not in self._results:
            self._results[name] = cut(make(self.dealt()))
        return self._results[name]

    def reset(self) -> None:
        """Forgets levels, ranks and results; the files that held them go when the session ends."""
        self._held, self._dealt, self._results = [], None, {}
