"""Block distribution, imbalance, and cost-balanced splits of ordered items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.operators.ranges import chunk_of, with_position


def block_distribution(df: DataFrame, *order: str, parts: int) -> DataFrame:
    """`df` with pos and rank (1 .. parts): contiguous blocks, the first n % parts with one more."""
    placed = with_position(df, *order)
    return placed.withColumn("rank", chunk_of(F.col("pos"), F.lit(placed.count()), parts))


def imbalance(loads: DataFrame, load: str = "n") -> DataFrame:
    """(max - min) / min of the loads; 1000 if the least is 0."""
    low, high = F.min(load), F.max(load)
    return loads.agg(F.when(low == 0, F.lit(1000.0)).otherwise((high - low) / low).alias("imbalance"))


def by_cost(df: DataFrame, cost: Column, *order: str, parts: int) -> DataFrame:
    """`df` with rank: an item's rank is that of the cost before it, so ranks hold contiguous items of like cost.

    Prefix sums run within range partitions; the sums of partitions (one number each) give their offsets.
    """
    spark = df.sparkSession
    rows = with_position(df.withColumn("cost", cost.cast("double")), *order, part_col="part")
    at, before = 0.0, []
    for part, s in sorted(rows.groupBy("part").agg(F.sum("cost")).collect()):  # a row for each partition
        before.append((part, at))
        at += s or 0.0
    offsets = spark.createDataFrame(before, "part int, before double")
    inside = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(offsets), "part").withColumn("at", F.coalesce(F.sum("cost").over(inside), F.lit(0.0)) + F.col("before"))
    return out.withColumn("rank", F.least(F.lit(parts), F.floor(F.col("at") * parts / F.lit(at or 1.0)) + 1).cast("int")).drop("part", "before", "at")


def greedy_split(costs: list[float], parts: int, slack: float = 0.0) -> list[int]:
    """Ranks (from 0) of ordered costs: the next rank begins when the limit would be passed; the last takes the rest.

    For a frontier on the driver (a few dozen items a rank)."""
    limit = sum(costs) / parts * (1 + slack) if costs else 0.0
    out, rank, held = [], 0, 0.0
    for c in costs:
        if held and held + c > limit and rank < parts - 1:
            rank, held = rank + 1, 0.0
        held += c
        out.append(rank)
    return out


def refine_split(costs: list[float], ranks: list[int], parts: int, rounds: int = 100) -> list[int]:
    """Moves boundary items off the most loaded rank while that lowers the highest load."""
    ranks = list(ranks)
    for _ in range(rounds):
        load = [sum(c for c, r in zip(costs, ranks) if r == k) for k in range(parts)]
        worst = max(range(parts), key=load.__getitem__)
        own = [i for i, r in enumerate(ranks) if r == worst]
        moves = [(max(load[worst] - costs[i], load[to] + costs[i]), i, to) for i, to in ((own[0], worst - 1), (own[-1], worst + 1)) if own and 0 <= to < parts] if own else []
        if not moves or min(moves)[0] >= load[worst]:
            return ranks
        _, i, to = min(moves)
        ranks[i] = to
    return ranks
