"""Chunk tuner: scores of measured chunk sizes, who survives, whom to try next."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
FIRST = (1, 2, 4, 8, 20)
ROUNDS = ((2, 4, 6, 16), (2, 4, 6, 8), (1, 2, 3, 8), (1, 2, 3, 4), (1, 1, 2, 8), (1, 1, 2, 4), (1, 1, 1, 4), (1, 1, 1, 2))  # tests at each level, by precision
LIMITS = (46, 36, 26, 18)  # chunk sizes tested at most, by precision 4 .. 1
MILLION = 1_000_000
GRADUAL, FALLING, SCORE, DROP_WORST = 0, 1, 2, 3  # modes


@dataclass(frozen=True)
class Options:
    """`mode`: GRADUAL (levels of falling tolerance with ROUNDS[sub] tests), FALLING (`sub` rounds, tolerance falls and
    losers go), SCORE (`sub` rounds, all stay), DROP_WORST (`sub` rounds, the worst goes after each).  Tolerances are
    millionths of the best speed; `seconds` bounds the whole search (0: no bound)."""

    statistic: str = "mean"  # mean, median or max of a chunk's speeds
    start_tolerance: int = 200_000
    end_tolerance: int = 50_000
    levels: int = 4
    largest: int = 1024
    mode: int = GRADUAL
    sub: int = 7
    most: int = 40
    seconds: float = 0.0


def _presets() -> dict[str, Options]:
    """The named settings: rounds that follow the results or are fixed, in four precisions, with or without a test time that
    is found automatically."""
    made = {"single_round": Options(start_tolerance=40_000, end_tolerance=40_000, mode=SCORE, sub=0, most=18)}
    kinds = {  # name: mode, sub and first tolerance for the precisions 4 .. 1, and whether the tolerance falls
        "dynamic_gradual": (GRADUAL, (0, 2, 5, 7), (90_000, 80_000, 70_000, 60_000), True),
        "fixed_gradual": (FALLING, (14, 6, 2, 1), (80_000, 60_000, 50_000, 40_000), True),
        "fixed_fixed": (SCORE, (14, 6, 2, 1), (80_000, 60_000, 50_000, 40_000), False),
        "fixed_drop_worst": (DROP_WORST, (14, 8, 3, 2), (80_000, 60_000, 50_000, 40_000), False),
    }
    for auto in ("", "auto_"):
        for name, (mode, subs, first, falls) in kinds.items():
            for k, level in enumerate((4, 3, 2, 1)):
                made[f"{auto}{name}_{level}"] = Options("mean", first[k], 10_000 if falls else first[k], 4, 1024, mode, subs[k], LIMITS[k])
    return made


PRESETS = _presets()


def test_seconds(o: Options) -> float:
    """The time that one test may take: a share of the whole time for the tests to be expected, or a fixed time."""
    if not o.seconds:
        return {0: 4.0, 1: 4.0, 2: 2.0, 3: 2.0, 4: 1.5, 5: 1.5}.get(o.sub, 1.0) if o.mode == GRADUAL else 2.0
    first = min(o.most, 12)
    if o.mode == GRADUAL:
        tests = ROUNDS[o.sub]
        share = 2.0 + sum((n - (i == len(tests) - 1)) / (i + 2) for i, n in enumerate(tests))
        return o.seconds / round(first * share)
    if o.mode == FALLING:
        return o.seconds / round(first * (o.sub + 2) / 2)
    if o.mode == SCORE:
        return o.seconds / (first * (o.sub + 1))
    n = min(o.sub + 1, first - 1)
    return o.seconds / (-((n * n - n) // 2) + first * n)


def tolerance(o: Options, level: int) -> int:
    if level < 0:
        return o.start_tolerance
    if level >= o.levels:
        return o.end_tolerance
    return o.start_tolerance - (o.start_tolerance - o.end_tolerance) // o.levels * (level + 1)


def scores(runs: DataFrame, statistic: str = "mean") -> DataFrame:
    """(chunk, score): the statistic of speed in millionths of the best."""
    of = {"mean": F.avg, "median": F.median, "max": F.max}[statistic]
    by = runs.groupBy("chunk").agg(of("speed").alias("s"))
    best = by.agg(F.max("s").alias("best"))
    return by.join(F.broadcast(best)).select("chunk", F.round(F.col("s") / F.col("best") * MILLION).cast("long").alias("score"))


def survivors(scored: DataFrame, allowed: int) -> DataFrame:
    return scored.where(F.col("score") >= MILLION - allowed)


def without_worst(scored: DataFrame) -> DataFrame:
    """All but the one with the least score (of equal ones the largest chunk); the last one stays."""
    worst = scored.orderBy("score", F.desc("chunk")).limit(1)
    more = scored.count() > 1
    return scored.join(F.broadcast(worst.select("chunk")), "chunk", "left_anti") if more else scored


def neighbours(kept: DataFrame, seen: DataFrame, largest: int) -> DataFrame:
    """Chunks one below or above a survivor that haven't been tried."""
    near = kept.select(F.explode(F.array(F.col("chunk") - 1, F.col("chunk") + 1)).alias("chunk")).distinct()
    return near.where((F.col("chunk") >= 1) & (F.col("chunk") <= largest)).join(seen.select("chunk").distinct(), "chunk", "left_anti")


def report(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("score"), "chunk")


def measure(spark: SparkSession, measured: list[tuple[int, float]]) -> DataFrame:
    """(chunk, speed): the samples taken so far."""
    return spark.createDataFrame(measured, "chunk int, speed double")


def autotune(spark: SparkSession, run: Callable[[int], object], work: float, options: Options = Options(), rounds: int = 2) -> DataFrame:
    """Times `run(chunk)`: first the initial candidates and, for at most `rounds` rounds, untried neighbours of survivors;
    then the survivors again as the mode says.  A ranked report.

    The candidates are a handful of numbers (`options.most` at most), so the loop is the driver's."""
    began, measured = time.perf_counter(), []
    out_of_time = lambda: options.seconds and time.perf_counter() - began > options.seconds

    def test(chunks) -> DataFrame:
        for c in chunks:
            if out_of_time() and measured:
                break
            at = time.perf_counter()
            run(c)
            measured.append((c, work / max(time.perf_counter() - at, 1e-9)))
        return scores(measure(spark, measured), options.statistic)

    todo = [c for c in FIRST if c <= options.largest][: options.most]
    scored = test(todo)
    for _ in range(rounds - 1):
        kept = survivors(scored, tolerance(options, -1))
        tried = len({c for c, _ in measured})
        todo = sorted(r[0] for r in neighbours(kept, measure(spark, measured), options.largest).collect())[: options.most - tried]
        if not todo or out_of_time():
            break
        scored = test(todo)
    if rounds > 1:
        alive = sorted(r["chunk"] for r in survivors(scored, tolerance(options, -1)).collect())
        plan = list(enumerate(ROUNDS[min(options.sub, 7)])) if options.mode == GRADUAL else [(k, 1) for k in range(options.sub)]
        for level, times in plan:
            if out_of_time() or (len(alive) < 2 and options.mode != SCORE):
                break
            for _ in range(times):
                scored = test(alive)
            of = scored.where(F.col("chunk").isin(alive))
            if options.mode in (GRADUAL, FALLING):
                step = level if options.mode == GRADUAL else level * options.levels // max(1, options.sub)
                of = survivors(of, tolerance(options, step))
            elif options.mode == DROP_WORST:
                of = without_worst(of)
            alive = sorted(r["chunk"] for r in of.collect()) or alive
    return report(scored)
