"""Ranges, their chunks, and positions of rows in a distributed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.operators.problem import Problem, Serial, indices
from coppice.plans.lineage import cut


def with_position(df: DataFrame, *order: str | Column, partitions: int | None = None, part_col: str | None = None) -> DataFrame:
    """`df` with `pos`, the row's place (from 0) in the given order, without gathering rows in one task.

    Rows are range-partitioned and sorted; the offsets of partitions (one number each) come from a count.  `part_col`
    names a column for a row's partition.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    placed = cut(placed)
    part, inside = F.shiftright("__m", 33).cast("int"), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, at = [], 0
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(at)
        at += sizes.get(p, 0)
    base = F.element_at(F.array(*map(F.lit, offsets or [0])), part + 1)
    out = placed.withColumn("pos", inside + base)
    return (out.withColumn(part_col, part) if part_col else out).drop("__m")


def chunk_of(pos: Column, n: Column, tasks: int) -> Column:
    """The chunk (from 1) of a position when `n` elements are split in `tasks`: the first n % tasks chunks have one more."""
    small, more = F.floor(n / tasks), n % tasks
    edge = more * (small + 1)
    return F.when(pos < edge, F.floor(pos / (small + 1))).otherwise(more + F.floor((pos - edge) / F.greatest(small, F.lit(1)))).cast("int") + 1


def size(start: Column, end: Column, inclusive: bool = False) -> Column:
    return end - start + (1 if inclusive else 0)


def shift(start: Column, end: Column, by: int | Column) -> tuple[Column, Column]:
    return start + by, end + by


def max_chunk(start: Column, end: Column, n: int, inclusive: bool = False) -> Column:
    return F.ceil(size(start, end, inclusive) / n)


def split_range(spark, start: int, end: int, tasks: int, inclusive: bool = False) -> DataFrame:
    """(chunk, start, end) of a range split in `tasks`."""
    n = end - start + (1 if inclusive else 0)
    k = F.col("id")
    low = start + k * (n // tasks) + F.least(k, F.lit(n % tasks))
    width = n // tasks + F.when(k < n % tasks, 1).otherwise(0)
    return spark.range(tasks).select((k + 1).alias("chunk"), low.alias("start"), (low + width - (1 if inclusive else 0)).alias("end"))


def nested_ranges(spark, start: int, end: int, procs: int, tasks: int, inclusive: bool = False) -> DataFrame:
    """(proc, task, start, end): a range split among `procs`, each part split in `tasks`."""
    outer = split_range(spark, start, end, procs, inclusive).select(F.col("chunk").alias("proc"), "start", "end")
    n, one = F.col("end") - F.col("start") + (1 if inclusive else 0), 1 if inclusive else 0
    k = F.col("k").cast("long")
    edge = lambda i: F.col("start") + i * F.floor(n / tasks) + F.least(i, n % tasks)
    rows = outer.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    return rows.select("proc", (F.col("k") + 1).alias("task"), edge(k).alias("start"), (edge(k + 1) - one).alias("end"))


def nested_split(arity: int, limit: int = 0) -> Problem:
    """Recursive split of [start, end) in `arity` parts; a base range is shorter than `arity`.  `limit`: ranges of at most
    that length aren't dealt out as rows under `custom`."""
    def children() -> Column:
        start, length = F.col("start"), F.col("end") - F.col("start")
        edge = lambda i: start + i * F.floor(length / arity) + F.least(i.cast("long"), length % arity)
        return F.transform(indices(F.lit(arity)), lambda i: F.struct(edge(i).alias("start"), edge(i + 1).alias("end")))

    def kids(node: dict) -> list[dict]:
        small, more = divmod(node["end"] - node["start"], arity)
        edges = [node["start"] + i * small + min(i, more) for i in range(arity + 1)]
        return [{"start": a, "end": b} for a, b in zip(edges, edges[1:])]

    length = lambda: F.col("end") - F.col("start")
    serial = Serial(lambda x: x["end"] - x["start"] < arity, kids, lambda x: {"n": x["end"] - x["start"]})
    return Problem(("start", "end"), lambda: length() < arity, children, arity=arity, cost=lambda: length().cast("double"), do_parallel=lambda: length() > limit, serial=serial)


def midpoint_split() -> Problem:
    """Binary split of the inclusive range [start, end] at its middle, down to single numbers."""

    def children() -> Column:
        mid = F.floor((F.col("start") + F.col("end")) / 2)
        return F.array(F.struct(F.col("start").alias("start"), mid.alias("end")), F.struct((mid + 1).alias("start"), F.col("end").alias("end")))

    def kids(node: dict) -> list[dict]:
        mid = (node["start"] + node["end"]) // 2
        return [{"start": node["start"], "end": mid}, {"start": mid + 1, "end": node["end"]}]

    serial = Serial(lambda x: x["start"] >= x["end"], kids, lambda x: {"total": x["start"], "leaves": 1}, combine=lambda x, of: {k: sum(v[k] for v in of) for k in ("total", "leaves")})
    return Problem(("start", "end"), lambda: F.col("start") >= F.col("end"), children, arity=2, cost=lambda: (F.col("end") - F.col("start") + 1).cast("double"), do_parallel=lambda: F.col("end") - F.col("start") > 64, serial=serial)


def ranged(df: DataFrame, chunks: int, *order: str | Column, relative: bool = False) -> DataFrame:
    """A table as a ranged problem: `pos` (in the whole, or with `relative` in its chunk) and `chunk` (from 1), the chunks
    being contiguous ranges that differ by one row at most."""
    placed = with_position(df, *order)
    n = placed.count()
    out = placed.withColumn("chunk", chunk_of(F.col("pos"), F.lit(n), chunks))
    if not relative:
        return out
    small, more = divmod(n, chunks)
    k = F.col("chunk") - 1
    return out.withColumn("pos", F.col("pos") - (k * small + F.least(k, F.lit(more))))


def fill(df: DataFrame, value: Column, start: int, end: int, name: str = "value") -> DataFrame:
    """A slice that owns its storage: the rows of [start, end) with `value` in place of their own, as a table apart."""
    return slice_rows(df, start, end).withColumn(name, value)


def slice_rows(df: DataFrame, start: int, end: int, relative: bool = False) -> DataFrame:
    """Rows with start <= pos < end; with `relative`, positions count from `start`."""
    out = df.where((F.col("pos") >= start) & (F.col("pos") < end))
    return out.withColumn("pos", F.col("pos") - start) if relative else out
