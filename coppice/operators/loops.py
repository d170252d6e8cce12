"""Parallel loops and reductions over an index range or a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.operators.ranges import chunk_of, with_position
from coppice.plans import tune
from coppice.plans.behavior import Behavior, resolve


def pfor(spark: SparkSession, start: int, end: int, tasks: int, **body: Callable[[Column], Column]) -> DataFrame:
    """(i, values) for each i in [start, end), computed in `tasks` partitions and left there."""
    df = spark.range(start, end, 1, tasks).withColumnRenamed("id", "i")
    return df.select("i", *(f(F.col("i")).alias(k) for k, f in body.items()))


def pfor_reduce(spark: SparkSession, start: int, end: int, tasks: int, body: Callable[[Column], Column], reducer: Callable[[Column], Column] = F.sum, neutral: Column | None = None) -> DataFrame:
    """One row `value`: the reduction of body(i); for an empty range `neutral`, or null."""
    value = reducer(body(F.col("id")))
    return spark.range(start, end, 1, tasks).agg((value if neutral is None else F.coalesce(value, neutral)).alias("value"))


def chunks_of(start: int, end: int, chunk: int) -> int:
    """The number of chunks of at most `chunk` indexes."""
    return max(1, -(-(end - start) // max(1, chunk)))


def psfor(spark: SparkSession, start: int, end: int, chunk: int, **body: Callable[[Column], Column]) -> DataFrame:
    """`pfor` over chunks of at most `chunk` indexes, a task each."""
    return pfor(spark, start, end, chunks_of(start, end, chunk), **body)


def psfor_reduce(spark: SparkSession, start: int, end: int, chunk: int, body: Callable[[Column], Column], reducer: Callable[[Column], Column] = F.sum, neutral: Column | None = None) -> DataFrame:
    """`pfor_reduce` over chunks; the reducer must commute."""
    return pfor_reduce(spark, start, end, chunks_of(start, end, chunk), body, reducer, neutral)


def psfor_test(spark: SparkSession, start: int, end: int, options: tune.Options = tune.Options(), rounds: int = 2, **body: Callable[[Column], Column]) -> DataFrame:
    """The tuner's ranked report of chunk sizes for `psfor`; every run covers the whole range."""
    unit = max(1, (end - start) // options.largest)
    run = lambda c: psfor(spark, start, end, c * unit, **body).write.format("noop").mode("overwrite").save()
    return tune.autotune(spark, run, float(end - start), options, rounds)


def psfor_reduce_test(spark: SparkSession, start: int, end: int, body: Callable[[Column], Column], reducer: Callable[[Column], Column] = F.sum, options: tune.Options = tune.Options(), rounds: int = 2) -> DataFrame:
    """The same for `psfor_reduce`."""
    unit = max(1, (end - start) // options.largest)
    return tune.autotune(spark, lambda c: psfor_reduce(spark, start, end, c * unit, body, reducer).collect(), float(end - start), options, rounds)


def dpfor(spark: SparkSession, start: int, end: int, tasks: int, behavior: Behavior = Behavior.REPLICATED_INPUT | Behavior.DISTRIBUTED_OUTPUT, **body: Callable[[Column], Column]) -> DataFrame:
    """`pfor` with a behavior: values stay with their rank (from 0), or under `GATHER` come back as one array in order."""
    b = resolve(behavior)
    rows = pfor(spark, start, end, tasks, **body).withColumn("rank", F.spark_partition_id())
    if b & Behavior.GATHER:
        by_rank = rows.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("i", *body))).alias("values"))
        return by_rank.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "values"))), lambda x: x["values"])).alias("values"))
    return rows if b & Behavior.DISTRIBUTED_OUTPUT else rows.drop("rank")


def dpfor_reduce(spark: SparkSession, start: int, end: int, tasks: int, body: Callable[[Column], Column], reducer: Callable[[Column], Column] = F.sum, behavior: Behavior = Behavior.REPLICATED_INPUT | Behavior.REPLICATE_OUTPUT, neutral: Column | None = None) -> DataFrame:
    """`pfor_reduce` with a behavior: (rank, value) with the result at every rank, or each rank's own, or (value)."""
    b = resolve(behavior)
    if b & Behavior.DISTRIBUTED_OUTPUT:
        part = spark.range(start, end, 1, tasks).select(F.spark_partition_id().alias("rank"), body(F.col("id")).alias("value"))
        return part.groupBy("rank").agg(reducer("value").alias("value"))
    value = pfor_reduce(spark, start, end, tasks, body, reducer, neutral)
    if b & Behavior.REPLICATE_OUTPUT:
        return value.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("rank"), "value")
    return value


def dpsfor(spark: SparkSession, start: int, end: int, chunk: int, behavior: Behavior = Behavior.REPLICATED_INPUT | Behavior.DISTRIBUTED_OUTPUT, **body: Callable[[Column], Column]) -> DataFrame:
    """`dpfor` over chunks of at most `chunk` indexes, a rank each."""
    return dpfor(spark, start, end, chunks_of(start, end, chunk), behavior, **body)


def dpsfor_reduce(spark: SparkSession, start: int, end: int, chunk: int, body: Callable[[Column], Column], reducer: Callable[[Column], Column] = F.sum, behavior: Behavior = Behavior.REPLICATED_INPUT | Behavior.REPLICATE_OUTPUT, neutral: Column | None = None) -> DataFrame:
    """`dpfor_reduce` over chunks; the reducer must commute."""
    return dpfor_reduce(spark, start, end, chunks_of(start, end, chunk), body, reducer, behavior, neutral)


def dpsfor_test(spark: SparkSession, start: int, end: int, options: tune.Options = tune.Options(), rounds: int = 2, behavior: Behavior = Behavior.GATHER, **body: Callable[[Column], Column]) -> DataFrame:
    """The tuner's ranked report of chunk sizes for `dpsfor` under `behavior`."""
    unit = max(1, (end - start) // options.largest)
    run = lambda c: dpsfor(spark, start, end, c * unit, behavior, **body).write.format("noop").mode("overwrite").save()
    return tune.autotune(spark, run, float(end - start), options, rounds)


def map_rows(df: DataFrame, tasks: int | None = None, **body: Column) -> DataFrame:
    """A loop over a table's rows: values beside its columns, where the rows lie (or dealt to `tasks`)."""
    return (df.repartition(tasks) if tasks else df).select("*", *(v.alias(k) for k, v in body.items()))


def reduce_rows(df: DataFrame, chunks: int, combine: dict[str, tuple[Column, Callable[[Column], Column]]], *order: str, neutral: dict[str, Column] | None = None) -> DataFrame:
    """A loop over a table's rows in `chunks` contiguous parts, reduced within each and then over all: {name: (value of a
    row, reducer)}, for reducers that can be applied to their own results (sum, min, max)."""
    n = df.count()
    placed = with_position(df.select(*order, *(v.alias(k) for k, (v, _) in combine.items())), *order)
    partial = placed.groupBy(chunk_of(F.col("pos"), F.lit(max(1, n)), chunks).alias("chunk")).agg(*(r(k).alias(k) for k, (_, r) in combine.items()))
    whole = {k: r(k) for k, (_, r) in combine.items()}
    return partial.agg(*((F.coalesce(v, neutral[k]) if neutral and k in neutral else v).alias(k) for k, v in whole.items()))


def reduce_vectors(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """Element-wise sums of an array column: (keys, pos, total)."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.sum(F.col("x").cast("double")).alias("total"))


def gather(df: DataFrame, value: str, chunk: str = "chunk", pos: str = "pos") -> DataFrame:
    """(chunk, values): each chunk's values as an array in the order of their positions."""
    return df.groupBy(chunk).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda x: x[value]).alias("values"))


def scatter(df: DataFrame, *order: str, parts: int) -> DataFrame:
    """Rows in contiguous, range-partitioned parts, with their positions."""
    return with_position(df, *order, partitions=parts)


def replicate_output(df: DataFrame, scalar: DataFrame) -> DataFrame:
    """Every row of `df` with the columns of the one row of `scalar` (nulls if it has none)."""
    one = scalar.limit(1).withColumn("__one", F.lit(1))
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(one), "__one", "left").drop("__one")


def distributed_post(df: DataFrame, partial: dict[str, Column], post: Callable[[DataFrame], DataFrame], rank: Column | None = None) -> DataFrame:
    """The user's own reduction in place of the built-in one: `post` takes (rank, partial results), a row for each
    partition of `df` (or each value of `rank`)."""
    place = F.spark_partition_id() if rank is None else rank
    return post(df.withColumn("rank", place).groupBy("rank").agg(*(v.alias(k) for k, v in partial.items())))
