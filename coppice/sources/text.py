"""Readers of the text inputs of the workloads: whole files of numbers, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _numbers(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "").alias("x"))


def knapsack(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(k, value, weight) by falling value for weight, and the capacity, of `n capacity (value weight)*n`."""
    x = _numbers(spark, path)
    n, capacity = (int(v) for v in x.select(F.col("x")[0], F.col("x")[1]).first())
    pairs = x.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.get("x", 2 + 2 * i).cast("int").alias("value"), F.get("x", 3 + 2 * i).cast("int").alias("weight")))).alias("p")).select("p.*")
    ordered = pairs.orderBy(F.desc(F.col("value") / F.col("weight")), F.desc("value")).collect()
    return spark.createDataFrame([(k, r["value"], r["weight"]) for k, r in enumerate(ordered)], "k int, value int, weight int"), capacity


def digraph(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(i, j) with i < j, and the number of nodes, of `n m (i j)*m`; what follows is a comment."""
    x = _numbers(spark, path)
    n, m = (int(v) for v in x.select(F.col("x")[0], F.col("x")[1]).first())
    if not m:
        return spark.createDataFrame([], "i int, j int"), n
    pair = lambda k: F.array(F.get("x", 2 + 2 * k).cast("int"), F.get("x", 3 + 2 * k).cast("int"))
    e = x.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), pair)).alias("e"))
    return e.select(F.array_min("e").alias("i"), F.array_max("e").alias("j")), n


def floorplan(spark: SparkSession, path: str) -> tuple[list[tuple[list[tuple[int, int]], int, int, int]], int | None]:
    """Cells as `workloads.floorplan` takes them, and the expected area if the file ends with one, of `n`, then for each
    cell `alternatives (rows columns)* left above next`.  A plan's cells are few, so they are read on the driver."""
    x = [int(v) for v in _numbers(spark, path).first()["x"]]
    cells, at = [], 1
    for _ in range(x[0]):
        end = at + 1 + 2 * x[at]
        cells.append((list(zip(x[at + 1 : end : 2], x[at + 2 : end : 2])), *x[end : end + 3]))
        at = end + 3
    return cells, x[at] if at < len(x) else None


def write_numbers(rows: DataFrame, path: str, head: str, *columns: str, order: str) -> None:
    """A text sink that the readers here take back: `head`, then a line of `columns` for each row, in order."""
    line = F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))
    body = rows.select(F.col(order).alias("at"), line.alias("value"))
    first = rows.sparkSession.range(1).select(F.lit(None).cast(body.schema["at"].dataType).alias("at"), F.lit(head).alias("value"))
    first.unionByName(body).orderBy(F.asc_nulls_first("at")).select("value").coalesce(1).write.mode("overwrite").text(path)


def write_positions(bodies: DataFrame, path: str) -> None:
    """A line for each body: its position in scientific notation with four digits, by id."""
    line = F.concat_ws(" ", *(F.format_string("%.4e", F.col(c)) for c in ("px", "py", "pz")))
    bodies.select("id", line.alias("value")).orderBy("id").select("value").write.mode("overwrite").text(path)


def bodies(spark: SparkSession, path: str, copies: int = 1, jitter: float = 0.0) -> tuple[DataFrame, dict[str, float]]:
    """Body rows and the run's parameters, of `n steps dt eps tol`, then mass, position and velocity of each.

    With `copies`, bodies are repeated under new ids, each position moved by less than `jitter` (by a hash of id and axis)."""
    x = _numbers(spark, path)
    head = x.select(*(F.col("x")[k] for k in range(5))).first()
    names = ("mass", "px", "py", "pz", "vx", "vy", "vz")
    row = lambda i: F.struct(i.cast("long").alias("id"), *(F.get("x", 5 + 7 * i + k).cast("double").alias(c) for k, c in enumerate(names)))
    rows = x.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(int(head[0]) - 1)), row)).alias("b")).select("b.*")
    info = dict(zip(("n", "steps", "dt", "eps", "tol"), map(float, head)))
    if copies > 1:
        n = int(head[0])
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("id", F.col("copy").cast("long") * n + F.col("id"))
        for a in ("px", "py", "pz"):
            part = (F.pmod(F.xxhash64("id", F.lit(a)), F.lit(1 << 20)) + 0.5) / float(1 << 19) - 1  # over -1, below 1
            rows = rows.withColumn(a, F.when(F.col("copy") > 0, F.col(a) + part * jitter).otherwise(F.col(a)))
        rows, info["n"] = rows.drop("copy"), float(n * copies)
    return rows, info
