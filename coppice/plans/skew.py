"""Joins whose hot keys are dealt to several tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT = 1 << 14  # rows of a key from which it is dealt out; a table of n rows has n / HOT such keys at most
SALTS = 64


def row_hash(df: DataFrame, *columns: str) -> Column:
    """A 64-bit hash of those of `columns` (all by default) that can be hashed: maps can't."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return F.xxhash64(F.lit(0), *(F.col(f"`{c}`") for c in columns or df.columns if "map<" not in types[c]))


def join_hot(many: DataFrame, one: DataFrame, key: str, hot: DataFrame, salts: int = SALTS) -> DataFrame:
    """`many` joined to `one` (a row for each `key`), keys in `hot` (distinct, at most rows / HOT: they are broadcast) being
    dealt to `salts` places by a hash of the row, their row of `one` going to each."""
    if hot.isEmpty():
        return many.join(one, key)
    marks = F.broadcast(hot.select(F.col(key), F.lit(True).alias("__hot")))
    place = F.pmod(row_hash(many), F.lit(salts)).cast("int")
    spread = lambda df, at: df.join(marks, key, "left").withColumn("__salt", at).drop("__hot")
    left = spread(many, F.when(F.col("__hot"), place).otherwise(0))
    right = spread(one, F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "__salt"]).drop("__salt")
