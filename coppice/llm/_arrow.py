"""Small helpers shared by the Arrow operators of this package."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def limit_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Lower Arrow's batch size from its default of 10,000 rows, so that long texts keep a worker's memory bounded."""
    if int(spark.conf.get(ROWS)) > rows:
        spark.conf.set(ROWS, str(rows))


def other_columns(df: DataFrame, *taken: str) -> list[str]:
    """Columns of `df` whose names aren't those of `taken`; like Spark, without regard to case."""
    names = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in names]


def long_hash(*cols: np.ndarray) -> np.ndarray:
    """A 64-bit mix of integer columns."""
    h = np.full(len(cols[0]), 0x2545F4914F6CDD1D, np.uint64)
    for c in cols:
        h = (h ^ c.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "byte": T.ByteType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(), "binary": T.BinaryType(), "array<int>": T.ArrayType(T.IntegerType())}


def schema(ddl: str) -> T.StructType:
    """A flat schema; unlike StructType.fromDDL it needs no running session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (part.split(" ") for part in ddl.split(", "))])
