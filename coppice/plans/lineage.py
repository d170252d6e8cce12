"""Lineage cuts that survive the loss of an executor.

`cut` writes a frame to the folder named by ``spark.checkpoint.dir`` (all executors share it) as Parquet and
returns a frame that reads it back.  Local checkpoints are never used: their only copy dies with its executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a local one is made only for local masters that set none (tests)."""
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if set_dir:
        return set_dir
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="coppice-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, removed with the cuts."""
    path = f"{shared_dir(spark)}/{name}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame) -> DataFrame:
    """`df` evaluated once and kept as Parquet in the shared folder."""
    spark = df.sparkSession
    path = scratch(spark, f"cut-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def written() -> int:
    """How many files are kept now: a mark for `drop` and `settle`."""
    return len(_written)


def drop(mark: int, end: int) -> None:
    """Remove the files between two marks: frames that read them can't be used any more."""
    for kept in _written[mark:end]:
        _remove(*kept)
    del _written[mark:end]


def settle(df: DataFrame, mark: int) -> DataFrame:
    """`df` cut, and all files since `mark` removed but its own: frames that read them can't be used any more."""
    out = cut(df)
    drop(mark, len(_written) - 1)
    return out


def remove_cuts() -> None:
    """Delete what `cut` has written in sessions that still run (also called at exit)."""
    while _written:
        _remove(*_written.pop())


atexit.register(remove_cuts)
