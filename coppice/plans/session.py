"""Sessions for the engine: what the original's init calls set, as Spark settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(threads: int | None = None, tasks: int | None = None, partition_bytes: int | None = None, **settings: str) -> SparkSession:
    """A session, or the running one with these settings: `threads` of a local master (only if none is configured),
    `tasks` of a shuffle, the most bytes that a task reads.  Further settings go by their names, with _ for dots."""
    builder = SparkSession.builder
    if threads and SparkSession.getActiveSession() is None:
        builder = builder.master(f"local[{threads}]")
    chosen = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    if tasks:
        chosen["spark.sql.shuffle.partitions"] = str(tasks)
    if partition_bytes:
        chosen["spark.sql.files.maxPartitionBytes"] = str(partition_bytes)
    chosen |= {k.replace("_", "."): str(v) for k, v in settings.items()}
    return builder.config(map=chosen).getOrCreate()
