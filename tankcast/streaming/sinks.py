"""Publishing sinks (S2): idempotent per micro-batch.

The reference opened one broker connection per non-empty partition and
dropped errors.  Here a micro-batch is written as files under
``batch_id=<n>``; a replayed batch (after a failure) overwrites its own
folder, so the output is exactly-once for file consumers and at-least-once
for anything downstream of them.  Task errors propagate, so Spark retries the
batch from the checkpoint instead of losing it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_batch(df: DataFrame, path: str, batch_id: int, fmt: str = "parquet",
                partition_by: list[str] | None = None) -> None:
    """Write one micro-batch under ``path/batch_id=<n>`` (overwrite = replay-safe).
    An empty batch gives a folder without rows: asking first whether it is
    empty would compute it twice."""
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(f"{path.rstrip('/')}/batch_id={batch_id}")


def staged(df: DataFrame, path: str, batch_id: int) -> DataFrame:
    """The micro-batch written once and read back, for flows that use its rows
    more than once (a stateful batch would otherwise be computed each time)."""
    write_batch(df, path, batch_id)
    return df.sparkSession.read.schema(df.schema).parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def publish_batches(path: str, fmt: str = "parquet",
                    transform: Callable[[DataFrame, int], DataFrame] | None = None):
    """``foreachBatch`` function: optional transform, then ``write_batch``."""
    def run(df: DataFrame, batch_id: int) -> None:
        out = transform(df, batch_id) if transform else df
        write_batch(out, path, batch_id, fmt)
    return run


def write_routes(df: DataFrame, path: str, route_col: str = "route", mode: str = "append",
                 fmt: str = "parquet") -> None:
    """F4 fan-out: one folder per route (consumers read only their own)."""
    (df.withColumn("__route", F.regexp_replace(F.col(route_col), "/", "_"))
       .write.mode(mode).format(fmt).partitionBy("__route").save(path))
