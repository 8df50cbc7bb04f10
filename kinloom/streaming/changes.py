"""Refreshing a table from a stream of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kinloom.operators.incremental import upsert


def distinct_changes(stream: DataFrame, key: str, at: str, overlap: str = "2 hours") -> DataFrame:
    """One row for each key and time of change; repeats that come within ``overlap`` are dropped, and so is their state."""
    return stream.withWatermark(at, overlap).dropDuplicatesWithinWatermark([key, at])


def keep_current(stream: DataFrame, path: str, keys: list[str], version: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest row of each key below ``path``, in one folder for each batch; ``current`` reads the last.

    A batch that runs again writes its own folder again, from the folder before it, so that results are the same.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = current(spark, path, before=number)
        latest = upsert(old.limit(0) if old is not None else batch.limit(0), batch, keys, version)
        if old is not None:
            newer = latest.unionByName(old)
            latest = upsert(old.limit(0), newer, keys, version)
        latest.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, path: str, before: int | None = None) -> DataFrame | None:
    """The table after the last batch (or the last before ``before``), or None."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("batch="))
    done = [n for n in names if (before is None or int(n[6:]) < before) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return spark.read.parquet(f"{path}/{done[-1]}") if done else None
